"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.sources.shared import dealt, if_small  # noqa: F401

#: Rows sent to a Python worker at once. A batch of whole texts then takes a few
#: megabytes, so workers stay small beside the executor's heap.
MOST_ROWS = 1000


def _bounded_batches(spark: SparkSession) -> None:
    """Lower the session's rows in an Arrow batch to MOST_ROWS, if it has more."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= MOST_ROWS:
        spark.conf.set(name, str(MOST_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    _bounded_batches(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A local session that names none (tests) gets a temporary folder of its own.
    On a cluster no folder of one machine would do, so there it must be named.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, in the one of this application; see `cleared`."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    _bounded_batches(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back.

    This cuts the lineage: a lost executor makes Spark re-read a file, not
    recompute what led to it. The files stay as long as results are read from
    them; `cleared` deletes all of an application, `Steps` what one call needed.
    """
    return _written(df, scratch(df.sparkSession, label))


def deleted(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; one that is not there is no error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleared(spark: SparkSession) -> None:
    """Delete all this application has written to the shared folder; results not yet saved elsewhere go with it."""
    deleted(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


class Steps:
    """Tables that only one call needs: written like `written`, deleted when the block ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark, self.path, self.n = spark, scratch(spark, label), 0

    def __enter__(self) -> Steps:
        return self

    def __exit__(self, *_) -> None:
        deleted(self.spark, self.path)

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.path}/{self.n}-{label}")

    def dropped(self, df: DataFrame) -> None:
        """Delete one of the tables early."""
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            deleted(self.spark, path)


def no_text(column) -> F.Column:
    """A text column with null as the empty string."""
    return F.coalesce(column, F.lit(""))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a file of the installed public tokenizers is."""
    import public_tokenizers

    return public_tokenizers.path(name)
