"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; a local session without one gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of a table that is dealt anew: one file with one row group would be one task otherwise.
LEAST_DEALT, MOST_DEALT = 4_000_000, 24_000_000


def dealt(df: DataFrame) -> DataFrame:
    """A small table's rows dealt to all cores; larger tables have parts enough, and are never shuffled for it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if LEAST_DEALT <= size <= MOST_DEALT else df


def written(df: DataFrame, label: str) -> DataFrame:
    """`df` as Parquet in the shared folder, read back: later steps read it instead of computing it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, most: int = 500_000) -> DataFrame:
    """A written frame of narrow rows, marked for broadcast if it has `most` rows or fewer.

    Its rows are counted first; a larger one is joined by a shuffle.
    """
    return F.broadcast(df) if df.count() <= most else df


def numbered(rows: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """`rows` with their places in a total order, from 1, without bringing them to one task.

    The rows are cut into ranges of the order and written, so the ranges stay what
    they are; each range counts its own rows, and the sizes of the ranges before it
    (one row for each range) are added.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = sizes.select("_range", (F.sum("n").over(W.orderBy("_range")) - F.col("n")).alias("_before"))  # one row a range
    nth = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_nth", nth).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_nth")).drop("_range", "_nth", "_before")
