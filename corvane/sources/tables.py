"""Connectors: the tables of a folder in the shapes the operators work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.constants import FEEDS
from corvane.functions.html import stripped
from corvane.functions.text import count_words
from corvane.functions.urls import normalize_url, result_id
from corvane.sources.shared import dealt

FEED = "title string, url string, enabled boolean"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table below `folder`."""
    return dealt(spark.read.parquet(f"{folder}/{name}.parquet"))


def unjudged(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with title, site, word count and a date derived from the id, without verdicts: no join, so texts stay where they are."""
    k = F.col("doc_id")
    published = F.when(k % 7 != 0, F.make_date((2010 + k % 15).cast("int"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int")))
    return table(spark, folder, "documents").select(
        k, F.col("text"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("source").alias("site"), count_words(F.col("text")).alias("word_count"),
        published.alias("published"), F.when(k % 10 == 9, "raw").otherwise("readability").alias("method"), F.when(k % 23 == 5, F.concat(F.lit("HTTP "), (400 + k % 4).cast("string"))).alias("error"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with title, site, word count, verdicts and a date derived from the id.

    A verdict is null where nothing has been judged. The join to the labels is an
    equi-join on the id; Spark picks its kind by size.
    """
    labels = table(spark, folder, "labels")
    judged = labels.select("doc_id", F.when(F.col("quality") == 1, "likely").otherwise("unlikely").alias("verdict"), F.when(F.col("quality") == 1, "high").otherwise("low").alias("value"))
    return unjudged(spark, folder).join(judged, "doc_id", "left")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """Search results made of the pages: provider and rank from the id, title and snippet from the html."""
    k = F.col("page_id")
    rows = table(spark, folder, "pages").select(
        k, "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.substring(stripped(F.col("html")), 1, 300).alias("snippet"),
        F.concat(F.lit("p"), (k % 4).cast("string")).alias("provider"), F.expr("cast(page_id div 4 as int)").alias("rank"),
        F.when(k % 5 != 0, F.make_date((2015 + k % 10).cast("int"), (1 + k % 12).cast("int"), F.lit(1))).alias("published"),
    )
    rows = rows.withColumn("norm_url", normalize_url(F.col("url")))
    return rows.withColumn("result_id", result_id(F.col("norm_url")))


def saved(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrite a table of a session; Spark's committer makes the replacement whole or not at all."""
    df.write.mode("overwrite").format(kind).save(path)


def sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Sessions as JSON, latest first; what cannot be read is skipped."""
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    return rows.where("_corrupt IS NULL").drop("_corrupt").orderBy(F.desc("updatedAt"))


def feeds(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Feed rows of a JSON file, a list or an object with `feeds`: only http(s) urls, title the url where missing, enabled unless told otherwise.

    Without a path, or without a valid row, the default feeds.
    """
    default = spark.createDataFrame([(t, u, True) for t, u in FEEDS], FEED)
    if not path:
        return default
    rows = spark.read.schema(f"{FEED}, feeds array<struct<{FEED}>>").option("multiLine", True).json(path)
    rows = rows.select(F.inline(F.coalesce("feeds", F.array(F.struct("title", "url", "enabled")))))
    rows = _coerced(rows)
    return default if rows.isEmpty() else rows


def _coerced(rows: DataFrame) -> DataFrame:
    url = F.trim("url")
    return rows.where(url.rlike("(?i)^https?://")).select(F.coalesce(F.nullif(F.trim("title"), F.lit("")), url).alias("title"), url.alias("url"), F.coalesce("enabled", F.lit(True)).alias("enabled"))


def save_feeds(rows: DataFrame, path: str) -> None:
    """Overwrite a table of feeds; if one row is invalid, nothing is written."""
    kept = _coerced(rows)
    if kept.count() != rows.count():
        raise ValueError("a feed without an http(s) url")
    saved(kept, path, "json")


def deleted(spark: SparkSession, path: str) -> bool:
    """Delete a table of a session; False if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def xml_entries(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    """Entries of Atom or RSS files, with an explicit schema."""
    return spark.read.format("xml").schema(schema).option("rowTag", row_tag).load(path)
