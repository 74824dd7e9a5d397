"""What comes back from a language model: fences, verdicts by place, reasons of failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.misc import category

#: Reasons of failures, fixed values.
CANCELLED, LIMITED, NO_KEY, NETWORK, FAILED = "LLM 调用被取消", "LLM 限流或过载，已降级：", "LLM_API_KEY 无效，已降级：", "LLM 调用网络失败，已降级：", "LLM 构图失败，已降级："
NO_REASON, NO_VALUE_REASON = "模型未给出依据", "未给出依据"


def unfenced(text: Column) -> Column:
    """An answer without white space around it and without a fence of three backticks."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.regexp_replace(F.regexp_replace(bare, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", "")
    return F.when(bare.startswith("```"), F.trim(inner)).otherwise(bare)


def failure_reason(message: Column) -> Column:
    """Why a graph was not built by the model: the first class of failure its message shows."""
    with_text = lambda head: F.concat(F.lit(head), message)
    return (
        F.when(message.rlike("(?i)abort"), CANCELLED)
        .when(message.rlike(r"(?i)\b(429|rate.?limit|overloaded|529)\b"), with_text(LIMITED))
        .when(message.rlike(r"(?i)\b(401|403|invalid.*api.*key|authentication)\b"), with_text(NO_KEY))
        .when(message.rlike("(?i)timeout|ETIMEDOUT|ECONNRESET|fetch failed"), with_text(NETWORK))
        .otherwise(with_text(FAILED))
    )


def batched(rows: DataFrame, order: str, size: int, most: int) -> DataFrame:
    """The first `most` rows of each query in batches of `size`: batch and nth, the place in it, are added."""
    at = F.row_number().over(W.partitionBy("query").orderBy(order))
    rows = rows.withColumn("_at", at).where(F.col("_at") <= most)  # the limit goes before the shuffle
    return rows.withColumns({"batch": F.floor((F.col("_at") - 1) / size).cast("int"), "nth": (F.col("_at") - 1) % size}).drop("_at")


def _items(answers: DataFrame, field: str, item: str) -> DataFrame:
    read = answers.withColumn("x", F.from_json(unfenced(F.col("json")), f"{field} array<struct<{item}>>")[field])
    return read.select("query", "batch", F.posexplode("x").alias("place", "x")).withColumn("nth", F.col("x.index"))


def judged(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of `batched` with the model's verdict, clamped score and reason.

    answers: query, batch, json. Of two verdicts on one place the later holds;
    places outside a batch are dropped; a batch that failed judges nothing.
    """
    v = _items(answers, "verdicts", "index:int,verdict:string,score:double,match:string,reason:string")
    v = v.groupBy("query", "batch", "nth").agg(F.max_by("x", "place").alias("x"))
    score = F.least(F.greatest("x.score", F.lit(0.0)), F.lit(1.0))
    return rows.join(v, ["query", "batch", "nth"]).select(*rows.columns, F.col("x.verdict").alias("verdict"), score.alias("score"), F.coalesce(F.nullif(F.trim("x.reason"), F.lit("")), F.lit(NO_REASON)).alias("reason"))


def valued(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows of `batched` with the model's value and category; the first batch that failed and all after it have none."""
    good = F.from_json(unfenced(F.col("json")), "items array<struct<index:int>>")["items"].isNotNull()
    failed = answers.groupBy("query").agg(F.min(F.when(~good, F.col("batch"))).alias("_failed"))
    v = _items(answers, "items", "index:int,verdict:string,category:string,reason:string").join(failed, "query", "left").where("_failed IS NULL OR batch < _failed")
    v = v.groupBy("query", "batch", "nth").agg(F.max_by("x", "place").alias("x"))
    return rows.join(v, ["query", "batch", "nth"]).select(*rows.columns, F.col("x.verdict").alias("verdict"), category(F.col("x.category")).alias("category"), F.coalesce(F.nullif(F.trim("x.reason"), F.lit("")), F.lit(NO_VALUE_REASON)).alias("reason"))
