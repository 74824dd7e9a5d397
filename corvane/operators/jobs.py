"""Download jobs: planning tasks, their states and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KINDS = ("article", "transcript", "image", "media")


def _artefacts() -> dict[str, Column]:
    """Whether a document (text, method, kind, images) can have each kind of artefact."""
    some = F.length(F.coalesce("text", F.lit(""))) > 0
    video = F.col("kind").eqNullSafe("video")
    return {"article": ~F.col("method").eqNullSafe("raw") & some, "transcript": video & some, "image": F.coalesce(F.size("images"), F.lit(0)) > 0, "media": video}


def planned(documents: DataFrame, kinds: Sequence[str] = KINDS) -> DataFrame:
    """One queued task for each asked-for kind of artefact a document can have; documents without any give none.

    An article needs a text that is not only a search snippet, a transcript a
    video's text, an image pictures, media a video.
    """
    can = _artefacts()
    wanted = F.array_compact(F.array(*[F.when(can[k], k) for k in kinds])) if kinds else F.array().cast("array<string>")
    return documents.select("doc_id", F.explode(wanted).alias("kind"))


def available(documents: DataFrame) -> DataFrame:
    """How many documents can have each kind of artefact."""
    return documents.agg(*[F.count_if(c).alias(k) for k, c in _artefacts().items()])


def kinds_of(tasks: DataFrame, job: str = "job_id") -> DataFrame:
    """The kinds of each job's tasks, sorted."""
    return tasks.groupBy(job).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))


def is_terminal(status: Column, paused: bool = False) -> Column:
    """Whether nothing more happens by itself; a pause counts for those who watch, not for those who run."""
    return status.isin("done", "failed", "partial", "canceled", *(["paused"] if paused else []))


def existing(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """tasks with `exists`: their path is a file that is not empty, or a folder that holds `.done`.

    files: path and bytes. Both are found by one equi-join on the path.
    """
    made = files.where("bytes > 0").select("path").unionByName(files.where(F.col("path").endswith("/.done")).select(F.expr("left(path, length(path) - 6)").alias("path")))
    made = made.distinct().withColumn("exists", F.lit(True))
    return tasks.join(made, "path", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))


def image_batches(images: DataFrame, most: int = 30, key: str = "task_id") -> DataFrame:
    """Outcome of the first `most` images of each task: done if one was fetched, failed if none; a note if some were not.

    images: task_id, nth (from 1) and ok.
    """
    got, all_ = F.count_if("ok"), F.count("*")
    rows = images.where(F.col("nth") <= most).groupBy(key).agg(got.alias("fetched"), all_.alias("asked"))
    note = F.when((F.col("fetched") > 0) & (F.col("fetched") < F.col("asked")), F.format_string("%d of %d images", "fetched", "asked"))
    return rows.withColumn("status", F.when(F.col("fetched") > 0, "done").otherwise("failed")).withColumn("note", note)


def summary(tasks: DataFrame, job: str = "job_id") -> DataFrame:
    """Counts, bytes and the outcome of each job: done, failed, partial, or running while tasks remain."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    left = F.count_if(F.col("status").isin("queued", "running", "paused"))
    outcome = F.when(left > 0, "running").when(is_("failed") == 0, "done").when(is_("done") == 0, "failed").otherwise("partial")
    return tasks.groupBy(job).agg(F.count("*").alias("total"), is_("done").alias("done"), is_("failed").alias("failed"), left.alias("remaining"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), outcome.alias("outcome"))


def latest(events: DataFrame, key: str, status: str, at: str, tie: str) -> DataFrame:
    """The last status of each key; equal times go by `tie`."""
    return events.groupBy(key).agg(F.max_by(status, F.struct(at, tie)).alias("status"), F.max(at).alias("at"), F.count("*").alias("n"))


def reset(tasks: DataFrame, action: str) -> DataFrame:
    """Statuses after retry, resume or cancel."""
    again = {"retry": ("running", "paused", "failed"), "resume": ("running", "paused", "failed", "canceled"), "cancel": ()}[action]
    status = F.when(F.col("status").isin(*again), "queued").otherwise(F.col("status")) if again else F.when(F.col("status") == "queued", "canceled").otherwise(F.col("status"))
    return tasks.withColumn("status", status)


def stalled(progress: DataFrame, at: str = "ts", size: str = "value", least: float = 8192, key: str = "user_id") -> DataFrame:
    """Minutes in which a transfer moved less than `least`."""
    return progress.groupBy(key, F.window(at, "60 seconds").alias("w")).agg(F.sum(size).alias("moved")).where(F.col("moved") < least).select(key, F.col("w.start").alias("start"), "moved")
