"""Clusters of a keyword graph: summaries, their documents, links between them, and years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LEAST_SHARE, MOST_DOCS, MOST_LINKS = 0.2, 10, 16


def summaries(words: DataFrame, clusters: DataFrame) -> DataFrame:
    """cluster, size, label of the three heaviest words and the top five (of 60 keywords at most)."""
    listed = words.join(F.broadcast(clusters), "word").groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "word"))).alias("all"))
    names = F.transform("all", lambda x: x["word"])
    return listed.select("cluster", F.size("all").alias("size"), F.array_join(F.slice(names, 1, 3), " · ").alias("label"), F.array_join(F.slice(names, 1, 5), ",").alias("top_terms"))


def affinities(contains: DataFrame, words: DataFrame, clusters: DataFrame) -> DataFrame:
    """doc_id, cluster and share: what a cluster's keywords weigh in a document, of all keywords there.

    Weights are added as decimals, so the order does not matter.
    """
    w = words.select("word", F.col("weight").alias("node_weight"))
    part = contains.join(F.broadcast(w), "word").join(F.broadcast(clusters), "word").groupBy("doc_id", "cluster").agg(F.sum((F.col("node_weight") * F.col("weight")).cast("decimal(38,6)")).alias("part"))
    total = part.groupBy("doc_id").agg(F.sum("part").alias("total"))
    return part.join(total, "doc_id").select("doc_id", "cluster", F.round(F.col("part").cast("double") / F.col("total").cast("double"), 6).alias("share"))


def main_cluster(hits: DataFrame, documents: DataFrame, clusters: DataFrame, fallback: str = "c0") -> DataFrame:
    """The cluster of most different keywords of each document; of equals the one met first in the text.

    hits: doc_id, word, pos. Documents without a keyword get the fallback.
    """
    each = hits.groupBy("doc_id", "word").agg(F.min("pos").alias("pos"))
    tally = each.join(F.broadcast(clusters), "word").groupBy("doc_id", "cluster").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    best = tally.groupBy("doc_id").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("pos"))).alias("cluster"))
    return documents.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.coalesce("cluster", F.lit(fallback)).alias("cluster"))


def cluster_documents(shares: DataFrame, most: int = MOST_DOCS) -> DataFrame:
    """The documents with the largest shares (0.2 or more) of each cluster, and how many there are in all.

    The ranking keeps the first ten while it sorts (a window group limit), so a
    large cluster does not go through one task whole.
    """
    rows = shares.where(F.col("share") >= LEAST_SHARE)
    order = W.partitionBy("cluster").orderBy(F.desc("share"), "doc_id")
    top = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    n = rows.groupBy("cluster").agg(F.count("*").alias("n"))
    return top.join(F.broadcast(n), "cluster").select("cluster", "doc_id", "share", "nth", "n")


def cluster_links(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Edges between each two clusters, the 16 largest numbers."""
    a, b = (clusters.select(F.col("word").alias(f"word_{x}"), F.col("cluster").alias(f"c_{x}")) for x in "ab")
    pairs = edges.join(F.broadcast(a), "word_a").join(F.broadcast(b), "word_b").where("c_a <> c_b")
    return pairs.groupBy(F.least("c_a", "c_b").alias("cluster_a"), F.greatest("c_a", "c_b").alias("cluster_b")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_a", "cluster_b").limit(MOST_LINKS)


def top_concepts(contains: DataFrame, documents: DataFrame, most: int = 3) -> DataFrame:
    """The keywords in most documents of each year."""
    dated = documents.where("published IS NOT NULL").select("doc_id", F.year("published").alias("year"))
    n = contains.join(dated, "doc_id").groupBy("year", "word").agg(F.count("*").alias("n"))  # years by 60 keywords
    return n.withColumn("nth", F.row_number().over(W.partitionBy("year").orderBy(F.desc("n"), "word"))).where(F.col("nth") <= most)


def word_years(contains: DataFrame, documents: DataFrame) -> DataFrame:
    """The first year of the documents of each keyword; null without a date."""
    return contains.join(documents.select("doc_id", "published"), "doc_id").groupBy("word").agg(F.min(F.year("published")).alias("year"))


def frame(values: DataFrame, column: str) -> DataFrame:
    """Quartiles (linear) of a column, and the rows within three ranges of them."""
    q = values.agg(F.percentile(column, 0.25).alias("q1"), F.percentile(column, 0.75).alias("q3"))
    near = F.col(column).between(F.col("q1") - 3 * (F.col("q3") - F.col("q1")), F.col("q3") + 3 * (F.col("q3") - F.col("q1")))
    return values.join(F.broadcast(q)).where(near).agg(F.min(column).alias("low"), F.max(column).alias("high"), F.count("*").alias("n"))
