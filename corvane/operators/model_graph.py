"""A graph of entities from a model's answers, for any number of topics at once.

An answer is JSON text; what it refers to by place in the list of documents is
checked against that list. Nothing it makes up gets into the graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.model import failure_reason, unfenced
from corvane.functions.text import round3

ANSWER = (
    "entities array<struct<name:string,type:string,aliases:array<string>,docIndices:array<int>>>,"
    "relations array<struct<source:string,target:string,label:string,weight:double,docIndices:array<int>>>,"
    "clusters array<struct<label:string,summary:string,entities:array<string>,docIndices:array<int>>>"
)
#: Clusters of an answer that are read, and the label of the one for what no cluster takes.
MOST_CLUSTERS, OTHERS = 12, "其他"

_ID = "topic", "doc_id"
Graph = tuple[DataFrame, ...]


def _list(answers: DataFrame, field: str) -> DataFrame:
    return answers.select("topic", F.posexplode(f"answer.{field}").alias("at", "x"))


def _cited(rows: DataFrame, picked: DataFrame) -> DataFrame:
    """rows with `nth` looked up among the picked documents; places outside the list go."""
    return rows.join(picked.select(*_ID, "nth"), ["topic", "nth"])


def _keyed(name: Column) -> Column:
    return F.concat(F.lit("k:"), name)


def assembled(answers: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and clusters of each topic.

    answers: topic, json (one row a topic). documents: topic, doc_id, nth (place
    in the list the model was shown; null: not shown), title, word_count.

    Entities of one name are one, of the first one's type, with all aliases. An
    entity or document belongs to the first cluster that names it; an entity none
    names goes where most of its documents are (the first met on ties); what is
    left goes to a last cluster. Relations need two different entities that exist.
    Documents that were not shown are in the first cluster. Clusters without nodes go.
    An answer that is no JSON gives a graph of documents only.
    """
    read = answers.select("topic", F.from_json(unfenced(F.col("json")), ANSWER).alias("answer"))
    picked = documents.where("nth IS NOT NULL")

    named = _list(read, "entities").withColumn("name", F.trim("x.name")).where("name <> ''")
    entities = named.groupBy("topic", "name").agg(F.min_by("x.type", "at").alias("type"), F.min("at").alias("first"))
    alias = named.select("topic", "name", F.explode("x.aliases").alias("a")).select("topic", "name", F.trim("a").alias("a")).where("a <> '' AND a <> name")
    aliases = alias.groupBy("topic", "name").agg(F.sort_array(F.collect_set("a")).alias("aliases"))
    mentions = _cited(named.select("topic", "name", "at", F.posexplode("x.docIndices").alias("k", "nth")), picked)
    mentions = mentions.groupBy("topic", "name", "doc_id").agg(F.min(F.struct("at", "k")).alias("met"))

    listed = _list(read, "clusters").where(F.col("at") < MOST_CLUSTERS)
    claimed = listed.select("topic", "at", F.explode("x.entities").alias("name")).withColumn("name", F.trim("name"))
    claimed = claimed.join(entities.select("topic", "name"), ["topic", "name"]).groupBy("topic", "name").agg(F.min("at").alias("cluster"))
    doc_cluster = _cited(listed.select("topic", "at", F.explode("x.docIndices").alias("nth")), picked).groupBy(*_ID).agg(F.min("at").alias("cluster"))
    votes = mentions.join(doc_cluster, [*_ID]).groupBy("topic", "name", "cluster").agg(F.count("*").alias("n"), F.min("met").alias("met"))
    voted = votes.groupBy("topic", "name").agg(F.min_by("cluster", F.struct(-F.col("n"), F.col("met"))).alias("vote"))
    ends = listed.groupBy("topic").agg(F.count("*").cast("int").alias("n_clusters"))

    relations = _list(read, "relations").select("topic", "at", F.trim("x.source").alias("a"), F.trim("x.target").alias("b"), F.nullif(F.trim("x.label"), F.lit("")).alias("label"), F.least(F.greatest("x.weight", F.lit(0.0)), F.lit(1.0)).alias("weight"), F.col("x.docIndices").alias("cited")).where("a <> b")
    for end in ("a", "b"):
        relations = relations.join(entities.select("topic", F.col("name").alias(end)), ["topic", end], "left_semi")
    evidence = _cited(relations.select("topic", "at", F.explode("cited").alias("nth")), picked).groupBy("topic", "at").agg(F.sort_array(F.collect_set(F.col("doc_id").cast("string"))).alias("evidence"))
    none = F.array().cast("array<string>")
    related = relations.join(evidence, ["topic", "at"], "left").select("topic", _keyed(F.col("a")).alias("src"), _keyed(F.col("b")).alias("dst"), F.lit("relation").alias("kind"), "label", "weight", F.coalesce("evidence", none).alias("evidence"))
    doc = F.concat(F.lit("d:"), F.col("doc_id").cast("string"))
    contains = mentions.select("topic", doc.alias("src"), _keyed(F.col("name")).alias("dst"), F.lit("contains").alias("kind"), F.lit(None).cast("string").alias("label"), F.lit(1.0).alias("weight"), F.array(F.col("doc_id").cast("string")).alias("evidence"))
    edges = related.unionByName(contains)

    degree = edges.select("topic", F.explode(F.array("src", "dst")).alias("id")).groupBy("topic", "id").agg(F.count("*").alias("degree"))
    support = mentions.groupBy("topic", "name").agg(F.count("*").alias("n_docs"))
    rows = entities
    for more in (claimed, voted, aliases, support):
        rows = rows.join(more, ["topic", "name"], "left")
    rows = rows.join(ends, "topic", "left").withColumn("id", _keyed(F.col("name"))).join(degree, ["topic", "id"], "left")
    last = F.coalesce("n_clusters", F.lit(0))
    things = rows.select(
        "topic", "id", F.col("name").alias("label"), F.lit("entity").alias("kind"), "type", F.coalesce("aliases", none).alias("aliases"), F.greatest(F.lit(1), F.coalesce("n_docs", F.lit(0))).cast("double").alias("weight"),
        F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("cluster", "vote", last).alias("cluster"), "first",
    )
    papers = documents.join(doc_cluster, [*_ID], "left").join(ends, "topic", "left").select(
        "topic", doc.alias("id"), F.col("title").alias("label"), F.lit("document").alias("kind"), F.lit(None).cast("string").alias("type"), none.alias("aliases"), round3(F.round(F.log1p("word_count"), 9)).alias("weight"),
        F.lit(0).cast("long").alias("degree"), F.when(F.col("nth").isNull(), 0).otherwise(F.coalesce("cluster", last)).alias("cluster"), F.lit(None).cast("int").alias("first"),
    )
    nodes = things.unionByName(papers)
    clusters = _clusters(nodes, listed)
    return nodes.withColumn("cluster", F.concat(F.lit("c"), F.col("cluster").cast("string"))).drop("first"), edges, clusters


def built(model: Callable[[], Graph] | None, plain: Callable[[], Graph], force: str | None = None) -> tuple[Graph, str, str | None]:
    """The graph of a model if there is one and it answers, else the plain one: graph, who made it, and why not the model.

    force: `llm` or `heuristic`. A failure is told apart by `failure_reason`, so the
    graph comes with its cause instead of an error.
    """
    if force == "heuristic" or (model is None and force != "llm"):
        return plain(), "heuristic", None
    if model is None:
        return plain(), "heuristic", "未配置 LLM_API_KEY"
    try:
        return model(), "llm", None
    except Exception as error:  # whatever a client raises is a reason, none is fatal here
        row = SparkSession.active().range(1).select(failure_reason(F.lit(str(error))).alias("why")).first()
        return plain(), "heuristic", row.why


def _clusters(nodes: DataFrame, listed: DataFrame) -> DataFrame:
    """topic, cluster, label, size and the five heaviest entities of each cluster with nodes.

    Ranks are limited to five before the shuffle, so no list of all nodes is made.
    """
    key = ["topic", "cluster"]
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("weight"), "first"))
    top = nodes.where("kind = 'entity'").withColumn("nth", rank).where("nth <= 5").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("nth", "label")))["label"].alias("top"))
    sizes = nodes.groupBy(*key).agg(F.count("*").alias("size")).join(top, key, "left")
    labels = listed.select("topic", F.col("at").alias("cluster"), F.coalesce(F.nullif(F.trim("x.label"), F.lit("")), F.concat(F.lit("主题 "), (F.col("at") + 1).cast("string"))).alias("label"))
    return sizes.join(labels, key, "left").select("topic", F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("cluster"), F.coalesce("label", F.lit(OTHERS)).alias("label"), "size", F.coalesce(F.array_join("top", ","), F.lit("")).alias("top_terms"))
