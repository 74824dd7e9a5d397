"""Streams give what the batch form gives, and upserts can be tried again."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions.plan import build_query, industry_clause, lexical_plan, query_variants, variant
from corvane.operators import jobs
from corvane.plans import clusters
from corvane.streaming import events as streams

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"


def events(spark, path, parts=3):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type", "value")
    rows.repartition(parts, "event_id").write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def test_windows_and_states(spark, tmp_path):
    path = str(tmp_path / "in")
    batch = events(spark, path)
    stream = streams.source(spark, path, SCHEMA)
    q = streams.to_memory(streams.windowed(stream, "1 day", "400 days"), "windows", "complete", str(tmp_path / "c1"))
    q.awaitTermination()
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("windows")) == key(streams.windowed(batch, "1 day"))
    q = streams.to_memory(streams.latest_states(stream), "states", "complete", str(tmp_path / "c2"))
    q.awaitTermination()
    assert sorted((r.user_id, r.n) for r in spark.table("states").collect()) == sorted((r.user_id, r.n) for r in streams.latest_states(batch).collect())
    q = streams.to_memory(streams.first_seen(stream, "event_id", "400 days"), "firsts", "append", str(tmp_path / "c3"))
    q.awaitTermination()
    assert spark.table("firsts").count() == batch.select("event_id").distinct().count()


def test_upserts(spark, tmp_path):
    path, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch = events(spark, path)
    q = streams.source(spark, path, SCHEMA).writeStream.foreachBatch(streams.upserting(target, "user_id", "event_id")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {r.user_id: r.e for r in batch.groupBy("user_id").agg(F.max("event_id").alias("e")).collect()}
    assert {r.user_id: r.event_id for r in streams.current(spark, target).collect()} == want


def test_jobs(spark):
    rows = spark.createDataFrame([(1, "done", 5), (1, "failed", None), (2, "done", 1), (3, "failed", 0), (4, "queued", None), (4, "canceled", 1)], "job_id int, status string, bytes long")
    assert {r.job_id: (r.outcome, r.bytes) for r in jobs.summary(rows).collect()} == {1: ("partial", 5), 2: ("done", 1), 3: ("failed", 0), 4: ("running", 1)}
    status = lambda action: sorted(r.status for r in jobs.reset(rows, action).collect())
    assert status("retry") == ["canceled", "done", "done", "queued", "queued", "queued"] and status("resume").count("queued") == 4 and status("cancel").count("canceled") == 2


def test_plans():
    assert build_query("a b", "c.com") == "a b site:c.com" and build_query("a") == "a"
    assert industry_clause([]) == "" and industry_clause(["新能源", "own"]) == '("新能源" OR "电池" OR "光伏" OR "own")'
    assert variant("base", "intent", ["r1", "r2"]) == 'base intent ("r1" OR "r2")' and variant("the intent", "intent") == "the intent"
    assert query_variants(["A  b", "a B", "", "c", "d", "e", "f", "g"]) == ["A b", "c", "d", "e", "f"]
    assert lexical_plan("GPT-4.1")["variants"] == ["GPT-4.1", "GPT 4 1", "GPT41"]


def test_clusters(spark):
    words = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "word string, weight double")
    cl = spark.createDataFrame([("a", "c0"), ("b", "c0"), ("c", "c1")], "word string, cluster string")
    contains = spark.createDataFrame([(1, "a", 1.0), (1, "c", 3.0), (2, "c", 1.0)], "doc_id long, word string, weight double")
    shares = clusters.affinities(contains, words, cl)
    assert sorted((r.doc_id, r.cluster, r.share) for r in shares.collect()) == [(1, "c0", 0.5), (1, "c1", 0.5), (2, "c1", 1.0)]
    hits = spark.createDataFrame([(1, "c", 0), (1, "a", 3), (1, "b", 5), (1, "c", 9), (2, "c", 1), (2, "a", 2), (2, "c", 3)], "doc_id long, word string, pos int")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    assert sorted((r.doc_id, r.cluster) for r in clusters.main_cluster(hits, docs, cl).collect()) == [(1, "c0"), (2, "c1"), (3, "c0")]


def test_page_facts(spark):
    from corvane.functions import html, urls

    page = '<head><script>{"datePublished": "nonsense", "dateCreated": "2020-05-06"}</script><meta content="2021-01-01" property="article:published_time"></head><h2>A &amp; b</h2><p>See <a href="/x">this</a> <b>now</b><ul><li>one<li>two</ul><img src="/a.png"><img width=20 src="/b.png"><img data-src="//c/d.png" src="data:x"><img src="/a.png">'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "k int, h string")
    got = {r.k: r for r in df.select("k", html.first_date(F.col("h"), F.lit(1_900_000_000_000)).alias("ms"), html.images(F.col("h"), F.lit("https://o")).alias("i"), html.markdown(F.col("h")).alias("m")).collect()}
    assert got[1].ms == 1588723200000 and got[1].i == ["https://o/a.png", "https://c/d.png"] and got[1].m == "## A & b\n\nSee [this](/x) **now**\n\n- one\n- two"
    assert got[2].ms is None and got[2].m is None and got[3].m == "" and got[3].i == []
    u = spark.createDataFrame([("https://www.bilibili.com/video/BV1x?p=2", "BV1x"), ("https://m.bilibili.com/festival?bvid=BV2", "BV2"), ("https://www.bilibili.com/read/cv1?oid=3", None), ("https://a.com/BV1", None), (None, None)], "u string, want string")
    assert all(r.got == r.want for r in u.select("want", urls.bilibili_id(F.col("u")).alias("got")).collect())
    c = spark.createDataFrame([([("a", "1", ".zhihu.com", 0.0), ("b", "2", "zhihu.com", 5.0), ("c", "3", "evil.com", 0.0)], "https://www.zhihu.com/")], "c array<struct<name:string,value:string,domain:string,expires:double>>, u string")
    assert c.select(urls.cookie_header(F.col("c"), F.col("u"), F.lit(10)).alias("h")).first().h == "a=1"


def test_years_and_removal(spark):
    from corvane.operators import graph

    nodes = spark.createDataFrame([("a", 2010), ("b", None), ("c", 2013), ("d", None), ("e", None)], "word string, year int")
    cl = spark.createDataFrame([("a", "c0"), ("b", "c0"), ("c", "c0"), ("d", "c1")], "word string, cluster string")
    assert sorted(tuple(r) for r in graph.filled_years(nodes, cl, 1).collect()) == [("a", 2010, False), ("b", 2012, True), ("c", 2013, False), ("d", 2012, True), ("e", 2012, True)]
    assert {r.year for r in graph.filled_years(nodes.where("year IS NULL"), cl, 1999).collect()} == {1999}
    g = spark.createDataFrame([("k1", ["d1", "d2"]), ("k2", ["d2"]), ("d1", []), ("d2", [])], "id string, doc_ids array<string>")
    e = spark.createDataFrame([("k1", "d1"), ("k1", "d2"), ("k2", "d2")], "src string, dst string")
    left, edges = graph.removed(g, e, "k1")
    assert sorted(r.id for r in left.collect()) == ["d2", "k2"] and [tuple(r) for r in edges.collect()] == [("k2", "d2")]
    pairs = spark.createDataFrame([("a", "b", 1.0)], "word_a string, word_b string, weight double")
    assert graph.isolation(pairs, nodes).first().warn
