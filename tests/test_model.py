"""Answers of a model, documents from candidates, and views: cases the tables do not have."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from corvane.functions import html, misc, model, plan, text
from corvane.operators import model_graph, refine, staging
from corvane.plans import views
from corvane.sources import tables
from corvane.streaming import events


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_unfenced(spark):
    rows = spark.createDataFrame([(" {} ",), ("```json\n{}\n```",), ("```\n{}\n```  ",), ("{} ```",), (None,)], "t string")
    assert [r.v for r in rows.select(model.unfenced(F.col("t")).alias("v")).collect()] == ["{}", "{}", "{}", "{} ```", None]


DOCS = [("t", 10, 0, "A", 9), ("t", 11, 1, "B", 99), ("t", 12, None, "C", 0), ("u", 13, 0, "D", 5)]


def _graph(spark, answer):
    docs = spark.createDataFrame(DOCS, "topic string, doc_id long, nth int, title string, word_count long")
    nodes, edges, clusters = model_graph.assembled(spark.createDataFrame([("t", answer)], "topic string, json string"), docs)
    return {(r.topic, r.id): r for r in nodes.collect()}, edges.collect(), {(r.topic, r.cluster): r for r in clusters.collect()}


def test_graph_of_an_answer(spark):
    answer = {
        "entities": [
            {"name": " x ", "type": "技术", "aliases": ["x", "ex"], "docIndices": [1, 7, -1]}, {"name": "x", "type": "人物", "aliases": ["EX", "ex"], "docIndices": [0, 1]},
            {"name": "", "type": "技术", "aliases": [], "docIndices": [0]}, {"name": "y", "type": "产品", "aliases": [], "docIndices": [1]}, {"name": "z", "type": "产品", "aliases": [], "docIndices": []},
        ],
        "relations": [
            {"source": "x", "target": " y", "label": " ", "weight": 7, "docIndices": [0, 0, 5]}, {"source": "x", "target": "x", "label": "self", "weight": 1, "docIndices": []},
            {"source": "x", "target": "gone", "label": "no", "weight": 1, "docIndices": []},
        ],
        "clusters": [{"label": " ", "summary": "", "entities": ["nobody"], "docIndices": [9]}, {"label": "two", "summary": "", "entities": ["x"], "docIndices": [1]}, {"label": "three", "summary": "", "entities": ["x"], "docIndices": [1]}],
    }
    nodes, edges, clusters = _graph(spark, json.dumps(answer))
    x = nodes["t", "k:x"]
    assert (x.type, x.aliases, x.weight, x.degree, x.cluster) == ("技术", ["EX", "ex"], 2.0, 3, "c1")
    assert nodes["t", "k:y"].cluster == "c1"  # where its document is
    assert nodes["t", "k:z"].cluster == "c3" and nodes["t", "d:10"].cluster == "c3"  # what is left
    assert nodes["t", "d:12"].cluster == "c0"  # not shown to the model
    assert nodes["u", "d:13"].cluster == "c0"  # no answer
    relation = [e for e in edges if e.kind == "relation"]
    assert [(e.src, e.dst, e.label, e.weight, e.evidence) for e in relation] == [("k:x", "k:y", None, 1.0, ["10"])]
    assert {(c, r.label, r.size, r.top_terms) for (t, c), r in clusters.items() if t == "t"} == {("c0", "主题 1", 1, ""), ("c1", "two", 3, "x,y"), ("c3", "其他", 2, "z")}


def test_graph_of_no_answer(spark):
    nodes, edges, clusters = _graph(spark, "sorry, no")
    assert {r.kind for r in nodes.values()} == {"document"} and len(nodes) == 4 and not edges
    assert {(t, c) for t, c in clusters} == {("t", "c0"), ("u", "c0")}


def test_judged_clamps_and_drops(spark):
    rows = model.batched(spark.createDataFrame([("q", k) for k in range(5)], "query string, id int"), "id", 2, 4)
    assert [(r.id, r.batch, r.nth) for r in rows.orderBy("id").collect()] == [(0, 0, 0), (1, 0, 1), (2, 1, 0), (3, 1, 1)]
    said = [{"index": 0, "verdict": "likely", "score": 3, "match": "m", "reason": ""}, {"index": 9, "verdict": "likely", "score": 0, "match": "m", "reason": "r"}]
    answers = spark.createDataFrame([("q", 0, "no"), ("q", 1, json.dumps({"verdicts": said}))], "query string, batch int, json string")
    assert [(r.id, r.verdict, r.score, r.reason) for r in model.judged(rows, answers).collect()] == [(2, "likely", 1.0, model.NO_REASON)]
    assert model.valued(rows, answers).count() == 0


def test_first_found_never_loses_a_row(spark):
    rows = spark.createDataFrame([("a", "b", "s", "e"), (" ", "b", "s", "e"), (None, None, "s", "e"), (None, "", None, None)], "a string, b string, s string, e string")
    found = rows.select(staging.first_found([("one", F.col("a")), ("two", F.col("b"))], F.col("s"), F.col("e")).alias("f")).select("f.*")
    assert [tuple(r) for r in found.collect()] == [("a", "one", None), ("b", "two", None), ("s", "raw", "e"), ("", "raw", "unknown")]


def test_modes_of_the_browser(spark):
    t, n = F.lit(True), F.lit(None).cast("boolean")
    assert _value(spark, F.array(staging.wants_browser("always", n, F.lit("web"), n), staging.wants_browser("on-demand", n, F.lit("web"), n), staging.wants_browser("off", t, F.lit("zhihu"), t))) == [True, False, False]
    assert _value(spark, F.array(staging.worth_retry("always", n), staging.worth_retry("on-demand", n), staging.worth_retry("off", t))) == [True, False, False]


def test_topic_sources_have_a_budget(spark):
    rows = spark.createDataFrame([(1, "site", 100), (1, "topic", 7000), (1, "topic", 9000), (2, "site", 9500), (2, "topic", 9000), (3, "topic", 9000)], "query int, scope string, ms int")
    assert sorted((r.query, r.ms) for r in staging.in_time(rows).collect()) == [(1, 100), (1, 7000), (2, 9000), (2, 9500)]


def test_view_state_keeps_known_fields_only(spark):
    raw = json.dumps({"positions": {"a": {"x": 1, "y": 2}, "b": {"x": 2e6, "y": 0}, "c": {"x": 1}}, "pinned": ["p", "x" * 200], "layoutMode": "spiral", "hiddenEdgeKinds": ["relation", "other"], "hiddenNodeTypes": ["t", "y" * 50]})
    s = _value(spark, views.view_state(F.lit(raw)))
    assert (set(s.positions), s.pinned, s.layout, s.hidden_kinds, s.hidden_types, s.show_documents) == ({"a"}, ["p"], None, ["relation"], ["t"], None)
    assert _value(spark, views.view_state(F.lit("[1]"))) is None and _value(spark, views.view_state(F.lit("x"))) is None


def test_emphasis_needs_a_node(spark):
    nodes, edges = spark.createDataFrame([("a",), ("b",), ("c",)], "id string"), spark.createDataFrame([("a", "b")], "src string, dst string")
    assert {r.id: r.near for r in views.emphasised(nodes, edges, "b").collect()} == {"a": True, "b": True, "c": False}
    assert {r.near for r in views.emphasised(nodes, edges, "z").collect()} == {r.near for r in views.emphasised(nodes, edges, None).collect()} == {None}


def test_escapes(spark):
    t = F.lit('a|b [c] \\ "d"\r\n e')
    assert _value(spark, text.table_cell(t)) == 'a\\|b [c] \\ "d"  e'
    assert _value(spark, text.link_text(t)) == 'a|b \\[c\\] \\\\ "d"  e'
    assert _value(spark, text.diagram_text(t)) == "a|b (c) \\ d  e"
    assert _value(spark, text.quoted_line(F.lit(" x \n\n y" + "z" * 400))) == "x y" + "z" * 297 + "…"
    assert _value(spark, text.report_file(F.lit(' a/b:"c" '), F.lit("2026-03-04 05:06:00").cast("timestamp"))) == "abc-20260304-0506.md"
    assert _value(spark, text.label(F.lit("full"), "grade")) == "正文完整" and _value(spark, text.label(F.lit("other"), "grade")) == "other"


def test_limitations_by_site(spark):
    rows = spark.createDataFrame([("zhihu", "HTTP 401", False), ("zhihu", "HTTP 500", False), ("bilibili", "HTTP 412", None), ("youtube", "you are not a bot?", True), ("web", "HTTP 403", False), ("x", None, False)], "site string, error string, known boolean")
    said = [r.v for r in rows.select(misc.known_limitation(F.col("site"), F.col("error"), F.col("known")).alias("v")).collect()]
    assert [x is not None for x in said] == [True, False, True, True, False, False]
    assert said[0].startswith("已知限制（不是故障）：HTTP 403 —— ") and said[3].endswith("（you are not a bot?）")


def test_feeds_are_written_whole_or_not_at_all(spark, tmp_path):
    at = str(tmp_path / "feeds")
    tables.save_feeds(spark.createDataFrame([(" ", " HTTPS://a ", None)], tables.FEED), at)
    assert [tuple(r) for r in tables.feeds(spark, at).collect()] == [("HTTPS://a", "HTTPS://a", True)]
    with pytest.raises(ValueError):
        tables.save_feeds(spark.createDataFrame([("t", "https://b", True), ("t", "file:///x", True)], tables.FEED), at)
    assert tables.feeds(spark, at).count() == 1
    (tmp_path / "f.json").write_text(json.dumps({"feeds": [{"url": "http://c", "enabled": False}, {"title": "no url"}]}))
    assert [tuple(r) for r in tables.feeds(spark, str(tmp_path / "f.json")).collect()] == [("http://c", "http://c", False)]
    assert tables.deleted(spark, at) and not tables.deleted(spark, at)


def test_rounds_end_when_nothing_is_added(spark):
    shape = "norm_url string, title string, snippet string, value string"
    pages = {0: [("a", "t", "s", None), ("b", "bad one", "s", None), ("c", "bad two", "s", "high")], 1: [("b", "t", "s", None)]}
    asked = []

    def search(intent, state):
        asked.append(intent)
        return spark.createDataFrame(pages[state.rounds], shape), ["term"]

    analyse = lambda results, state: refine.Analysis(missing=("m",), queries=tuple("q%d" % k for k in range(9)), patterns=(" bad ", "z"))
    results, state = refine.refined(spark.createDataFrame([("a", "old", "s", None)], shape), refine.State("goal"), analyse, search, 5)
    assert sorted((r.norm_url, r.title, r.value) for r in results.collect()) == [("a", "old", None), ("b", "bad one", "low"), ("c", "bad two", "high")]
    assert len(asked) == state.rounds == 2 and asked[0].startswith("goal；m；q0；")
    assert state.terms == ("term", "q0", "q1", "q2", "q3") and state.patterns == ("bad", "bad")


def test_buttons_are_no_text(spark):
    assert _value(spark, html.cleaned(F.lit(" a \t b \r\n\r\n 分享 \n\n\n\n c 分享\n 收起"))) == "a b\n\n\nc 分享"


def test_builders_fall_back_with_a_reason(spark):
    def broken():
        raise RuntimeError("HTTP 429 slow down")

    assert model_graph.built(None, lambda: ("plain",)) == (("plain",), "heuristic", None)
    assert model_graph.built(None, lambda: ("plain",), "llm") == (("plain",), "heuristic", "未配置 LLM_API_KEY")
    assert model_graph.built(lambda: ("model",), lambda: ("plain",)) == (("model",), "llm", None)
    assert model_graph.built(lambda: ("model",), lambda: ("plain",), "heuristic")[1] == "heuristic"
    assert model_graph.built(broken, lambda: ("plain",)) == (("plain",), "heuristic", model.LIMITED + "HTTP 429 slow down")


def test_sites_of(spark):
    assert plan.sites_of(("web", "arxiv", "nowhere")) == ["arxiv", "web"]
    assert plan.sites_of(direct=True) == ["hackernews", "github", "arxiv", "rss"] and "x" not in plan.sites_of()


def test_a_batch_tried_again_changes_nothing(spark, tmp_path):
    run = events.upserting(str(tmp_path), "k", "seq")
    one, two = (spark.createDataFrame(rows, "k int, seq int, v string") for rows in ([(1, 1, "a"), (2, 1, "b")], [(1, 2, "c"), (2, 0, "old")]))
    run(one, 0)
    run(two, 1)
    run(two, 1)  # after its version was named already
    assert sorted(tuple(r) for r in events.current(spark, str(tmp_path)).collect()) == [(1, 2, "c"), (2, 1, "b")]
