"""Every query that has SQL gives the same rows as DuckDB."""

from __future__ import annotations

import pytest

from corvane.oracles import ORACLES
from corvane.plans import report
from corvane.queries import QUERIES
from tests.parity import FOLDER, compare


def test_oracles_are_of_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_parity(spark, name):
    compare(spark, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_source_list_keeps_what_was_not_fetched(spark):
    results = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (9, "d")], "doc_id long, title string")
    docs = spark.createDataFrame([(1, "A", "full", 90), (2, "B", "thin", 40), (3, None, "snippet", 0)], "doc_id long, title string, grade string, word_count long")
    copies = spark.createDataFrame([(2, 1), (3, 77)], "doc_id long, duplicate_of long")
    assert {r.doc_id: r.body for r in report.sources(results, docs, copies).collect()} == {1: "正文完整 90 字", 2: "正文很短 40 字 · 与《A》同源", 3: "仅摘要 0 字 · 与《…》同源", 9: "未抓取"}


def test_source_list_moves_no_texts(spark):
    plan = QUERIES["source_list"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "quality" not in plan and "LeftSemi" in plan


def test_titles_with_references(spark, tmp_path):
    titles = ["a &quot;b&quot; &amp; c", "&nbsp;&lt;x&gt; &#39;y&#39;", "&amp;quot; &amp;amp; & &", "plain  title "]
    rows = [(k, f"https://a.example.net/{k}", f"<html><title>{t}</title><body>text</body></html>") for k, t in enumerate(titles, 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    compare(spark, QUERIES["bilibili_results"], ORACLES["bilibili_results"], str(tmp_path))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 60
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
