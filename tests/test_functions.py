"""Literal cases of functions and operators, nulls, ties and empty inputs among them."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import dates, html, text, urls
from corvane.operators import graph, search, simhash
from corvane.plans import report


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], f"k int, x {kind}")
    return [r.v for r in df.select("k", column(F.col("x")).alias("v")).orderBy("k").collect()]


def test_normalize_url(spark):
    cases = {
        "https://youtu.be/ID?t=3": "https://youtube.com/watch?v=ID",
        "http://www.Twitter.com/a/?utm_source=x": "https://x.com/a",
        "https://m.youtube.com/watch?list=L&v=V&feature=z": "https://youtube.com/watch?list=L&v=V",
        "https://a.com/p//?b=2&a=1&ref=q#frag": "https://a.com/p?a=1&b=2",
        "https://a.com": "https://a.com/",
        "  not a url ": "not a url",
    }
    assert values(spark, urls.normalize_url, [*cases, None]) == [*cases.values(), None]


def test_domains(spark):
    yes = ["https://www.zhihu.com/question/1", "https://zhihu.com/", "https://zhuanlan.zhihu.com/p/1"]
    no = ["https://notzhihu.com/", "https://zhihu.com.evil.com/", "https://zhihu.com.cn/", "https://zhihu.com@evil.com/", "https://evil.com/?u=https://zhihu.com/", "x", None]
    assert values(spark, lambda c: urls.belongs_to(c, "zhihu.com"), yes + no) == [True] * 3 + [False] * 7
    assert values(spark, urls.site_of, [yes[2], "https://mobile.twitter.com/a", no[0], None]) == ["zhihu", "x", "web", "web"]


def test_kinds(spark):
    rows = {"https://www.bilibili.com/video/BV1": "video", "https://www.bilibili.com/read/cv1": "article", "https://space.bilibili.com/1": "unknown", "https://www.bilibili.com/list/1": "unknown", "https://www.youtube.com/watch?v=1": "video", "https://zhihu.com/q": "social", "https://a.com/": "article"}
    assert values(spark, lambda c: urls.content_kind(urls.site_of(c), c), list(rows)) == list(rows.values())


def test_dates(spark):
    now = 1_800_000_000_000
    day = 86_400_000
    cases = {
        "3 天前": now - 3 * day, "2 hours ago": now - 7_200_000, "昨天": now - day, "20260812": 1786492800000, "1700000000": 1700000000000, "1700000000000": 1700000000000,
        "2026-02-30": None, "2026年8月12日 14:30": 1786545000000, "Aug 12, 2026": 1786492800000, "Wed, 12 Aug 2026 10:00:00 GMT": 1786528800000, "1970-01-01": None, "9999-12-31": None,
        "2026": None, "-1": None, "2026-08-12 10:99": None, "2026-08-12T10:00:00+08:00": 1786500000000, "": None,
    }
    assert values(spark, lambda c: dates.to_millis(c, F.lit(now)), [*cases, None]) == [*cases.values(), None]


def test_formats(spark):
    assert values(spark, text.compact_count, [5, 1500, 12_000, 123_456, 250_000_000], "long") == ["5", "1.5k", "1.2万", "12.3万", "2.5亿"]
    assert values(spark, text.duration, [5, 65, 3661], "long") == ["0:05", "1:05", "1:01:01"]
    assert values(spark, text.seconds, ["1:01:01", "1:x", "7"]) == [3661, None, 7]
    assert values(spark, text.normalize_word, ["ＡＢｃ　", None]) == ["ABc", None]
    assert values(spark, text.language, ["", "中文内容", "plain", None]) == ["unknown", "zh", "en", "unknown"]
    assert values(spark, text.count_words, ["两 words 中文", "", None], "string") == [4, 0, None]
    assert values(spark, html.stripped, ["<p>a&amp;b</p><script>x</script> c"]) == ["a&b c"]


def test_boilerplate(spark):
    got = values(spark, text.boilerplate_reason, ["a 3万播放\nb 2播放\nc 1.5亿 播放", "1200万播放 once", "首页 番剧 直播 收藏 稿件 投诉", None])
    assert [g is not None for g in got] == [True, False, True, False]


def test_vtt(spark):
    vtt = "WEBVTT\nKind: captions\n\n1\n00:01.000 --> 00:02.000\nhello\n\n00:02.000 --> 00:03.000\nhello <c>world</c>\n\n00:03.000 --> 00:04.000\nworld\n\nNOTE x\nnext"
    assert values(spark, text.vtt_text, [vtt]) == ["hello world next"]


PLAN = search.Plan("DeepSeek-V4.1-Flash", negatives=("v4.1.7",), related=("MoE",))


def test_relevance(spark):
    assert PLAN.head == "deepseek" and search.Plan("露营装备").head is None
    rows = [("DeepSeek is out", "s", "https://a.com/1"), ("DeepSeek v4.1.7", "s", "https://a.com/1"), ("about moe", "s", "https://a.com/1"), ("Gemini Flash", "s", "https://a.com/1"), ("x", "deepseek", "https://job.b.com/1"), ("某某招标公告", "deepseek", "https://b.com/1"), (None, None, None)]
    df = spark.createDataFrame(rows, "title string, snippet string, url string")
    got = [r.r for r in df.select(search.lexical_relevance(F.col("title"), F.col("snippet"), F.col("url"), PLAN).alias("r")).collect()]
    assert [(g.verdict, round(g.score, 2)) for g in got] == [("likely", 0.9), ("uncertain", 0.35), ("likely", 0.65), ("unlikely", 0.05), ("unlikely", 0.05), ("unlikely", 0.05), ("unlikely", 0.05)]
    assert got[4].reason == "招聘" and got[5].reason == "招标采购"


def test_candidates(spark):
    rows = [("A good title", "s" * 90, "https://a.com/x", "high"), ("登录", "s" * 90, "https://a.com/x", "reject"), ("t", "s", "https://a.com/x", "low"), ("title", "s" * 70, "https://a.com/x", "usable"), ("A good title", "s" * 90, "https://a.com/login", "reject"), (None, None, None, "reject")]
    df = spark.createDataFrame(rows, "t string, s string, u string, want string")
    for r in df.select("want", search.candidate(F.col("t"), F.col("s"), F.col("u"))["tier"].alias("tier")).collect():
        assert r.tier == r.want


def test_fusion_and_backfill(spark):
    rows = [("p0", 1, 1, "u", "first", None), ("p0", 2, 2, "u", "second", "s"), ("p1", 1, 3, "u", "third", "z"), ("p1", 2, 4, "v", "only", None)]
    df = spark.createDataFrame(rows, "provider string, rank int, page_id int, norm_url string, title string, snippet string").withColumn("url", F.col("norm_url")).withColumn("published", F.lit(None).cast("date"))
    got = {r.norm_url: r for r in search.fused(df).collect()}
    assert (got["u"].title, got["u"].snippet, got["u"].hit_count, got["u"].sources) == ("first", "s", 2, ["p0", "p1"])
    assert got["v"].hit_count == 1 and got["v"].snippet is None
    rows = spark.createDataFrame([(1, "a"), (2, "low"), (3, "low"), (4, "low")], "rank int, v string")
    assert sorted(r.rank for r in search.backfilled(rows, F.col("v") == "a", F.col("v") == "low", 3, ["rank"]).collect()) == [1, 2, 3]


def test_prune_and_communities(spark):
    star = [(f"h{k}", "hub", 1.0) for k in range(9)] + [("a", "b", 0.6), ("a", "c", 0.59)]
    kept = graph.pruned(spark.createDataFrame(star, "word_a string, word_b string, weight double")).collect()
    assert len(kept) == 9 and sum(r.word_b == "hub" for r in kept) == 8
    two = [(a, b, 1.0) for g in ("abcd", "wxyz") for a, b in itertools.combinations(g, 2)] + [("a", "w", 0.1)]
    found = graph.louvain(two)
    assert len({found[x] for x in "abcd"}) == 1 and len(set(found.values())) == 2 and graph.louvain([]) == {}


def test_years():
    assert graph.median([2010, 2013]) == 2012 and graph.median([3, 1, 2]) == 2
    assert graph.spread_years(["x", "y", "z"], {"z": 2015}, [("x", "y"), ("y", "z")]) == {"z": 2015, "y": 2015, "x": 2015}


def test_simhash_earliest_copy(spark):
    some = ["", "a", "ünï😀", "模型"]
    assert simhash.fnv1a_all(some).tolist() == [simhash.fnv1a(w) for w in some] and simhash.fnv1a("") == simhash.OFFSET
    r = random.Random(3)
    hashes = []
    for k in range(300):
        h = r.choice(hashes)[1] if hashes and r.random() < 0.6 else r.getrandbits(64)
        for _ in range(r.randint(0, 12)):
            h ^= 1 << r.randrange(64)
        hashes.append((k, h))
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in hashes]
    got = {x.doc_id: x.duplicate_of for x in simhash.first_copies(spark.createDataFrame(signed, "doc_id long, hash long")).collect()}
    want = {}
    for j, h in hashes:
        near = [i for i, g in hashes[:j] if (g ^ h).bit_count() <= 8]
        if near:
            want[j] = near[0]
    assert got == want


def test_simhash_bands_meet_every_pair(spark):
    one_of_each_byte = 0x0101010101010101
    rows = spark.createDataFrame([(1, 0), (2, one_of_each_byte), (3, one_of_each_byte | 2)], "doc_id long, hash long")
    assert {tuple(r) for r in simhash.first_copies(rows).collect()} == {(2, 1), (3, 2)}
    assert sorted(w for _, w in simhash.blocks(9)) == [7] * 8 + [8] and simhash.blocks(1) == [(0, 64)] and simhash.masks(0) == [(1 << 64) - 1]
    r = random.Random(1)
    for spare in (1, 2, 3):
        found = simhash.masks(8, spare)
        flips = [sum(1 << b for b in r.sample(range(64), 8)) for _ in range(200)]
        assert all(any(not m & f for m in found) for f in flips)
        assert {tuple(x) for x in simhash.first_copies(rows, spare=spare).collect()} == {(2, 1), (3, 2)}
    assert [simhash.spare_blocks(n, 8) for n in (10**3, 10**9, 10**11)] == [1, 4, 4] and simhash.spare_blocks(2 * 10**4, 8) == 2
    assert simhash.first_copies(rows, 0).count() == 0


def test_simhash_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LEAST_SLICE", 16)
    monkeypatch.setattr(simhash, "SLICE_ROOT", 0)
    monkeypatch.setattr(simhash, "STEP", 5)
    r = random.Random(5)
    family = [sum(1 << b for b in r.sample(range(64), r.randint(0, 7))) for _ in range(150)]
    hashes = list(enumerate(family + [r.getrandbits(64) for _ in range(50)] + family[:20]))
    r.shuffle(hashes)
    signed = [(k, h - (1 << 64) if h >> 63 else h) for k, h in hashes]
    got = {x.doc_id: x.duplicate_of for x in simhash.first_copies(spark.createDataFrame([*signed, (None, 1)], "doc_id long, hash long")).collect()}
    near = {j: [i for i, g in hashes if i < j and (g ^ h).bit_count() <= 8] for j, h in hashes}
    assert got == {j: min(i) for j, i in near.items() if i}


def test_simhash_moves_no_texts(spark):
    from corvane.queries import QUERIES

    plan = QUERIES["simhash_fingerprints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan


@pytest.mark.parametrize("name", ["duplicate_groups", "independent_sources", "source_list", "report_overview"])
def test_simhash_few_keys_however_many_hashes(spark, monkeypatch, name):
    from corvane.queries import QUERIES

    made, masks = [], simhash.masks
    monkeypatch.setattr(simhash, "spare_blocks", lambda n, distance: 4)  # as if there were many hashes
    monkeypatch.setattr(simhash, "masks", lambda *a: made.append(masks(*a)) or made[-1])
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    assert [len(m) for m in made] == [9]


@pytest.mark.parametrize("name", ["duplicate_groups", "independent_sources"])
def test_simhash_gathers_no_hashes_on_the_driver(spark, name):
    from corvane.queries import QUERIES

    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and plan.split("== Initial Plan ==")[0].count("SortMergeJoin") == 1


def test_simhash_independent(spark):
    rows = [(1, 0), (2, 0), (3, 255), (4, (1 << 12) - 1), (5, -1), (None, 0), (None, 1 << 40)]  # 3 is near 1, 4 near 3 but not near 1
    got = simhash.independent(spark.createDataFrame(rows, "doc_id long, hash long")).first()
    assert (got["independent"], got["copies"]) == (3, 3)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "The GPT模型 alpha 123 alpha中"), (2, None), (3, "")], "doc_id int, text string")
    got = [(r.word, r.tag) for r in graph.tokens(df).orderBy("doc_id", "pos").collect()]
    assert got == [("T模", "n"), ("模型", "n"), ("alpha", "eng"), ("a中", "n")]


def test_concepts_are_as_many_as_keywords(spark):
    few = [(1, "alpha beta"), (2, "beta gamma"), (3, None)]
    for rows in (few, [*few, (4, ""), (5, "gamma delta delta 模型 模型")], [(1, "alpha"), (1, "alpha"), (2, "beta"), (3, "beta"), (4, "")], []):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for most in (60, 1):
            assert graph.concepts(df, most).count() == graph.keywords(df, most).count()


def test_overview_scores_no_words(spark, monkeypatch):
    from corvane.queries import QUERIES

    monkeypatch.setattr(graph, "Corpus", None)
    rows = {r["name"]: r["n"] for r in QUERIES["report_overview"](spark, "/root/testdata/sf0.001").collect()}
    assert rows["concepts"] == 60


def test_grades(spark):
    rows = [("x" * 400, None, "readability", None, True), ("x" * 400, None, "readability", "unlikely", False), ("x" * 400, None, "raw", None, False), ("x" * 200, None, "readability", None, False), (None, "e", "readability", None, False), ("x" * 400, None, "readability", "uncertain", True)]
    df = spark.createDataFrame(rows, "text string, error string, method string, verdict string, want boolean")
    assert all(r.worthy == r.want and (r.reason is None) == r.want for r in report.graded(df).collect())
    empty = df.limit(0).withColumn("published", F.lit(None).cast("date"))
    assert report.quality_summary(empty).first().body_ratio == 0.0


def test_markdown(spark):
    from corvane.sources import tables

    text = report.markdown(tables.documents(spark, "/root/testdata/sf0.001"))
    assert text.startswith("# Report") and "| total |" in text


def test_sources(spark, tmp_path):
    from corvane.sources import tables

    (tmp_path / "f.json").write_text('[{"url": "https://a.com/f", "title": ""}, {"url": "ftp://x"}, {"url": "http://b", "enabled": false}]')
    assert sorted(tuple(r) for r in tables.feeds(spark, str(tmp_path / "f.json")).collect()) == [("http://b", "http://b", False), ("https://a.com/f", "https://a.com/f", True)]
    assert tables.feeds(spark).count() == 6
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.json").write_text('{"id": "1", "updatedAt": "2026"}\n{broken\n{"id": "2", "updatedAt": "2027"}\n')
    assert [r.id for r in tables.sessions(spark, str(tmp_path / "s"), "id string, updatedAt string").collect()] == ["2", "1"]


@pytest.mark.parametrize("k", [0, 1, 7])
def test_chunks(spark, k):
    df = spark.range(k)
    assert search.chunked(df, ["id"], 3).select(F.max("batch")).first()[0] == (None if k == 0 else (k - 1) // 3)
