"""Operators on odd cases, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import components as comp
from corvane.llm import decontaminate, near_dup, quality, rules, sharding, substrings, url_filter
from tests.llm.cases import documents, rows_of

SPACE = re.compile("[\x20\x09-\x0d]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.component for x in comp.components(spark.createDataFrame([*edges, (None, 1), (7, None)], "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert comp.components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_rules(spark, docs):
    got = Counter()
    for r in rules.judged(rules.ledger(rules.measured(docs)), rules.WEB_V1).collect():
        got[tuple(r[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))] += 1
    want = Counter()
    for i, t in rows_of(docs):
        w = split(t)
        grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        hit = {k + j for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if split(x)]
        want[(i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w))] += 1
    assert got == want


def test_rule_policies(spark, docs):
    ledger = rules.ledger(rules.measured(docs)).cache()
    rows = ledger.collect()
    assert all(not r.kept or not r.base_failed for r in rules.judged(ledger, rules.WEB_V2).collect())
    for r in rules.ablations(ledger, rules.WEB_V2).collect():
        bit = 1 << rules.BITS[r.rule]
        assert r.n_failed == sum(bool(x.failed_bits & bit) for x in rows) and r.n_only == sum(x.failed_bits == bit for x in rows)
    assert rules.ablations(ledger.limit(0), rules.BASE).agg(F.sum("n_failed")).first()[0] == 0


def test_ablations_with_tolerated_rules(spark):
    bits = lambda *names: sum(1 << rules.BITS[n] for n in names)
    failed = [bits(), bits("symbols"), bits("symbols", "short_mean_word"), bits("symbols", "short_mean_word", "duplicate_lines"), bits("short_mean_word", "duplicate_lines"), bits("duplicate_lines"), bits("too_few_words"), bits("too_few_words", "exclamations")]
    df = spark.createDataFrame([(x,) for x in failed], "failed_bits long")
    got = {r.rule: (r.n_failed, r.n_only, r.n_stay) for r in rules.ablations(df, rules.WEB_V1).collect()}
    assert got == {"too_few_words": (2, 1, 1), "repeated_words": (0, 0, 0), "too_many_words": (0, 0, 0), "symbols": (3, 1, 2), "exclamations": (1, 0, 0), "short_mean_word": (3, 0, 1), "long_mean_word": (0, 0, 0), "duplicate_lines": (3, 1, 1)}


def _classes_by_hand(rows, percent):
    """For each row its set of shingles and the rows it reaches."""
    sets = []
    for _, t in rows:
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    reached = defaultdict(list)
    for k in range(len(rows)):
        reached[find(k)].append(k)
    return sets, [reached[find(k)] for k in range(len(rows))]


def _near_by_hand(spark, rows, settings):
    sets, reached = _classes_by_hand(rows, settings.percent)
    want = Counter()
    for k, (i, _) in enumerate(rows):
        top = min((rows[x][0] for x in reached[k] if rows[x][0] is not None), default=None)
        want[(i, len(sets[k]), top, i == top)] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(map(tuple, near_dup.near_duplicates(df, settings).collect())) == want
    left = Counter(map(tuple, near_dup.deduplicated(df, settings).collect()))
    for k in range(len(rows)):
        mine = {rows[x] for x in reached[k]}
        stay = [r for r in mine if left[r]]
        first = min(mine, key=lambda r: (r[0] is None, r[0] or 0))
        assert len(stay) == 1 and stay[0][0] == first[0] and left[stay[0]] == rows.count(stay[0])


def test_near_duplicates(spark, docs):
    for settings in (near_dup.AT_85, near_dup.AT_80):
        _near_by_hand(spark, rows_of(docs), settings)
    assert near_dup.deduplicated(docs).columns == docs.columns
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_with_shared_and_null_ids(spark):
    r = random.Random(11)
    new = lambda n: " ".join(f"n{r.randrange(10**9)}" for _ in range(n))
    a, b, c = new(60), new(80), new(50)
    rows = [(7, a), (7, b), (3, b + " tail"), (7, new(9)), (None, a + " more"), (None, c), (None, c + " end"), (7, a), (9, "short"), (9, "short"), (None, None), (8, ""), (2, c.upper()), (None, new(30)), (7, b)]
    _near_by_hand(spark, rows, near_dup.AT_85)


def test_two_families_of_near_copies(spark):
    """Families that share buckets but no link: the candidates grow with the members, not with their pairs."""
    compared = []
    was = near_dup._compared

    def counted(pairs, sets):
        compared.append(pairs.count())
        return was(pairs, sets)

    near_dup._compared = counted
    try:
        for g in (40, 80):
            r = random.Random(13)
            base = [f"c{r.randrange(10**9)}" for _ in range(300)]
            rows = []
            for f in range(2):
                mine = base[:255] + [f"f{f}-{k}" for k in range(45)]
                for k in range(g):
                    one = list(mine)
                    one[(7 * k) % 250] = f"e{k % 4}"
                    rows.append((1000 * f + k, " ".join(one)))
            compared.clear()
            got = {x.doc_id: x.component_id for x in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
            assert got == {i: i // 1000 * 1000 for i, _ in rows}
            assert sum(compared) < 30 * 2 * g
    finally:
        near_dup._compared = was


@pytest.mark.parametrize("settings", [near_dup.AT_85, near_dup.AT_80])
def test_signatures_of_pairs_at_the_threshold_share_a_band(settings):
    r, hasher = np.random.default_rng(settings.percent), near_dup.CirculantMinHash(settings)
    missed = 0
    for _ in range(1500):
        n = int(r.integers(20, 400))
        both = -(-settings.percent * 2 * n // (100 + settings.percent))
        a = r.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        missed += not np.intersect1d(hasher.band_keys(np.unique(a[:n])), hasher.band_keys(np.unique(a[n - both :]))).size
    assert missed == 0


def test_near_duplicates_without_a_hub(spark):
    """A chain of small steps: the first of a bucket is similar to few of its members."""
    r = random.Random(9)
    text = [f"v{k}" for k in range(400)]
    rows = []
    for k in range(60):
        for _ in range(3):
            text[r.randrange(400)] = f"n{k}-{r.random()}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(396)} for _, t in rows]
    assert all(len(a & b) >= 0.85 * len(a | b) for a, b in pairwise(sets)) and len(sets[0] & sets[-1]) < 0.5 * len(sets[0] | sets[-1])
    assert {r.component_id for r in near_dup.near_duplicates(df).collect()} == {0}


def _removed(before: str | None, after: str | None) -> list[bool]:
    """Which words of a text are gone, what is left being the others in order."""
    left, gone = iter([*split(after), None]), []
    here = next(left)
    for w in split(before):
        gone.append(w != here)
        if w == here:
            here = next(left)
    assert here is None
    return gone


def _cut_by_hand(rows: list[tuple]) -> None:
    """Words cut from texts (id, text, text left) lie in 20 words that an earlier document holds, and long such runs are cut.

    Only words are looked at, not chunks. The edges of a run may stay: up to 24 words,
    where chunks end that are not the run's alone.
    """
    rows = sorted({r for r in rows if r[1] is not None}, key=lambda r: (r[0] is None, r[0] or 0))
    seen: dict[tuple, set] = defaultdict(set)
    for i, t, left in rows:
        w = split(t)
        earlier = [False] * len(w)
        for k in range(len(w) - 19):
            if seen[tuple(w[k : k + 20])] - {(i, t)}:
                earlier[k : k + 20] = [True] * 20
        gone = _removed(t, left)
        assert all(e or not g for e, g in zip(earlier, gone, strict=True)), i
        run = 0
        for k in range(len(w) + 1):
            if k < len(w) and earlier[k]:
                run += 1
            else:
                assert all(gone[k - run : k][24:-24]) or len(set(w[k - run : k])) < run, i
                run = 0
        if i is not None or len([r for r in rows if r[0] is None]) == 1:
            for k in range(len(w) - 19):
                seen[tuple(w[k : k + 20])].add((i, t))


def test_substrings(spark, docs):
    out = substrings.deduplicated(docs)
    assert out.columns == docs.columns
    left = {(r.doc_id, r.id): r.text for r in out.collect()}
    rows = [(r.doc_id, r.text, left[r.doc_id, r.id]) for r in docs.collect()]
    _cut_by_hand(rows)
    assert all((t is None) == (x is None) and (x == t or len(split(x)) < len(split(t))) for _, t, x in rows)
    found = {r.doc_id: r for r in substrings.report(docs).collect()}
    for i, t, x in rows:
        n = sum(_removed(t, x))
        assert (found[i].n_removed_words, found[i].has_repeats, found[i].text_sha256) == (n, n > 0, hashlib.sha256((x or "").encode()).hexdigest())
    assert sum(t != x for _, t, x in rows) >= 15
    assert substrings.report(docs.limit(0)).count() == 0 and substrings.deduplicated(docs.limit(0)).columns == docs.columns


def test_substrings_do_not_join_passages(spark):
    """A and B stand together nowhere else, and neither is long enough alone; what a text repeats of itself stays."""
    r = random.Random(5)
    new = lambda n: " ".join(f"n{r.randrange(10**9)}" for _ in range(n))
    for _ in range(40):
        a, b, own = new(14), new(14), new(60)
        rows = [(0, f"{new(30)} {a} {new(30)}"), (1, f"{new(30)} {b} {new(30)}"), (2, f"{new(5)} {a} {b} {new(5)}"), (3, f"{own} {own}"), (4, "tok " * 300)]
        if _ == 0:
            df = spark.createDataFrame(rows, "doc_id long, text string")
            assert sorted(map(tuple, substrings.deduplicated(df).collect())) == sorted(rows)
        found = [substrings.chunks_of(t) for _, t in rows[:3]]
        runs = {tuple(w for c in x[k:j] for w in c) for x in found[:2] for k in range(len(x)) for j in range(k + 1, len(x) + 1)}
        assert not any(tuple(w for c in found[2][k:j] for w in c) in runs for k in range(len(found[2])) for j in range(k + 1, len(found[2]) + 1) if sum(map(len, found[2][k:j])) >= 20)


def test_substrings_of_rows_with_shared_and_null_ids(spark):
    r = random.Random(6)
    new = lambda n: " ".join(f"n{r.randrange(10**9)}" for _ in range(n))
    passage = new(60)
    rows = [(1, f"{new(9)} {passage}"), (2, "short one"), (2, f"{new(40)} {passage} {new(3)}"), (2, new(90)), (None, f"{passage} {new(7)}"), (None, "another"), (None, None), (3, None), (3, ""), (1, "x"), (4, passage), (4, passage), (None, f"{passage} {new(7)}")]
    left = substrings.deduplicated(spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "n int, doc_id long, text string")).collect()
    assert len(left) == len(rows)
    for x in left:
        i, t = rows[x.n]
        assert x.doc_id == i and (x.text is None) == (t is None)
        if t and passage in t and x.n:
            assert 20 <= sum(_removed(t, x.text)) <= 60
        else:
            assert x.text == t
    once = spark.createDataFrame([(1, passage)] * 3, "doc_id long, text string")
    assert {x.text for x in substrings.deduplicated(once).collect()} == {passage}


def test_chunks_resist_shifts():
    r = random.Random(4)
    for _ in range(50):
        passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(52))
        a, b = (" ".join(f"q{r.randrange(10**6)}" for _ in range(r.randint(0, 40))) for _ in range(2))
        here, there = substrings.chunks_of(f"{a} {passage} {b}"), set(substrings.chunks_of(f"{b} {passage} {a}"))
        assert sum(len(c) for c in here if c in there) >= 20


def test_decontamination(spark, docs):
    texts = dict(rows_of(docs))
    items = [(1, " ".join(texts[0].split()[20:45])), (2, "One"), (3, None), (4, "..."), (None, texts[0]), (5, texts[16].upper()), (6, "tok TOK tok"), (7, " ".join(texts[0].split()[30:41])), (8, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = Counter()
    for i, t in rows_of(docs):
        w, hit, of = find(t), set(), set()
        for item, text in items:
            x = find(text)
            if item is None or not x:
                continue
            n = min(10, len(x))
            for g in {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == g:
                        hit |= set(range(k, k + n))
                        of.add(item)
        want[(i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit))] += 1
    got = Counter(tuple(r)[:6] for r in decontaminate.report(docs, bench).collect())
    assert got == want and sum(x[5] for x in want) > 8
    assert decontaminate.clean(docs, bench).count() == sum(n for x, n in want.items() if not x[5])
    assert decontaminate.report(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def _passages(spark):
    """Two passages, a benchmark of one block each, and rows of which many share an id or have none."""
    a, b = (" ".join(f"{x}{k}" for k in range(12)) for x in "ab")
    texts = [f"x {a}", f"y y {b}", f"{a} {b}", "clean one", f"z {b}", None, "clean two", f"{a} again {a}"]
    rows = [(None if k % 3 == 0 else 7, f"{t} {k}" if t else None) for k, t in enumerate(texts * 3)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, a), (2, b), (3, "not there at all")], "item_id long, text string")


def test_decontamination_with_shared_and_null_ids(spark, docs):
    rows, bench = _passages(spark)
    got = Counter((r.key, r.n_words, tuple(r.hit_words), tuple(r.item_ids)) for r in decontaminate.contaminated(rows, bench).collect())
    want = Counter()
    for i, t in rows_of(rows):
        w = (t or "").split()
        hit = [k for k, x in enumerate(w) if x[0] in "ab" and x[1:].isdigit()]
        want[(i, len(w), tuple(hit), tuple(k for k, x in ((1, "a0"), (2, "b0")) if x in w))] += 1
    assert got == want and sum(n for x, n in got.items() if len(x[3]) == 2) == 3
    assert decontaminate.contaminated(docs.select("doc_id", "text").unionAll(rows), bench).count() == docs.count() + rows.count()


def test_decontamination_of_a_large_benchmark(spark):
    """With a sieve that almost everything passes the result is the same."""
    r = random.Random(8)
    some = [f"v{k}" for k in range(30)]
    text = lambda n: " ".join(r.choice(some) for _ in range(n))
    items = [(k, text(r.randint(1, 14)) if k % 3 else text(60)) for k in range(300)]
    rows = [(k, f"{text(r.randint(0, 40))} {items[r.randrange(300)][1]} {text(3)}") for k in range(80)]
    df, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    of = lambda bits: {x.key: (x.hit_words, x.item_ids) for x in decontaminate.contaminated(df, bench, sieve_bits=bits).collect()}
    want = {}
    grams = {(k, tuple(x[j : j + n])) for k, t in items for x in [t.split()] for n in [min(10, len(x))] for j in range(len(x) - n + 1)}
    for i, t in rows:
        w, hit, found = t.split(), set(), set()
        for k, g in grams:
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit |= set(range(j, j + len(g)))
                    found.add(k)
        want[i] = (sorted(hit), sorted(found))
    assert of(decontaminate.SIEVE_BITS) == of(8) == want


def test_clean_judges_each_row(spark):
    rows, bench = _passages(spark)
    left = Counter(map(tuple, decontaminate.clean(rows.withColumn("n", F.lit(1)), bench).drop("n").collect()))
    assert left == Counter(tuple(r) for r in rows.collect() if "a0" not in (r.text or "") and "b0" not in (r.text or ""))
    assert {i for i, _ in left} == {None, 7}


@pytest.mark.parametrize("shards", [8, 3])
def test_sharding(spark, docs, shards):
    out = sharding.sharded(docs, shards).collect()
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows_of(docs))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == texts
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == shards
    assert out and sharding.sharded(docs, shards).orderBy("doc_id").collect() == sharding.sharded(docs.repartition(5), shards).orderBy("doc_id").collect()


def test_buckets_of_ranks_change_no_result(spark, docs, monkeypatch):
    rows = docs.select("doc_id", "source", F.lit(1).alias("shard"))
    of = lambda: sorted(map(str, sharding.interleave(rows, "doc_id", "source", 17, 5).collect()))
    first = of()
    monkeypatch.setattr(sharding, "MOST_ROWS", 0)
    assert sharding._digits(61) == 5 and of() == first
    assert sharding.interleave(rows, "doc_id", "source", 17, 5).columns == ["doc_id", "source", "shard", "slot"]


def test_sharding_keeps_the_mixture(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"), F.lit("x").alias("text"))
    got = sharding.sharded(df).join(df, "doc_id").groupBy("shard").agg(F.count_if(F.col("source") == "hot").alias("n")).collect()
    assert max(r.n for r in got) - min(r.n for r in got) <= 2
    assert sharding.sharded(df.limit(0)).count() == 0
    assert sharding.sharded(spark.createDataFrame([(1, None, None)] * 3, "doc_id long, source string, text string")).count() == 3


def test_url_filter(spark):
    pages = [
        (1, "https://a.example.org/x", '<link rel="canonical" href="https://b.net/y">'), (2, "http://c.example.org/z#frag", "<meta http-equiv=refresh content='0; url=https://a.example.org/x'>"),
        (3, "https://org/fr/1", "<LINK href='//d.example.org/q' REL=canonical>"), (4, "https://d.example.org/q", '<link rel="canonical" href="https://x.net/">'), (5, None, None), (6, "no url", "<p>"),
        (7, "HTTPS://EXAMPLE.net/en/A?q#f", None), (8, "https://notexample.com/de/", None), (9, "https://w.example.com/de/", None), (10, "https://example.com", None), (11, "https://net", None),
        (12, "https://e.example.org/1", '<link rel=canonical href="/2">'), (13, "https://e.example.org/2", ""), (1, "https://a.example.org/x", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    got = {(r.page_id, r.rule): (r.host, r.path, r.verdict, r.via) for r in url_filter.judged(df).collect()}
    assert got == {
        (1, None): ("a.example.org", "/x", "block", "alias"), (2, None): ("c.example.org", "/z", "block", "alias"), (3, "org/fr/"): ("org", "/fr/1", "allow", "rule"), (4, None): ("d.example.org", "/q", "allow", "alias"),
        (5, None): ("", "", "allow", "default"), (6, None): ("", "", "allow", "default"), (7, "example.net/en/"): ("example.net", "/en/A", "allow", "rule"), (8, None): ("notexample.com", "/de/", "allow", "default"),
        (9, "example.com/de/"): ("w.example.com", "/de/", "block", "rule"), (10, None): ("example.com", "", "allow", "default"), (11, None): ("net", "", "allow", "default"), (12, None): ("e.example.org", "/1", "allow", "default"), (13, None): ("e.example.org", "/2", "allow", "default"),
    }
    table = spark.createDataFrame([tuple(r) for r in url_filter.RULES], "action string, host string, path string")
    assert {(r.page_id, r.rule, r.verdict) for r in url_filter.judged(df, table).collect()} == {(i, rule, v[2]) for (i, rule), v in got.items()}
    assert url_filter.judged(df).count() == len(pages) and url_filter.judged(df.limit(0)).count() == 0


def test_url_filter_resolves_targets(spark):
    refresh = lambda content: f"<meta http-equiv='refresh' content={content}>"
    cases = [
        ("https://a.test/d/p", refresh('"0; url=new/a.html"'), "https://a.test/d/new/a.html"), ("https://a.test/d/p", "<link rel=canonical href='../x'>", "https://a.test/x"),
        ("https://a.test/d/p?q#f", '<link rel="canonical" href="?p=2">', "https://a.test/d/p?p=2"), ("https://a.test/", refresh("\"0;URL='https://x.net/'\""), "https://x.net/"),
        ("https://a.test/", refresh("'0; url=\"https://x.net/1\"'"), "https://x.net/1"), ("https://a.test/", refresh("0;url=/2"), "https://a.test/2"), ("https://A.test/Q", "<link rel=canonical href='HTTPS://X.Net/Up?a=1&amp;b=2&copy=3#f'>", "https://x.net/Up?a=1&b=2&copy=3"),
        ("https://Me@A.test/", '<link rel=canonical href="//B.test">', "https://b.test"), ("https://a.test/", refresh('"0;url="') + "/>", None), ("https://a.test/", "<link rel=canonical href='javascript:x'>", None), ("no url", "<link rel=canonical href=x>", None), ("https://[a/", "<link rel=canonical href='y'>", None),
    ]
    for url, html, to in cases:
        got = [r.v for r in url_filter.alias_edges(spark.createDataFrame([(url, html)], "url string, html string")).collect()]
        assert got == ([to] if to else []), html
    several = "<link rel=canonical href=/1><link href='/2' rel=canonical>" + refresh("'0;url=/3'") + refresh('"0;url=/4"') + "<link rel=canonical href=/1>"
    got = {r.v for r in url_filter.alias_edges(spark.createDataFrame([("https://a.test/", several)], "url string, html string")).collect()}
    assert got == {f"https://a.test/{k}" for k in (1, 2, 3, 4)}
    pages = spark.createDataFrame([(1, "https://A.test/d/p", refresh("\"0;URL='https://b.test/?a=1&amp;b=2'\"")), (2, "https://B.test/?a=1&b=2", "<link rel=canonical href='https://X.net/'>"), (3, "https://a.test/d/q", "<link rel=canonical href='p'>")], "page_id long, url string, html string")
    assert {(r.page_id, r.verdict, r.via) for r in url_filter.judged(pages).collect()} == {(k, "block", "alias") for k in (1, 2, 3)}


def test_quality(spark, docs):
    r = random.Random(3)
    rows, labels = [], []
    for k in range(400):
        good = r.random() < 0.7
        w = [f"w{r.randrange(3000)}" for _ in range(r.randint(10, 80))]
        rows.append((k, " ".join(w) if good else " ".join(x + "***" for x in w)))
        labels.append((k, int(good)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, quality int")
    out = quality.scored(df, lab).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in out)
    held = [x for x in out if x.held_out]
    assert sum(x.predicted == labels[x.doc_id][1] for x in held) >= 0.97 * len(held) > 0
    odd = quality.scored(docs, lab.limit(0)).collect()
    assert len(odd) == docs.count() and all(x.score == 0.3 and x.predicted == 1 for x in odd)
    model = quality.Model((0.0,) * len(quality.FEATURES))
    assert all(0 <= x.score <= 1 for x in quality.scored(docs, lab, model=model).collect())
    kept = quality.accepted(df, lab)
    assert kept.columns == df.columns and kept.count() == sum(x.predicted for x in out)
    assert quality.scored(docs.limit(0), lab).count() == 0


def test_quality_judges_each_row(spark):
    """A bad text takes no other with it, whether they share an id or have none."""
    r = random.Random(4)
    good = lambda: " ".join(f"w{r.randrange(3000)}" for _ in range(40))
    bad = lambda: " ".join(f"w{r.randrange(3000)}***" for _ in range(40))
    rows = [(k, good() if k % 3 else bad(), "x") for k in range(300)] + [(None, good(), "good"), (None, bad(), "bad"), (1, bad(), "bad"), (1, good(), "good"), (None, good(), "good")]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(300) if k != 1], "doc_id long, quality int")
    kept = quality.accepted(spark.createDataFrame(rows, "doc_id long, text string, _rejected string"), labels)
    assert Counter(x._rejected for x in kept.where("_rejected <> 'x'").collect()) == {"good": 3}


def test_labels_of_held_out_rows_do_not_count(spark):
    df = spark.createDataFrame([(k, f"t{k} " * 30 + "#" * (k % 4)) for k in range(200)], "doc_id long, text string")
    lab = spark.createDataFrame([(k, int(k % 4 < 2)) for k in range(200)], "doc_id long, quality int")
    flipped = lab.withColumn("quality", F.when(quality.is_held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda x: [tuple(r) for r in quality.scored(df, x).orderBy("doc_id").collect()]
    assert score(lab) == score(flipped)
