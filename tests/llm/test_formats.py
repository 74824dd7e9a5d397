"""Archives, pages, tokens, and the pipeline."""

from __future__ import annotations

import gzip
import hashlib
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import bpe, dom, html_extract, warc
from corvane.llm.common import tokenizer_path
from corvane.llm.page_samples import labelled_pages
from tests.llm.cases import documents
from tests.llm.hand_pages import PAGES


def test_warc_round_trip(spark):
    rows = [(1, "https://a/", "same"), (2, "https://b/ x\r\ny", "same"), (3, None, None), (4, "u", ""), (5, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\nWARC/1.1\r\n"), (6, "u", "ünï 😀\x00\r\n\r\n"), (None, "u", "same"), (7, "u", "x" * 200_000)]
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))).collect()}
    want = {}
    for i, _, h in rows:
        p = (h or "").encode()
        top = max((j for j, _, x in rows if j is not None and (x or "") == (h or "")), default=None)
        again = i is not None and i != top
        want[i] = (len(p), warc.digest(p), "revisit" if again else "response", top if again else None)
    assert got == want
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_round_trip_of_shared_ids(spark, tmp_path):
    """No payload is lost where ids repeat: the archive holds each distinct one."""
    rows = [(5, "AAA"), (5, "unique text"), (9, "AAA"), (5, "unique text"), (None, "AAA"), (None, "null's own"), (9, "AAA"), (7, "unique text")]
    df = spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string")
    got = Counter(map(tuple, warc.round_trip(df).select("page_id", "payload_digest", "record_type", "refers_to").collect()))
    want = Counter()
    for i, h in rows:
        top = max(j for j, x in rows if x == h and j is not None) if i is not None else None
        want[(i, warc.digest(h.encode()), *(("response", None) if i == top else ("revisit", top)))] += 1
    assert got == want
    warc.archived(df, str(tmp_path / "w"))
    assert {bytes(r.payload).decode() for r in warc.read(spark, str(tmp_path / "w")).where("type = 'response'").collect()} == {h for _, h in rows}


def test_warc_archives_are_cut_by_bytes(spark, tmp_path):
    df = spark.range(40).coalesce(1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.repeat(F.lit("ü"), 1_000_000), F.col("id").cast("string")).alias("html"))
    warc.archived(df, str(tmp_path / "w"))
    sizes = [f.stat().st_size for f in (tmp_path / "w").glob("part-*")]
    assert len(sizes) == 3 and max(sizes) <= warc.MOST_BYTES + 4
    assert warc.round_trip(df).where("payload_bytes > 2000000").count() == 40


def test_warc_reads_members_in_linear_time():
    member = gzip.compress(warc.record(1, "u", random.Random(1).randbytes(15_000).hex().encode()) + warc.END)
    took = []
    for n in (300, 2400):
        data, began = member * n, time.perf_counter()
        assert sum(isinstance(x, warc.Record) for x in warc.salvaged(data)) == n
        took.append((time.perf_counter() - began) / n)
    assert took[1] < 3 * took[0]


def test_warc_salvage():
    records = [warc.record(k, f"https://a/{k}", f"body {k} ".encode() * 30) + warc.END for k in range(6)]
    whole = b"".join(records)
    assert [int(x.headers["warc-record-id"][10:-1]) for x in warc.salvaged(whole)] == list(range(6))
    # a flipped byte in a body, a torn length, garbage between records, a cut at the end
    flipped = bytearray(whole)
    at = len(records[0]) + len(records[1]) - 20
    flipped[at] ^= 1
    out = list(warc.salvaged(bytes(flipped)))
    assert [type(x).__name__ for x in out] == ["Record", "Gap", "Record", "Record", "Record", "Record"]
    assert (out[1].start, out[1].end, out[1].reason) == (len(records[0]), len(records[0]) + len(records[1]), "block digest differs")
    torn = records[0] + records[1].replace(b"Content-Length: ", b"Content-Length: 9") + b"junk" + records[2]
    out = list(warc.salvaged(torn))
    assert [type(x).__name__ for x in out] == ["Record", "Gap", "Record"] and out[1].end == len(torn) - len(records[2])
    out = list(warc.salvaged(whole[:-30]))
    assert len(out) == 6 and out[-1].reason == "truncated" and out[-1].end == len(whole) - 30
    zipped = [gzip.compress(r) for r in records]
    bad = b"".join([zipped[0], zipped[1][:40], zipped[2], b"\x00\x01", records[3], zipped[4][:20] + b"\xff" + zipped[4][21:], zipped[5]])
    found = [int(x.headers["warc-record-id"][10:-1]) for x in warc.salvaged(bad) if isinstance(x, warc.Record)]
    assert {0, 2, 3, 5} <= set(found)
    covered = sum(x.end - x.start for x in warc.salvaged(bad))
    assert covered == len(bad)
    assert list(warc.salvaged(b"")) == [] and [type(x).__name__ for x in warc.salvaged(b"nothing")] == ["Gap"]


def test_warc_reads_damaged_files(spark, tmp_path):
    records = [warc.record(k, None, b"payload %d" % k) + warc.END for k in range(4)]
    (tmp_path / "a.warc").write_bytes(records[0] + b"rubbish" + records[1])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(records[2]) + gzip.compress(records[3])[:30])
    rows = warc.read(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in rows if r.reason is None) == [b"payload 0", b"payload 1", b"payload 2"] and sum(r.reason is not None for r in rows) == 2
    gaps = warc.quarantined(warc.read(spark, str(tmp_path)), str(tmp_path / "gaps")).collect()
    assert sorted((r.file[-6:], r.start, r.end, r.reason) for r in gaps) == [("a.warc", len(records[0]), len(records[0]) + 7, "no version line"), ("arc.gz", len(gzip.compress(records[2])), len(gzip.compress(records[2])) + 30, "member is truncated")]


ARTICLE = """<html><head><title>t</title><script>var a = "</p><p>x";</script></head><body><header><h1>Site</h1><nav><ul><li><a href=/>Home</a></li></ul></nav></header>
<div class="cookie-banner"><p>We use cookies.</p><button>OK</button></div><article><h1>Head &amp; line</h1><p>First  para<br>graph &eacute;&#233;<div class="ad">Buy now.</div><p>Second one, with <b>bold</b> text and more of it.</p>
<form><p>Your mail</p><input></form></article><section class="comments"><div class="comment"><p>Nice one.</p></div></section><aside class="sidebar"><p>Related.</p></aside><footer>&copy; me</footer>"""


def test_html(spark):
    df = spark.createDataFrame([(1, "u", ARTICLE), (2, None, None), (3, "u", ""), (4, "u", "<<<>>< <p"), (None, "u", ARTICLE), (5, "u", "<div>" * 3000 + "deep text of some length, with marks. " * 5)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r for r in html_extract.extracted(df).collect()}
    assert got[1].text == "Head & line\nFirst para graph éé\nSecond one, with bold text and more of it."
    assert got[1].n_chars == len(got[1].text) and got[None].text == got[1].text and got[2].text == got[3].text == ""
    assert len(got) == 6 and html_extract.extracted(df.limit(0)).count() == 0


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_html_of_pages_by_hand(k):
    html, text = PAGES[k]
    assert html_extract.texts([html], html_extract.default_model()) == [text]


def test_html_keeps_text_beside_and_inside_embedded_elements(spark):
    parts = ['<svg class="i" viewBox="0 0 9 9"/>one', "<math/>two", "<object/>three", "<svg><text>gone</text></svg>four", "<math><mi>x</mi><mo>=</mo><mn>5</mn></math> five", '<object data="a.pdf">Fall back here</object> six', "<noscript>plain words</noscript>seven", "<svg>eight"]
    text = lambda html: " ".join("".join(t for _, t, _ in dom.parse(html).runs).split())
    assert [text(f"<p>a {x} z</p>") for x in parts] == ["a one z", "a two z", "a three z", "a four z", "a x=5 five z", "a Fall back here six z", "a plain wordsseven z", "a eight z"]
    page = ARTICLE.replace("Second one,", "<svg width=9 />Second <object>fallback one,</object> <math><mi>y</mi></math>")
    assert html_extract.extracted(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text.endswith("\nSecond fallback one, y with bold text and more of it.")


def test_html_held_out_accuracy():
    model = html_extract.default_model()
    pages = [dom.parse(p, "data-c") for p in labelled_pages(150, seed=77)]
    p, right, n, base = model.marginals(html_extract.Forest.of(pages)), 0, 0, 0
    for page in pages:
        for block, _, _ in page.runs:
            right += (p[base + block] >= 0.5) == page.flagged[block]
            n += 1
        base += len(page.tag)
    assert right / n > 0.99


def test_messages_are_exact():
    """On a small tree the marginals are those of summing over all labellings."""
    r = np.random.default_rng(0)
    page = dom.parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><p>d</p>")
    forest = html_extract.Forest.of([page])
    model = html_extract.Model(r.normal(size=forest.x.shape[1]), r.normal(size=(2, 2, 2)))
    n, total = len(forest.parent), np.zeros(len(forest.parent))
    mass = 0.0
    for k in range(1 << n):
        y = [k >> j & 1 for j in range(n)]
        e = np.exp(sum(y[j] * (forest.x[j] @ model.weights) for j in range(n)) + sum(model.pair[forest.trunk[j], y[forest.parent[j]], y[j]] for j in range(1, n)))
        mass += e
        total += e * np.array(y)
    assert np.allclose(model.marginals(forest), total / mass)


def test_bpe_against_the_library(spark):
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(tokenizer_path())
    r = random.Random(1)
    pools = ["abc XYZ'sdl l'll've \n\t\r\x0b\x0c\x1c\x85\xa0", "áéüñ€中文字日本語한국😀👍🏽‍﻿ 　᠎​́١٢½²Ⅷ", ".,;!?#$%&", ["<|endoftext|>", "the ", "ing"]]
    texts = ["".join(r.choice(r.choice(pools)) for _ in range(r.randint(0, 80))) for _ in range(500)] + ["a" * 3000, "-" * 777, "ab" * 900, "é" * 300, "", "<|endoftext|>"]
    rows = [*enumerate(texts), (-1, None)]
    got = {x.doc_id: x for x in bpe.report(spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1)), tokenizer_path()).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False)))
    assert bpe.report(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_pipeline_keeps_and_drops(spark, tmp_path):
    import corpus_pipeline

    docs = documents(spark)
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs.select(columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, docs.where("doc_id = 3").first().text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [Counter(r.doc_id for r in rows.collect())]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        rows = stage(spark, rows, str(tmp_path)).cache()
        assert k == len(corpus_pipeline.STAGES) - 1 or rows.columns == columns
        seen.append(Counter(r.doc_id for r in rows.collect()))
        assert not seen[-1] - seen[-2]
    assert {7, 8} & set(seen[1]) and not {7, 8} & set(seen[2]) and 2 in seen[2]
    assert 3 in seen[3] and 3 not in seen[4] and seen[4] == seen[5]


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_warc", "op4_near_duplicates", "op8_decontamination", "op10_url_filter"])
def test_parity(spark, name):
    from corvane.llm.oracles import ORACLES
    from corvane.llm.queries import QUERIES
    from tests.parity import compare

    compare(spark, QUERIES[name], ORACLES[name])
