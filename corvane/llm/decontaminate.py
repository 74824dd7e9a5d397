"""Benchmark passages in documents, by a prefix-filtered set join over word shingles."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Steps, if_small, written
from corvane.llm.textkit import ALNUM, Words, pieces, rolled, utf8

WINDOW, SHINGLE = 10, 5
#: Bits of the sieve that is sent to all executors, as a power of two: 16 MB, whatever the benchmark holds.
SIEVE_BITS = 27
WINDOWS = "item long, words string, size int, k int"
SCANNED = "id long, h long, n_words long, hits array<struct<k:int,shingle:bigint,place:int,at:int,context:string>>"


def item_words(texts: list[str | None]) -> list[list[bytes]]:
    """Lower-cased words of each text; null has none."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    out: list[list[bytes]] = []
    for _, part, at in pieces(data, offsets):
        words = Words(part, at, ALNUM)
        out += [words.list(a, b) for a, b in pairwise(words.first.tolist())]
    return out


def _windows(window: int):
    """Every `window` consecutive words of an item; one of fewer, but not none, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), item_words(batch.column(1).to_pylist()), strict=True):
                size = min(window, len(words))
                texts = [b" ".join(words[i : i + size]).decode() for i in range(len(words) - size + 1 if size else 0)]
                n = len(texts)
                yield pa.RecordBatch.from_arrays([pa.array([item] * n, pa.int64()), pa.array(texts, pa.string()), pa.array([size] * n, pa.int32()), pa.array([min(SHINGLE, size)] * n, pa.int32())], ["item", "words", "size", "k"])

    return run


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each window and where in it they stand."""
    for batch in batches:
        texts, of, offsets, shingles = batch.column(0), [], [], []
        for k, part, at in pieces(*utf8(texts)):
            words = Words(part, at, ALNUM)
            hashes = words.hashes()
            for doc, (a, b) in enumerate(pairwise(words.first.tolist())):
                found = rolled(hashes[a:b], min(SHINGLE, b - a))
                of.append(np.full(len(found), k + doc))
                offsets.append(np.arange(len(found), dtype=np.int32))
                shingles.append(found.view(np.int64))
        if of:
            at = pa.array(np.concatenate(of))
            yield pa.RecordBatch.from_arrays([texts.take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(np.concatenate(offsets)), pa.array(np.concatenate(shingles))], ["words", "size", "k", "offset", "shingle"])


class Sieve:
    """Which hashes may be among given ones: one bit for each of 2 ** width remainders."""

    def __init__(self, width: int, at: np.ndarray, bits: np.ndarray) -> None:
        self.mask = np.uint64((1 << width) - 1)
        self.words = np.zeros(1 << (width - 6), np.uint64)
        self.words[at] = bits.view(np.uint64)

    @staticmethod
    def of(shingles: DataFrame, width: int) -> Broadcast:
        """The sieve of a column `shingle`, sent to all executors as the words of it that are not 0.

        It is put together by an aggregation: at most 2 ** (width - 6) rows of 16
        bytes come to the driver.
        """
        low = F.col("shingle").bitwiseAND(F.lit((1 << width) - 1))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
        rows = shingles.groupBy(F.shiftright(low, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
        return shingles.sparkSession.sparkContext.broadcast((width, rows["at"].to_numpy(), rows["bits"].to_numpy()))

    def passed(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes & self.mask
        return (self.words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


def _sieved(words: Words, lengths: list[int], sieve: Sieve) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """By number of words k: documents, places and hashes of the k-word shingles that pass the sieve."""
    hashes = words.hashes()
    for k in lengths:
        shingles = rolled(hashes, k)
        at = np.flatnonzero(sieve.passed(shingles))
        doc = np.searchsorted(words.first, at, "right") - 1
        inside = at + k <= words.first[doc + 1]  # does not reach into the next document
        yield k, doc[inside], at[inside], shingles[at[inside]]


def _counted(lengths: list[int], sent: Broadcast):
    """In how many documents of a piece of text each sieved shingle is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(*sent.value)
        for batch in batches:
            for _, part, at in pieces(*utf8(batch.column(0))):
                for k, doc, _, shingles in _sieved(Words(part, at, ALNUM), lengths, sieve):
                    once = np.unique(np.stack([shingles, doc.astype(np.uint64)]), axis=1)[0]
                    found, df = np.unique(once, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), k, np.int32)), pa.array(found.view(np.int64)), pa.array(df)], ["k", "shingle", "df"])

    return run


def _scanned(lengths: list[int], window: int, sent: Broadcast):
    """For each document its number of words and the sieved shingles, each with the words around it."""
    kind = pa.list_(pa.struct([("k", pa.int32()), ("shingle", pa.int64()), ("place", pa.int32()), ("at", pa.int32()), ("context", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(*sent.value)
        for batch in batches:
            counts, hits = [], [[] for _ in range(batch.num_rows)]
            for first, part, at in pieces(*utf8(batch.column(2))):
                words = Words(part, at, ALNUM)
                counts.append(np.diff(words.first))
                for k, docs, places, shingles in _sieved(words, lengths, sieve):
                    for doc, place, shingle in zip(docs.tolist(), places.tolist(), shingles.view(np.int64).tolist(), strict=True):
                        begin, end = int(words.first[doc]), int(words.first[doc + 1])
                        low, high = max(begin, place + k - window), min(end, place + window)
                        hits[first + doc].append({"k": k, "shingle": shingle, "place": place - begin, "at": place - low, "context": b" ".join(words.list(low, high)).decode()})
            n = np.concatenate(counts) if counts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n.astype(np.int64)), pa.array(hits, kind)], ["id", "h", "n_words", "hits"])

    return run


def _identity(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id (which may be null or shared) and a hash of the text."""
    return [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h")]


def _joined(documents: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, sieve_bits: int, steps: Steps, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every document's (id, h, n_words), the occurrences (id, h, start, size, words) of windows in them, and the windows.

    The first is made by `keep`, as results are read from it.
    """
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    windows = steps.written(items.mapInArrow(_windows(window), WINDOWS).distinct(), "windows")
    shingles = windows.select("words", "size", "k").distinct().mapInArrow(_shingled, "words string, size int, k int, offset int, shingle long")
    shingles = steps.written(shingles, "shingles")
    lengths = sorted(r.k for r in shingles.select("k").distinct().collect())  # 1 to SHINGLE

    texts = documents.select(*_identity(id_col, text_col), F.col(text_col).alias("text"))
    counts = texts.select("text").mapInArrow(_counted(lengths, Sieve.of(shingles, sieve_bits)), "k int, shingle long, df long").groupBy("k", "shingle").agg(F.sum("df").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset")).alias("r")
    prefixes = shingles.join(counts, ["k", "shingle"], "left").groupBy("words", "size", "k").agg(rarest)
    prefixes = steps.written(prefixes.select("words", "size", "k", "r.shingle", "r.offset"), "prefixes")

    rows = keep(texts.mapInArrow(_scanned(lengths, window, Sieve.of(prefixes, sieve_bits)), SCANNED), "scanned")
    hits = rows.where("size(hits) > 0").select("id", "h", F.explode("hits").alias("hit")).select("id", "h", "hit.*")
    found = hits.join(if_small(prefixes), ["k", "shingle"])
    # The window must begin and end within the text (positional bound), and its words must be there.
    found = found.where("at >= offset").where(F.array_join(F.slice(F.split("context", " "), F.col("at") - F.col("offset") + 1, F.col("size")), " ") == F.col("words"))
    found = steps.written(found.select("id", "h", (F.col("place") - F.col("offset")).alias("start"), "size", "words").distinct(), "found")
    return rows.select("id", "h", "n_words"), found, windows


def contaminated(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, sieve_bits: int = SIEVE_BITS) -> DataFrame:
    """key (the document's id), n_words, hit_words and item_ids of every document.

    hit_words: places of the words inside an occurrence of a window (`window`
    consecutive words of an item; an item with fewer words is one window).
    item_ids: the items with such windows. Words are runs of digits, letters and
    anything beyond ASCII, with A-Z lower-cased; null texts have none, and items
    without words or without an id match nothing. Each row gives one row, judged
    by its own text, also where ids repeat or are null. With an empty benchmark
    nothing is hit.

    A window is contained in a text only if all its shingles are, so for a
    required containment of 1 the necessary prefix of its shingles, rarest first,
    is one shingle, and its offset fixes where the window must start.

    1. The document frequency of all shingles of the benchmark is counted over all
       documents, and the rarest one of each window is its prefix. 2. The documents
       are scanned again for prefixes; each hit brings the words around it along.
       3. Hits and windows are joined on the prefix, and the words are compared.
    Both scans see a sieve of fixed size, so they are two whatever the size of the
    benchmark; what passes it by chance falls away in the join. Texts are never
    shuffled.
    """
    with Steps(documents.sparkSession, "decontaminate") as steps:
        rows, found, windows = _joined(documents, benchmark, id_col, text_col, item_col, item_text, window, sieve_bits, steps, written)
        places = F.flatten(F.transform(F.collect_set(F.struct("start", "size")), lambda x: F.sequence(x["start"], x["start"] + x["size"] - 1)))
        words = found.groupBy("id", "h").agg(F.array_sort(F.array_distinct(places)).alias("hit_words"))
        of = found.select("id", "h", "words").distinct().join(if_small(windows.select("words", "item")), "words").groupBy("id", "h").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
        both = words.alias("w").join(of.alias("o"), F.col("w.id").eqNullSafe(F.col("o.id")) & (F.col("w.h") == F.col("o.h"))).select(F.col("w.id").alias("_id"), F.col("w.h").alias("_h"), "hit_words", "item_ids")
        hit = if_small(written(both, "hit"))
    out = rows.join(hit, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    some = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return out.select(F.col("id").alias("key"), "n_words", some("hit_words", "int"), some("item_ids", "bigint"))


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids of every document; see `contaminated`."""
    found = contaminated(documents, benchmark)
    listed = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
        "item_ids",
    )


def clean(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, in which no window of an item occurs.

    Each row is kept or dropped by its own text, also where ids are null or
    shared; see `contaminated` for what a window is.
    """
    with Steps(documents.sparkSession, "decontaminate") as steps:
        _, found, _ = _joined(documents, benchmark, id_col, text_col, "item_id", "text", WINDOW, SIEVE_BITS, steps, steps.written)
        hit = if_small(written(found.select(F.col("id").alias("_hit_id"), F.col("h").alias("_hit_h")).distinct(), "hit"))
    return documents.join(hit, documents[id_col].cast("long").eqNullSafe(hit["_hit_id"]) & (F.xxhash64(documents[text_col]) == hit["_hit_h"]), "left_anti")
