"""SimHash fingerprints and the earliest near copy of each document."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane import constants as C
from corvane.operators.graph import _Content, content_words
from corvane.sources.shared import written

#: Texts whose words a worker holds at once.
TEXTS = 1000

# The 64-bit FNV-1a offset and prime.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(word: str) -> int:
    """FNV-1a over UTF-16 code units."""
    raw, h = word.encode("utf-16-le"), OFFSET
    for k in range(0, len(raw), 2):
        h = (h ^ (raw[k] | raw[k + 1] << 8)) * PRIME % (1 << 64)
    return h


def fnv1a_all(words: list[str]) -> np.ndarray:
    """The same of many words at once, one code unit after the other."""
    raw = [w.encode("utf-16-le") for w in words]
    units = np.zeros((len(raw), max(map(len, raw), default=0) // 2), np.uint16)
    size = np.array([len(x) // 2 for x in raw], np.int64)
    units[np.arange(units.shape[1]) < size[:, None]] = np.frombuffer(b"".join(raw), np.uint16)
    h = np.full(len(raw), OFFSET, np.uint64)
    for k in range(units.shape[1]):
        on = size > k
        h[on] = (h[on] ^ units[on, k]) * np.uint64(PRIME)
    return h


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per bit, words with it set against words without; set if there are more. Ties are 0."""
    content = _Content()
    for whole in batches:
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            words = [content_words(t, content) for t in batch.column(1).to_pylist()]
            keep = [k for k, w in enumerate(words) if len(w) >= C.SIMHASH_WORDS]
            coded = pa.array([w for k in keep for w in words[k]], pa.string()).dictionary_encode()
            bits = np.unpackbits(fnv1a_all(coded.dictionary.to_pylist()).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
            index, ends = coded.indices.to_numpy(), np.cumsum([0, *(len(words[k]) for k in keep)])
            out = np.zeros((len(keep), 8), np.uint8)
            for k in range(len(keep)):
                out[k] = np.packbits(bits[index[ends[k] : ends[k + 1]]].sum(axis=0, dtype=np.int64) > 0, bitorder="little")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(out.view("<i8").ravel(), pa.int64())], ["doc_id", "hash"])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and hash of documents without an error, with 80 words and 80 content words."""
    rows = documents.where("error IS NULL AND word_count >= 80").select("doc_id", "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, hash long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def blocks(n: int) -> list[tuple[int, int]]:
    """First bit and width of n blocks that make up the 64 bits, the wider ones first."""
    width, wider = divmod(64, n)
    widths = [width + (k < wider) for k in range(n)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def masks(distance: int, spare: int = 1) -> list[int]:
    """The bits of every choice of `spare` of distance + spare blocks.

    `distance` different bits touch as many blocks at most, so two hashes within
    it agree in all the bits of one choice at least. With more spare blocks there
    are more choices of more bits each: C(distance + spare, spare) tables, in which
    chance brings fewer pairs together.
    """
    parts = [((1 << w) - 1) << at for at, w in blocks(distance + spare)]
    return [sum(c) for c in combinations(parts, spare)]


def spare_blocks(n: int, distance: int) -> int:
    """Spare blocks for n hashes whose bits are independent: the fewest that leave a hash about 1,000 chance partners in all tables; 4 at most."""
    cost = lambda s: len(masks(distance, s)) * n / 2 ** min(m.bit_count() for m in masks(distance, s))
    return next((s for s in (1, 2, 3) if cost(s) <= 1000), 4)


#: Rows of a bucket that are compared with each other at once: so many, or SLICE_ROOT times the root of the number of hashes.
LEAST_SLICE, SLICE_ROOT = 1024, 8
#: Candidates that a worker looks at in one step.
STEP = 128


def _earliest(h: np.ndarray, first: np.ndarray, others: np.ndarray, their_first: np.ndarray, distance: int) -> np.ndarray:
    """The least id of the others within the distance of each hash; its own `first` where none is smaller.

    The others come by id, so a hash is done with the first one found, or when
    the ids of the others reach its own.
    """
    out, left = first.copy(), np.arange(len(h))
    for at in range(0, len(others), STEP):
        left = left[first[left] > their_first[at]]
        if not len(left):
            break
        near = np.bitwise_count(h[left, None] ^ others[None, at : at + STEP]) <= distance
        hit = near.any(axis=1)
        out[left[hit]] = np.minimum(first[left[hit]], their_first[at + near[hit].argmax(axis=1)])
        left = left[~hit]
    return out


def _compared(table: pa.Table, distance: int) -> pa.Table:
    """hash and first2 of one cell: all its rows with each other, or those of one slice with those of another."""
    table = table.sort_by("first")
    h, first, part = table["hash"].to_numpy().view(np.uint64), table["first"].to_numpy(), table["slice"].to_numpy()
    low = part == table["low"][0].as_py()
    sides = [(low, low)] if low.all() else [(low, ~low), (~low, low)]
    found = [(h[x], first[x], _earliest(h[x], first[x], h[y], first[y], distance)) for x, y in sides]
    h, first, best = (np.concatenate(c) for c in zip(*found, strict=True))
    return pa.table({"hash": h[best < first].view(np.int64), "first2": best[best < first]})


def earliest(hashes: DataFrame, distance: int = C.SIMHASH_DISTANCE, spare: int = 1) -> DataFrame:
    """doc_id and duplicate_of of every document: the earliest one within the distance, often itself.

    Hashes that agree in the bits of a choice of blocks are a bucket, and every
    pair within the distance shares one, see `masks`. Bits of real texts are not
    independent and near copies share every choice, so more spare blocks hardly
    lower the number of pairs but multiply the rows: one is the default. Buckets
    are compared in workers, which return one row a hash, not one a pair; a large
    one is cut into slices and each pair of slices is a cell of its own, so no
    task has a whole bucket. Equal hashes are one row in it, with their smallest id.
    Sides with a row for each hash are merged: their files are small for their rows,
    and Spark would collect them on the driver for a broadcast.
    """
    classes = written(hashes.groupBy("hash").agg(F.min("doc_id").alias("first")).where("first IS NOT NULL"), "hashes")
    most = max(LEAST_SLICE, SLICE_ROOT * isqrt(classes.count()))
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(k).alias("choice"), F.col("hash").bitwiseAND(F.lit(signed(m))).alias("bits")) for k, m in enumerate(masks(distance, spare))]
    keyed = classes.select("hash", "first", F.explode(F.array(*keys)).alias("b")).select("hash", "first", "b.*")
    large = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where(F.col("n") > most).select("choice", "bits", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    large = F.broadcast(large)  # rows / most buckets at the most: with nine choices about the root of the number of hashes
    dealt = keyed.join(large, ["choice", "bits"], "left").withColumn("slices", F.coalesce("slices", F.lit(1))).withColumn("slice", F.pmod(F.xxhash64("hash"), "slices").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    cells = dealt.select("choice", "bits", F.least("slice", "other").alias("low"), F.greatest("slice", "other").alias("high"), "hash", "first", "slice")
    near = cells.groupBy("choice", "bits", "low", "high").applyInArrow(lambda t: _compared(t, distance), "hash long, first2 long")
    near = near.groupBy("hash").agg(F.min("first2").alias("first2"))
    best = written(classes.join(near.hint("merge"), "hash", "left").select("hash", F.least("first", "first2").alias("duplicate_of")), "copies")
    return hashes.join(best.hint("merge"), "hash").select("doc_id", "duplicate_of")


def first_copies(hashes: DataFrame, distance: int = C.SIMHASH_DISTANCE, spare: int = 1) -> DataFrame:
    """doc_id and duplicate_of: the earliest earlier document within the distance, see `earliest`."""
    return earliest(hashes, distance, spare).where("duplicate_of < doc_id")


def independent(hashes: DataFrame, distance: int = C.SIMHASH_DISTANCE) -> DataFrame:
    """How many documents are left if each copy counts as its first document, and how many copies there are."""
    first = F.when(F.col("duplicate_of") < F.col("doc_id"), F.col("duplicate_of"))
    return earliest(hashes, distance).agg(F.countDistinct(F.coalesce(first, "doc_id")).alias("independent"), F.count(first).alias("copies"))


def groups(copies: DataFrame) -> DataFrame:
    """Each first document with the ids of its copies, in order (of a bounded set of documents), and their number."""
    return copies.groupBy(F.col("duplicate_of").alias("doc_id")).agg(F.array_sort(F.collect_list("doc_id")).alias("copies"), F.count("*").alias("n"))
