"""Passages repeated across documents, by content-defined chunking with a gear hash."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Steps, no_text, written
from corvane.llm.textkit import SPACE_PARTED, Words, mix, pieces, powers, utf8

#: One 32-bit number for each byte value, from a seed.
GEAR = np.random.default_rng(6).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
SHIFT, STEPS = 2, 4
#: Documents whose spans are broadcast at most; more are joined by a shuffle.
MOST_SENT = 100_000
_BLANKED = np.where(SPACE_PARTED, 0x20, np.arange(256)).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    """reach: a chunk ends at a word whose gear hash is least among `reach` words to
    both sides, so chunks have reach + 1 words at least and 2 * reach + 1 on
    average. A chunk of more than `most_words` (text that repeats one word has no
    least hash) is cut every `most_words` from its start. A run of chunks is
    removed if it has `least_chunks` chunks and `least_words` words at least, and
    an earlier document holds it in one piece.
    """

    reach: int = 3
    most_words: int = 16
    least_words: int = 20
    least_chunks: int = 2


def gear(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gear hash at each byte of each document: h = (h << 2) + GEAR[byte], in 32 bits.

    With that shift the last 16 bytes decide; the sum over them is built by doubling.
    """
    h = GEAR[data]
    for k in range(STEPS):
        n = 1 << k
        if len(h) <= n:
            break
        more = h[:-n] << np.uint32(SHIFT * n)
        early = (offsets[:-1, None] + np.arange(n)).ravel()  # nothing comes over from the document before
        early = early[(early >= n) & (early < len(h))]
        more[early - n] = 0
        h = h.copy()
        h[n:] += more
    return h


def chunk_ends(words: Words, offsets: np.ndarray, reach: int, most: int = 16) -> np.ndarray:
    """Word numbers after which a chunk ends, ascending; every document's last word is one.

    A word ends a chunk if the (mixed) gear hash at its last byte is less than
    that of each of the `reach` words before it and not greater than that of
    those after it. The rule looks at nearby bytes only, so a passage inserted in
    another text is cut at the same words but for its first and last few,
    wherever it stands and whatever was inserted before it. Each kind of white
    space counts as a blank.
    """
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    h = mix(gear(_BLANKED[words.data], offsets)[words.end - 1].astype(np.uint64))
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    low = np.ones(n, bool)
    for j in range(1, min(reach + 1, n)):
        same = doc[j:] == doc[:-j]
        low[j:] &= ~same | (h[j:] < h[:-j])
        low[:-j] &= ~same | (h[:-j] <= h[j:])
    last = words.first[1:] - 1
    low[last[last >= words.first[:-1]]] = True
    ends = np.flatnonzero(low) + 1
    starts = np.concatenate([[0], ends[:-1]])
    forced = (ends - starts - 1) // most
    nth = np.arange(forced.sum()) - np.repeat(np.cumsum(forced) - forced, forced)
    return np.sort(np.concatenate([ends, np.repeat(starts, forced) + (nth + 1) * most]))


def _chunked(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, part, at in pieces(*utf8(batch.column(2))):
                words = Words(part, at, SPACE_PARTED, lower=False)
                ends = chunk_ends(words, at, settings.reach, settings.most_words)
                if not len(ends):
                    continue
                starts = np.concatenate([[0], ends[:-1]])
                digest, again = (chunk_digests(words.hashes(w), starts, ends) for w in (0, 1))
                digests = [pa.array(digest.view(np.int64)), pa.array((again >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                doc = np.searchsorted(words.first, starts, "right") - 1
                of = pa.array(k + doc)
                yield pa.RecordBatch.from_arrays([*digests, batch.column(0).take(of), batch.column(1).take(of), pa.array((starts - words.first[doc]).astype(np.int32)), pa.array((ends - starts).astype(np.int32))], ["digest", "again", "id", "h", "begin", "n"])

    return run


def chunk_digests(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit digest of the words of each chunk: its first and the further ones, one after the other."""
    n = ends - starts
    out = mix(n.astype(np.uint64))
    for j in range(int(n.max())):
        on = np.flatnonzero(n > j)
        out[on] = mix(out[on] * np.uint64(0x9E3779B97F4A7C15) + hashes[starts[on] + j])
    return out


def units(offsets: np.ndarray, begin: np.ndarray, n: np.ndarray, digests: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For lists of chunks sorted by place: the least runs that can be removed.

    Of the chunks k of an unbroken stretch, each begins a unit and each ends one:
    the fewest chunks with `least_words` words and `least_chunks` chunks. A longer
    run is the union of its units, so to look for units is to look for all runs.
    Returns the list, first and last word (exclusive) of each unit, and its digests.
    """
    m, least = len(begin), settings.least_words
    end = begin + n
    place = np.arange(m)
    fresh = np.ones(m, bool)
    fresh[1:] = begin[1:] != end[:-1]
    fresh[offsets[:-1][offsets[:-1] < m]] = True
    low = np.maximum.accumulate(np.where(fresh, place, 0))  # first chunk of the stretch
    edges = np.append(np.flatnonzero(fresh), m)
    high = edges[np.searchsorted(edges, place, "right")]  # behind the last one
    total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
    forth = np.maximum(np.searchsorted(total, total[:-1] + least), place + settings.least_chunks)
    back = np.minimum(np.searchsorted(total, total[1:] - least, "right") - 1, place + 1 - settings.least_chunks)
    first = np.concatenate([place[forth <= high], back[back >= low]])
    last = np.concatenate([forth[forth <= high], place[back >= low] + 1])
    first, last = np.unique(np.stack([first, last]), axis=1) if len(first) else (first, last)
    up, down = powers(m + 1)
    out = []
    for d in digests:
        sums = np.zeros(m + 1, np.uint64)
        np.cumsum(mix(d.astype(np.int64).view(np.uint64)) * up[:m], out=sums[1:])
        out.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)).view(np.int64))
    return np.searchsorted(offsets, first, "right") - 1, begin[first], end[last - 1], out


def _united(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            k = 0
            while k < batch.num_rows:  # whole lists of about 2 ** 18 chunks
                to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + (1 << 18), "right")) - 1)
                flat = lists.values.slice(offsets[k], offsets[to] - offsets[k])
                begin, n, *digests = (flat.field(c).to_numpy() for c in range(4))
                doc, first, last, (u, v) = units(offsets[k : to + 1] - offsets[k], begin, n, digests, settings)
                of = pa.array(k + doc)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), batch.column(0).take(of), batch.column(1).take(of), pa.array(first), pa.array(last)], ["u", "v", "id", "h", "begin", "end"])
                k = to

    return run


def _spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping or touching units made one span, with the documents that hold its parts."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("from", pa.list_(pa.int64()))]))
    for batch in batches:
        out = []
        for found in batch.column(2).to_pylist():
            spans: list[list] = []
            for x in found:  # sorted by place
                if spans and x["begin"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], x["end"])
                    spans[-1][2].add(x["first_id"])
                else:
                    spans.append([x["begin"], x["end"], {x["first_id"]}])
            out.append([{"begin": a, "end": b, "from": sorted(s - {None})} for a, b, s in spans])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind)], ["id", "h", "spans"])


def _identity(id_col: str, text_col: str) -> list[F.Column]:
    """What tells rows apart: the id (which may be null or shared) and a hash of the text."""
    return [F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h")]


def repeated_spans(documents: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h and spans (begin, end, from) of each document with passages that an earlier one holds.

    Documents come in the order of their ids, null ids last, those with one id by
    h, a hash of the text; rows equal in both are one document. A span is a run
    of words; from lists the ids of the first documents that hold its parts. Each
    part is a `units` run which that document holds in one piece, so passages
    that stand together nowhere else are not joined to one.

    Chunks are counted by digest, and those that occur once fall away in a partial
    aggregation. The others are put together by document, units are made of
    neighbouring ones, and a unit is repeated if an earlier document has it. Every
    chunk has two independent digests, of 64 and 32 bits: the first finds candidates,
    a unit needs both of two chunks at least. All joins are equi-joins, in which Spark
    may split a digest that a third of all documents hold.
    """
    rows = documents.select(*_identity(id_col, text_col), F.col(text_col).alias("text")).where("text IS NOT NULL")
    with Steps(documents.sparkSession, "substrings") as steps:
        chunks = steps.written(rows.mapInArrow(_chunked(settings), "digest long, again int, id long, h long, begin int, n int"), "chunks")
        several = steps.written(chunks.groupBy("digest").agg(F.count("*").alias("c")).where("c > 1").select("digest"), "several")
        listed = chunks.join(several, "digest").groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("begin", "n", "digest", "again"))).alias("chunks"))
        found = steps.written(listed.mapInArrow(_united(settings), "u long, v long, id long, h long, begin int, end int"), "units")
        order = F.struct(F.col("id").isNull().alias("late"), "id", "h")
        firsts = found.groupBy("u", "v").agg(F.min(order).alias("first"), F.count("*").alias("c")).where("c > 1")
        firsts = steps.written(firsts.select("u", "v", F.col("first.id").alias("first_id"), F.col("first.h").alias("first_h")), "firsts")
        later = found.join(firsts, ["u", "v"]).where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))))
        later = later.groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("begin", "end", "first_id"))).alias("found"))
        return written(later.mapInArrow(_spanned, "id long, h long, spans array<struct<begin:int,end:int,from:array<bigint>>>"), "spans")


def cut(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without those runs of words and the white space after each run's words."""
    if text is None or not spans:
        return text
    data, offsets = utf8(pa.array([text], pa.large_string()))
    words = Words(data, offsets, SPACE_PARTED, lower=False)
    keep, at = [], 0
    for begin, end in spans:
        keep.append(data[at : words.start[begin]].tobytes())
        at = int(words.start[end]) if end < len(words.start) else len(data)
    keep.append(data[at:].tobytes())
    return b"".join(keep).decode()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).to_pylist()
        spans = batch.column(2).to_pylist()
        out = [cut(t, [(s["begin"], s["end"]) for s in x or []]) for t, x in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), batch.column(2)], ["row", "text", "spans"])


def _parted(documents: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """row (a struct of the columns but the text), text (what is left of it) and spans of every document."""
    spans = repeated_spans(documents, settings, id_col, text_col)
    sure = F.broadcast(spans) if spans.count() <= MOST_SENT else spans
    sure = sure.select(F.col("id").alias("_id"), F.col("h").alias("_h"), "spans")
    others = [F.col(f"`{c}`") for c in documents.columns if c != text_col]
    rows = documents.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"), *_identity(id_col, text_col))
    joined = rows.join(sure, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("row", "text", "spans")
    whole = joined.where("spans IS NULL")
    return whole.unionByName(joined.where("spans IS NOT NULL").mapInArrow(_cut, whole.schema))


def deduplicated(documents: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, passages cut that an earlier document holds.

    The first document (see `repeated_spans`) that holds a passage keeps it, and
    what a text repeats of itself alone stays. Texts without such passages stay as
    they are, byte for byte; a text that is all repeats becomes empty; null texts
    stay null. Each row is cut by the spans of its own id and text, also where ids
    are null or shared; rows equal in both are one document and cut alike.
    """
    parted = _parted(documents, settings, id_col, text_col)
    return parted.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in documents.columns])


def report(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, has_repeats, n_removed_words, n_spans, n_chars_kept, source_doc_ids and text_sha256 of every document.

    source_doc_ids are the documents that hold the removed passages first;
    n_chars_kept and text_sha256 are those of the text that is left. A null text
    counts as empty.
    """
    spans = F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int,from:array<bigint>>>"))
    return _parted(documents.select("doc_id", "text"), settings, "doc_id", "text").select(
        "row.doc_id",
        (F.size(spans) > 0).alias("has_repeats"),
        F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"]).alias("n_removed_words"),
        F.size(spans).cast("long").alias("n_spans"),
        F.length(no_text(F.col("text"))).cast("long").alias("n_chars_kept"),
        F.array_sort(F.array_distinct(F.flatten(F.transform(spans, lambda s: s["from"])))).alias("source_doc_ids"),
        F.sha2(no_text(F.col("text")), 256).alias("text_sha256"),
    )


def chunks_of(text: str, settings: Settings = Settings()) -> list[tuple[bytes, ...]]:
    """The chunks of one text, as words."""
    data, offsets = utf8(pa.array([text], pa.large_string()))
    words = Words(data, offsets, SPACE_PARTED, lower=False)
    ends = chunk_ends(words, offsets, settings.reach, settings.most_words)
    return [tuple(words.list(a, b)) for a, b in pairwise([0, *ends.tolist()])]

