"""Byte-level BPE encoding and decoding over a contiguous rank array."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Splits text before the merges, as byte-level vocabularies of this kind expect it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_PAIR = 2**31 - 1
#: Words with more bytes than this are merged with a heap: scanning is quadratic.
SHORT = 64
#: Words in each of the two generations of the cache.
MOST_CACHED = 150_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file.

    Printable Latin-1 characters stand for themselves, the others for those from
    U+0100 on, in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(others)}


class Codec(dict):
    """Encodes and decodes texts; as a dict, the ids (as bytes) of words seen lately."""

    def __init__(self, spec: str) -> None:
        super().__init__()
        spec = json.loads(spec)
        model, before = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without normalisation or a prefix space is read")
        letters = byte_letters()
        vocab = model["vocab"]
        self.single = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.single[b] = vocab[letter]
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.keys = np.array(sorted(self.pairs))
        self.rank_of = np.array([self.pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([i for _, i in self.pairs.values()], np.int32)  # by rank
        self.older: dict[str, bytes] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.split = regex.compile(PATTERN).findall
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_PAIR where they do not merge or one is missing (-1)."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.rank_of[at], NO_PAIR)

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Ids, as bytes, of words of SHORT bytes at most.

        Each word is a row: ids holds the parts between its boundaries, ranks the
        rank of each part with the next one, both contiguous. Again and again the
        least rank of a row (the first of equals) marks the boundary to delete; what
        is right of it moves up, and only the ranks on its two sides are looked up
        anew. All rows take a step at a time; a row without a rank is done.
        """
        out = [b""] * len(words)
        length = np.array([*map(len, words)])
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, SHORT)):
            row = np.flatnonzero((length > low) & (length <= high))
            if not len(row):
                continue
            n = length[row]
            inside = np.arange(high) < n[:, None]
            ids = np.full((len(row), high + 1), -1, np.int32)
            ids[:, :-1][inside] = self.single[np.frombuffer(b"".join([words[k] for k in row.tolist()]), np.uint8)]
            ranks = np.full((len(row), high), NO_PAIR, np.int32)
            ranks[inside] = self._rank(ids[:, :-1][inside], ids[:, 1:][inside])
            while len(row):
                k = ranks.argmin(axis=1)
                at = np.arange(len(row))
                least = ranks[at, k]
                done = least == NO_PAIR
                if done.any():
                    for r, w, m in zip(row[done].tolist(), ids[done], (ids[done] >= 0).sum(axis=1).tolist(), strict=True):
                        out[r] = w[:m].tobytes()
                    go = ~done
                    row, ids, ranks, k, least = row[go], ids[go], ranks[go], k[go], least[go]
                    at = at[: len(row)]
                    if not len(row):
                        break
                right = np.arange(high) > k[:, None]
                ids[at, k] = self.made[least]
                ids[:, :-1] = np.where(right, ids[:, 1:], ids[:, :-1])
                ids[:, -1] = -1
                right[at, k] = True
                ranks[:, :-1] = np.where(right[:, :-1], ranks[:, 1:], ranks[:, :-1])
                ranks[:, -1] = NO_PAIR
                ranks[at, k] = self._rank(ids[at, k], ids[at, k + 1])
                left = np.flatnonzero(k)
                ranks[left, k[left] - 1] = self._rank(ids[left, k[left] - 1], ids[left, k[left]])
        return out

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of (rank, place): n log n for words without an end."""
        n, pairs = len(ids), self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ids = [*ids]
        heap = [(p[0], k) for k in range(n - 1) if (p := pairs.get(ids[k] << 32 | ids[k + 1]))]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            j = after[k]
            if ids[k] < 0 or j >= n:
                continue
            pair = pairs.get(ids[k] << 32 | ids[j])
            if not pair or pair[0] != rank:
                continue  # one side has changed since
            ids[k], ids[j] = pair[1], -1
            after[k] = after[j]
            if after[k] < n:
                before[after[k]] = k
                if p := pairs.get(ids[k] << 32 | ids[after[k]]):
                    heappush(heap, (p[0], k))
            if before[k] >= 0 and (p := pairs.get(ids[before[k]] << 32 | ids[k])):
                heappush(heap, (p[0], before[k]))
        return [i for i in ids if i >= 0]

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        return self.merged([raw])[0] if len(raw) <= SHORT else np.array(self._merged_long(self.single[np.frombuffer(raw, np.uint8)].tolist()), "<i4").tobytes()

    def _learn(self, words: set[str]) -> None:
        """Look up words that are not cached, all at once; words not met for a generation are forgotten."""
        if len(self) > MOST_CACHED:
            self.older = dict(self)
            self.clear()
        words = [w for w in words if w not in self]
        self.update((w, x) for w in words if (x := self.older.get(w)) is not None)
        words = [w for w in words if w not in self]
        raw = [w.encode() for w in words]
        short = [k for k, w in enumerate(raw) if len(w) <= SHORT]
        self.update(zip([words[k] for k in short], self.merged([raw[k] for k in short]), strict=True))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, special tokens in it as their own ids."""
        split = []
        for text in texts:
            parts = self.parts(text) if self.parts and any(s in text for s in self.special) else [text]
            split.append([self.split(p) if p not in self.special else [p] for p in parts])
        self._learn({w for parts in split for words in parts for w in words} - self.special.keys())
        own = {t: np.array([i], "<i4").tobytes() for t, i in self.special.items()}
        out = []
        for parts in split:
            # A special token's text cannot be a word: the split would have parted it off.
            out.append(np.frombuffer(b"".join([own[w[0]] if len(w) == 1 and w[0] in own else b"".join(map(self.__getitem__, w)) for w in parts]), "<i4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens included; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _encoded(spec: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(spec)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = coder.encode_all([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                columns = [part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([coder.decode(i) for i in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "decoded"][: len(columns)])

    return run


def encoded(documents: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """key, ids and, if asked for, decoded (the text those ids stand for) of every document.

    tokenizer: path of a byte-level BPE file in JSON; the driver reads it and
    sends its text. Whole texts are encoded; null counts as empty and gives no
    ids. No special token is added; one that stands in a text becomes its id.
    Every row gives one row. Nothing is shuffled.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoded(Path(tokenizer).read_text(), decoded), "key long, ids array<int>" + ", decoded string" * decoded)


def report(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    out = encoded(documents, tokenizer, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return out.select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
