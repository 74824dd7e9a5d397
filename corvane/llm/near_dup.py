"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard similarity."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Steps, if_small, written
from corvane.llm.components import components
from corvane.llm.textkit import SPACE_PARTED, Words, mix, pieces, rolled, utf8


#: Shingles found in more documents than this are common, in the search for the last links.
FEW = 8


@dataclass(frozen=True)
class Settings:
    """Similarity as a percentage, words in a shingle, and how signatures are banded.

    With 26 bands of 6 coordinates a pair at 0.85 shares no band with probability
    4e-6; with 30 bands of 5, a pair at 0.80 with 7e-6.
    """

    percent: int = 85
    words: int = 5
    bands: int = 26
    rows: int = 6
    universe_bits: int = 21
    seed: int = 4

    @property
    def coordinates(self) -> int:
        return self.bands * self.rows


AT_85 = Settings()
AT_80 = Settings(percent=80, bands=30, rows=5)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document the sorted distinct hashes of its k-word shingles.

    Fewer words than k: one shingle of all of them. No words: empty.
    """
    for _, part, at in pieces(data, offsets):
        words = Words(part, at, SPACE_PARTED)
        hashes = words.hashes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            yield np.unique(rolled(hashes[a:b], min(k, b - a))) if b > a else hashes[:0]


class CirculantMinHash:
    """Signatures from two permutations of a universe of 2 ** bits places.

    sigma spreads the (hashed) shingles over the universe once; coordinate j is
    the least pi value at the places shifted circularly by j. As the shifts of
    one place are neighbours in pi, all coordinates of a shingle are one
    contiguous slice of the table.
    """

    def __init__(self, settings: Settings) -> None:
        self.settings, size = settings, 1 << settings.universe_bits
        rng = np.random.default_rng(settings.seed)
        self.mask = np.uint64(size - 1)
        self.sigma = rng.permutation(size).astype(np.int32)
        pi = rng.permutation(size).astype(np.int32)
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: settings.coordinates]]), settings.coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.sigma[(shingles & self.mask).astype(np.int64)]
        out = np.full(self.settings.coordinates, np.iinfo(np.int32).max, np.int32)
        for k in range(0, len(at), 2048):
            np.minimum(out, self.shifted[at[k : k + 2048]].min(axis=0), out=out)
        return out

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key of each band, its number mixed in; none for an empty set."""
        if not len(shingles):
            return np.zeros(0, np.int64)
        rows = self.signature(shingles).astype(np.uint64).reshape(self.settings.bands, self.settings.rows)
        key = np.arange(1, self.settings.bands + 1, dtype=np.uint64)
        for j in range(self.settings.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, j])
        return key.view(np.int64)


def _signed(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = CirculantMinHash(settings)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for s in shingle_sets(*utf8(batch.column(2)), settings.words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                keys.append(hasher.band_keys(s))
            ends = np.cumsum([0, *map(len, keys)], dtype=np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "h", "n", "digest", "bands"]
            )

    return run


def _sets(settings: Settings):
    """The shingles of each text as bytes: sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(*utf8(batch.column(1)), settings.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "shingles"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many shingles the two sets of each row have in common."""
    for batch in batches:
        a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (2, 3))
        both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b, strict=True)]
        sizes = [pa.array([*map(len, x)], pa.int64()) for x in (a, b)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *sizes, pa.array(both, pa.int64())], ["u", "v", "nu", "nv", "both"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of a set."""
    for batch in batches:
        for node, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            shingles = np.frombuffer(x.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), node, np.int64)), pa.array(shingles)], ["node", "shingle"])


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u, v, nu, nv and both, the number of common shingles of their full sets, of pairs (u, v)."""
    a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "uv")
    return pairs.select("u", "v").join(b, "v").join(a, "u").select("u", "v", "set_u", "set_v").mapInArrow(_shared, "u long, v long, nu long, nv long, both long")


def _enough(settings: Settings, both: Column, a: Column, b: Column) -> Column:
    """Whether sets of a and b shingles are similar enough with `both` common ones."""
    return both * (100 + settings.percent) >= (a + b) * settings.percent


def _links(compared: DataFrame, settings: Settings) -> DataFrame:
    return compared.where(_enough(settings, F.col("both"), F.col("nu"), F.col("nv"))).select("u", "v")


def _near_size(settings: Settings, a: Column, b: Column) -> Column:
    """Two sets can only be similar enough if their sizes are."""
    return (a * 100 >= b * settings.percent) & (b * 100 >= a * settings.percent)


def _open_buckets(members: DataFrame, found: DataFrame, steps: Steps) -> DataFrame:
    """Members of buckets that hold more than one component, with their components."""
    at = members.join(if_small(found.select("node", "component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
    at = steps.written(at, "components")
    several = at.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least")).where("low < high")
    return steps.written(at.join(if_small(steps.written(several.select("bucket", "least"), "several")), "bucket"), "open")


def _reachable(settings: Settings, most: str) -> Column:
    """Whether a member sharing at most `most` shingles can be similar to any of its bucket."""
    return _enough(settings, F.col(most), F.col("n"), F.col("least")) & (F.col(most) * 100 >= F.col("n") * settings.percent)


def _frequencies(sets: DataFrame, nodes: DataFrame, steps: Steps) -> tuple[DataFrame, DataFrame]:
    """Of some nodes: (node, lone, rare) counts of shingles, and (node, shingle) of the rare ones.

    lone shingles are in no other of these sets, rare ones in 2 to FEW.
    """
    tokens = steps.written(sets.join(if_small(nodes), "node").select("node", "shingles").mapInArrow(_listed, "node long, shingle long"), "tokens")
    df = tokens.groupBy("shingle").agg(F.count("*").alias("df"), F.min("node").alias("node")).where(F.col("df") <= FEW)
    df = steps.written(df, "df")
    rare = steps.written(tokens.join(df.where("df > 1").select("shingle"), "shingle"), "rare")
    lone = df.where("df = 1").groupBy("node").agg(F.count("*").alias("lone"))
    counts = nodes.join(lone, "node", "left").join(rare.groupBy("node").agg(F.count("*").alias("rare")), "node", "left")
    return steps.written(counts.fillna(0, ["lone", "rare"]), "counts"), rare


def _apart(enough: DataFrame, sets: DataFrame, settings: Settings, steps: Steps) -> DataFrame:
    """Pairs (u, v) of one bucket and two components that distances to representatives do not rule out.

    1 - Jaccard is a metric. With a representative r of each component, two
    members x and z of components A and B can only be linked if
    d(x, rA) + d(z, rB) >= d(rA, rB) - (1 - threshold). So each member is compared
    with the representative of its own component, and each two representatives
    whose components share a bucket; two tight families of near copies are then
    told apart by one comparison. enough: bucket, node, n, common, component.
    """
    far = 1 - settings.percent / 100 + 1e-9
    distance = (1 - F.col("both") / (F.col("nu") + F.col("nv") - F.col("both"))).alias("d")
    nodes = steps.written(enough.select("node", "component").distinct(), "nodes")
    reps = steps.written(nodes.groupBy("component").agg(F.min("node").alias("rep")), "reps")
    own = nodes.join(if_small(reps), "component").where("node <> rep").select(F.col("rep").alias("u"), F.col("node").alias("v"))
    own = steps.written(_compared(own, sets).select(F.col("v").alias("node"), distance), "own")
    nodes = steps.written(nodes.join(if_small(own), "node", "left").fillna(0.0, ["d"]), "distances")
    whole = nodes.groupBy("component").agg(F.max("d").alias("radius"), F.count("*").alias("nodes")).join(reps, "component")
    held = steps.written(enough.groupBy("bucket", "component").agg(F.min("n").alias("low"), F.max("n").alias("high")).join(whole, "component"), "held")
    a, b = (held.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("component", "nodes", "low", "high", "rep", "radius")]) for x in "ab")
    sizes = (F.col("high_a") * 100 >= F.col("low_b") * settings.percent) & (F.col("high_b") * 100 >= F.col("low_a") * settings.percent)
    larger = F.struct("nodes_a", "component_a") > F.struct("nodes_b", "component_b")  # so b is the smaller one
    met = a.join(b, "bucket").where(larger & sizes).select("bucket", "component_a", "component_b", "rep_a", "rep_b", "radius_a", "radius_b")
    met = steps.written(met, "met")
    between = _compared(met.select(F.col("rep_a").alias("u"), F.col("rep_b").alias("v")).distinct(), sets)
    met = met.join(between.select(F.col("u").alias("rep_a"), F.col("v").alias("rep_b"), distance), ["rep_a", "rep_b"])
    met = met.where(F.col("radius_a") + F.col("radius_b") >= F.col("d") - far)
    met = steps.written(met.select("bucket", "component_a", "component_b", "radius_a", F.col("d").alias("between")), "close")

    buckets = enough.groupBy("node").agg(F.collect_set("bucket").alias("buckets"))  # one for each band at most
    at = if_small(steps.written(nodes.select("node", "d").join(buckets, "node"), "buckets"))
    member = enough.join(at, "node").select("bucket", "component", "node", "n", "common", "d", "buckets")
    a, b = (member.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in member.columns[1:]]) for x in "ab")
    smaller = b.join(if_small(met), ["bucket", "component_b"]).where(F.col("d_b") + F.col("radius_a") >= F.col("between") - far)
    pairs = smaller.join(a, ["bucket", "component_a"]).where(F.col("d_a") + F.col("d_b") >= F.col("between") - far)
    pairs = pairs.where(_near_size(settings, F.col("n_a"), F.col("n_b"))).where(_enough(settings, F.least("common_a", "common_b"), F.col("n_a"), F.col("n_b")))
    # Each pair once, in the least of the buckets it shares.
    pairs = pairs.where(F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket"))
    return pairs.select(F.least("node_a", "node_b").alias("u"), F.greatest("node_a", "node_b").alias("v"))


def _rest(members: DataFrame, found: DataFrame, tried: DataFrame, sets: DataFrame, settings: Settings, steps: Steps) -> DataFrame:
    """Links that the comparison with the first of each bucket has not shown.

    What two documents share is at most the smaller number of their common
    shingles (those in more than FEW documents) plus the rare shingles they share.
    So a pair in one bucket and two components that can still be similar either
    shares a rare shingle, which the join on those finds (FEW * FEW / 2 pairs for
    a shingle at most), or has enough common shingles on both sides; of the
    latter `_apart` rules out what it can.
    """
    no_links = sets.sparkSession.createDataFrame([], "u long, v long")
    left = _open_buckets(members, found, steps)
    if left.isEmpty():
        return no_links
    counts, rare = _frequencies(sets, steps.written(left.select("node").distinct(), "nodes"), steps)
    facts = F.col("n") - F.col("lone")
    left = left.join(if_small(counts), "node").select("bucket", "node", "n", "least", "component", facts.alias("most"), (facts - F.col("rare")).alias("common"))
    left = steps.written(left.where(_reachable(settings, "most")), "left")

    # Once more a star, now around the member with the largest share of common shingles.
    best = F.struct(F.col("common") / F.col("n"), -F.col("node"), *[F.col(c).alias(f"hub_{c}") for c in ("node", "n", "component")])
    hub = steps.written(left.groupBy("bucket").agg(F.max(best).alias("hub")).select("bucket", "hub.hub_node", "hub.hub_n", "hub.hub_component"), "hubs")
    star = left.join(if_small(hub), "bucket").where("component <> hub_component").where(_near_size(settings, F.col("n"), F.col("hub_n")))
    star = star.select(F.least("node", "hub_node").alias("u"), F.greatest("node", "hub_node").alias("v")).distinct()
    star = steps.written(star.join(tried, ["u", "v"], "left_anti"), "star")
    links = steps.written(_links(_compared(star, sets), settings), "links")
    if not links.isEmpty():
        joined = components(links.unionByName(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        left = _open_buckets(left.drop("component", "least"), joined, steps)
        left = steps.written(left.where(_reachable(settings, "most")), "left")
    tried = tried.unionByName(star)

    info = steps.written(left.select("node", "n", "common", "component").distinct(), "info")
    of = lambda x: info.select(*[F.col(c).alias(f"{c}_{x}") for c in info.columns])
    ours = rare.join(if_small(info.select("node")), "node")
    shared = ours.select("shingle", F.col("node").alias("node_a")).join(ours.select("shingle", F.col("node").alias("node_b")), "shingle").where("node_a < node_b")
    shared = shared.groupBy("node_a", "node_b").agg(F.count("*").alias("c")).join(of("a"), "node_a").join(of("b"), "node_b")
    shared = shared.where("component_a <> component_b").where(_near_size(settings, F.col("n_a"), F.col("n_b")))
    shared = shared.where(_enough(settings, F.least("common_a", "common_b") + F.col("c"), F.col("n_a"), F.col("n_b")))
    shared = shared.select(F.col("node_a").alias("u"), F.col("node_b").alias("v"))
    enough = steps.written(left.where(_reachable(settings, "common")).select("bucket", "node", "n", "common", "component"), "enough")
    alike = _apart(enough, sets, settings, steps)
    pairs = steps.written(shared.unionByName(alike).distinct().join(tried, ["u", "v"], "left_anti"), "pairs")
    return links.unionByName(_links(_compared(pairs, sets), settings))


def classes(documents: DataFrame, settings: Settings = AT_85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, h, n, component, first_id and first_h of every document.

    n is the size of its set of shingles, component the smallest id it reaches
    over links of at least `percent`; A-Z are lower-cased and white space parts
    words. Null and blank texts have no shingles and link to nothing. Every row is
    linked by its own text, also where ids repeat or are null; a null id is no
    smallest id, so a component without any other has a null one. h is a hash of
    the text; (first_id, first_h) is the first row of the component by id (nulls
    last) and h. An empty table gives an empty result.

    1. Documents with equal sets are one node, so thousands of copies cost one
       row in what follows. 2. Nodes that share a band of the signature share a
       bucket. Each member is compared, on full sets, with the bucket's first one
       only: a bucket of g members makes g - 1 pairs. 3. What is left are buckets
       whose members are not yet one component; `_rest` compares, by exact bounds
       on what two sets can share, every pair that can still be a link. No
       candidate is given up.
    """
    with Steps(documents.sparkSession, "near-dup") as steps:
        rows = documents.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
        signed = steps.written(rows.mapInArrow(_signed(settings), "id long, h long, n long, digest binary, bands array<long>"), "signed")
        place = F.struct(F.col("id").isNull().alias("late"), "id", "h")
        nodes = signed.where("digest IS NOT NULL").groupBy("digest").agg(F.first("n").alias("n"), F.first("bands").alias("bands"), F.min(place).alias("at"))
        nodes = steps.written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
        spread = nodes.select("node", "n", F.explode("bands").alias("bucket"))
        shared = spread.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("first")).where("size > 1")
        members = steps.written(spread.join(shared.select("bucket", "first"), "bucket"), "members")
        wanted = members.select("node").distinct().join(nodes, "node").select("node", F.col("at.id").alias("id"), F.col("at.h").alias("h"))
        wanted = if_small(steps.written(wanted, "wanted"))
        mine = rows["id"].eqNullSafe(wanted["id"]) & (rows["h"] == wanted["h"])
        sets = rows.join(wanted, mine).select("node", "text").mapInArrow(_sets(settings), "node long, shingles binary")
        sets = steps.written(sets.dropDuplicates(["node"]), "sets")  # rows may be equal in id and text

        size = nodes.select(F.col("node").alias("u"), F.col("n").alias("nu"))
        stars = members.where("first <> node").select(F.col("first").alias("u"), F.col("node").alias("v"), F.col("n").alias("nv")).distinct()
        pairs = stars.join(size, "u").where(_near_size(settings, F.col("nu"), F.col("nv")))
        pairs = steps.written(pairs.select("u", "v"), "pairs")
        links = steps.written(_links(_compared(pairs, sets), settings), "links")
        found = components(links)
        more = steps.written(_rest(members.select("bucket", "node", "n"), found, pairs, sets, settings, steps), "links")
        if not more.isEmpty():
            found = components(links.unionByName(more))
        linked = steps.written(nodes.select("node", "at").join(if_small(found), "node").select("node", "at", "component"), "linked")
        whole = steps.written(linked.groupBy("component").agg(F.min("at.id").alias("smallest"), F.min("at").alias("first")), "whole")
        linked = linked.join(if_small(whole), "component").select("node", "smallest", "first")
        joined = nodes.select("node", "digest", "at").join(linked, "node", "left")
        first, alone = F.coalesce("first", "at"), F.col("first").isNull()
        of_set = joined.select("digest", F.when(alone, F.col("at.id")).otherwise(F.col("smallest")).alias("smallest"), first["id"].alias("first_id"), first["h"].alias("first_h"))
        out = signed.select("id", "h", "n", "digest").join(of_set, "digest", "left")
        alone = F.col("digest").isNull()
        own = lambda c, x: F.when(alone, F.col(x)).otherwise(F.col(c)).alias(c)
        return written(out.select("id", "h", "n", F.when(alone, F.col("id")).otherwise(F.col("smallest")).alias("component"), own("first_id", "id"), own("first_h", "h")), "classes")


def near_duplicates(documents: DataFrame, settings: Settings = AT_85) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; see `classes`.

    kept: the document's id is its component's. A null id is kept if its component has no other.
    """
    found = classes(documents, settings)
    kept = F.coalesce(F.col("id") == F.col("component"), F.col("component").isNull())
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))


def deduplicated(documents: DataFrame, settings: Settings = AT_80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, of which one of each component stays.

    The first one by id (null ids last) and hash of the text stays; rows equal in
    both are one document and stay or go together. Texts without words all stay.
    """
    first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h"))
    gone = classes(documents, settings, id_col, text_col).where(~first).select(F.col("id").alias("_gone"), F.col("h").alias("_gone_h"))
    gone = if_small(written(gone.distinct(), "gone"))
    return documents.join(gone, documents[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(documents[text_col]) == gone["_gone_h"]), "left_anti")
