"""Shards that each hold the same mixture of sources: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import no_text, written

#: Buckets of a rank: 16 ** digits, as many as hold about MOST_ROWS rows each. A task sorts one bucket at a time.
LEAST_DIGITS, MOST_DIGITS = 3, 5
MOST_ROWS = 200_000


def _number(hexes: Column, digits: int) -> Column:
    return F.conv(F.substring(hexes, 1, digits), 16, 10).cast("long")


def _digits(n: int) -> int:
    return next((k for k in range(LEAST_DIGITS, MOST_DIGITS) if n <= MOST_ROWS * 16**k), MOST_DIGITS)


def interleave(rows: DataFrame, id_col: str, source_col: str, seed: int, n_shards: int) -> DataFrame:
    """Deal rows to shards so that each has the sources' shares and counts differ by one at most.

    Within its source a row is ranked in the order of md5(seed:id). Its place in
    the whole is the fractional rank (rank - phase) / source size, where phase in
    (0, 1] is a hash of the source: without it the single row of every tiny source
    would fall on the same place. The sorted rows are then cut into equal runs.

    No window spans a source or the table: ranks are counted within one of 4,096
    buckets of the order (up to a million, the more the more rows there are) and
    moved by the sizes of the buckets before it, so a source with a third of all
    rows is spread over all tasks, and what is gathered for the offsets has one
    row for each bucket of a source. The number of buckets changes no result.

    A null id or source counts as the empty string; null sources form a source of
    their own. Rows equal in id and source are interchangeable and each gets a
    place. An empty table gives an empty result. Returns all columns of `rows` but
    those called shard and slot, and the new shard and slot.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")])
    digits = _digits(rows.count())
    packed = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("key"),
        F.md5(F.concat(F.lit(f"{seed}/"), F.when(F.col(source_col).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(source_col).cast("string"))))).alias("stratum"),
    )
    packed = packed.withColumn("cell", F.substring("key", 1, digits))
    cells = packed.groupBy("stratum", "cell").agg(F.count("*").alias("n"))
    of = W.partitionBy("stratum")
    cells = cells.select("stratum", "cell", (F.sum("n").over(of.orderBy("cell")) - F.col("n")).alias("before"), F.sum("n").over(of).alias("size"))
    ranked = packed.withColumn("nth", F.row_number().over(W.partitionBy("stratum", "cell").orderBy("key", "row")))
    ranked = ranked.join(cells, ["stratum", "cell"])
    phase = (_number(F.col("stratum"), 8) + 1) / F.lit(float(16**8))
    place = (F.col("before") + F.col("nth") - phase) / F.col("size")
    placed = ranked.select("row", "key", "stratum", place.alias("place")).withColumn("cell", F.floor(F.col("place") * 16**digits))
    placed = written(placed, "placed")

    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"))  # at most 16 ** digits + 1 rows
    sizes = sizes.select("cell", (F.sum("n").over(W.orderBy("cell")) - F.col("n")).alias("before"), F.sum("n").over(W.partitionBy()).alias("size"))
    at = placed.withColumn("nth", F.row_number().over(W.partitionBy("cell").orderBy("place", "key", "stratum", "row")))
    at = at.join(F.broadcast(sizes), "cell").select("row", "size", (F.col("before") + F.col("nth") - 1).alias("pos"))
    shard = F.expr(f"(pos * {n_shards}) div size").cast("int")
    at = at.withColumn("shard", shard)
    begin = F.expr(f"(shard * size + {n_shards - 1}) div {n_shards}")
    return at.select("row.*", "shard", (F.col("pos") - begin).alias("slot"))


def sharded(documents: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    The law is `rows`. size is the UTF-8 bytes of the text plus one; a null text
    has size 1 and the checksum of nothing, 0. The text itself is not shuffled.
    """
    text = no_text(F.col("text"))
    rows = documents.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    dealt = interleave(rows, "doc_id", "source", seed, n_shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
