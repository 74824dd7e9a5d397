"""Rule bitmask ledger: each quality rule is measured once, policies read the bits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import no_text

#: White space that parts words, as a set for translate() and as a pattern.
SPACES = " \t\n\x0b\f\r"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

WINDOW = 8

#: Rules: name and the condition, over the measurements, under which a text fails.
#: A rule's bit is its place here; new rules go to the end, none is reused.
RULES: tuple[tuple[str, str], ...] = (
    ("too_few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("too_many_words", "n_words > 1000000"),
    ("short_mean_word", "word_chars < 2 * n_words"),
    ("long_mean_word", "word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    ("exclamations", "5 * n_exclamations > n_words"),
)
BITS = {name: k for k, (name, _) in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named version: the rules of which no one may fail, and how many others may."""

    name: str
    version: int
    must_pass: tuple[str, ...]
    may_fail: tuple[str, ...] = ()
    most: int = 0

    def mask(self, rules: tuple[str, ...]) -> int:
        return sum(1 << BITS[r] for r in rules)

    def keeps(self, ledger: str = "failed_bits") -> Column:
        bits = F.col(ledger)
        hard = bits.bitwiseAND(F.lit(self.mask(self.must_pass))) == 0
        return hard & (F.bit_count(bits.bitwiseAND(F.lit(self.mask(self.may_fail)))) <= self.most)


BASE = Policy("base", 1, ("too_few_words", "repeated_words"))
WEB_V1 = Policy("web", 1, ("too_few_words", "repeated_words", "too_many_words", "symbols", "exclamations"), ("short_mean_word", "long_mean_word", "duplicate_lines"), 1)
WEB_V2 = Policy("web", 2, tuple(name for name, _ in RULES))
POLICIES = (BASE, WEB_V1, WEB_V2)


def _without(text: Column, letters: str) -> Column:
    """The text without those characters: one pass of a byte search for each."""
    for x in letters:
        text = F.replace(text, F.lit(x))
    return text


def _paired(hashes: str, step: int) -> Column:
    """The hash of each element with the one `step` further on."""
    return F.zip_with(F.col(hashes), F.slice(hashes, step + 1, 1 << 30), lambda a, b: F.xxhash64(a, b))


def _covered(windows: Column) -> Column:
    """Words inside windows that are found twice or more.

    Sorted by (hash, place), equal neighbours are the repeated windows; the union
    of their spans is the sum of the gaps between their places, WINDOW at most each.
    """
    ordered = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    marked = F.zip_with(
        ordered,
        F.concat(F.array(F.lit(None).cast("struct<w:bigint,i:int>")), ordered),
        lambda x, y: F.when(x["w"] == y["w"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")),
    )
    at = F.sort_array(F.array_distinct(F.flatten(marked)))
    return F.aggregate(
        at,
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("sum")),
        lambda a, i: F.struct(i.alias("last"), (a["sum"] + F.least(F.lit(WINDOW), i - a["last"])).alias("sum")),
        lambda a: a["sum"],
    )


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements of every whole text, each taken once; null counts as empty.

    n_repeat_words: words inside 8-word windows that occur twice or more in the
    text. Windows are 64-bit hashes of word hashes, built by doubling (2, 4, 8
    words); only a text with fewer different windows than windows is looked at
    closer. All of it stays within a row, so there is no shuffle, and the cost is
    n log n in the words of one text at worst. Repeated ids give a row each.
    """
    text = no_text(F.col(text_col))
    inner = F.btrim(text, F.lit(SPACES))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_PATTERN))
    df = documents.select(F.col(id_col), text.alias("text"), words.alias("words"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = df.select(id_col, F.transform("words", lambda w: F.xxhash64(w)).alias("h"), lines.alias("lines"), _without(F.col("text"), SPACES).alias("bare"))
    df = df.select("*", _paired("h", 1).alias("h2")).select("*", _paired("h2", 2).alias("h4"))
    df = df.select("*", F.slice(_paired("h4", 4), F.lit(1), F.greatest(F.size("h") - WINDOW + 1, F.lit(0))).alias("windows"))
    count = lambda letters: (F.length("bare") - F.length(_without(F.col("bare"), letters))).cast("long")
    return df.select(
        id_col,
        F.size("h").cast("long").alias("n_words"),
        F.length("bare").cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long")).otherwise(_covered(F.col("windows"))).alias("n_repeat_words"),
        count("!").alias("n_exclamations"),
    )


def ledger(measurements: DataFrame) -> DataFrame:
    """The measurements with failed_bits: bit k is set where rule k fails."""
    bits = F.lit(0).cast("long")
    for k, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    return measurements.withColumn("failed_bits", bits)


def judged(ledgers: DataFrame, policy: Policy) -> DataFrame:
    """The ledger with base_failed and the policy's verdict, kept."""
    base = ~BASE.keeps()
    return ledgers.withColumns({"base_failed": base, "kept": ~base & policy.keeps(), "policy": F.lit(f"{policy.name}-v{policy.version}")})


def ablations(ledgers: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of a policy: how many texts fail it, fail it alone, and would stay without it.

    One pass: texts are counted by their failure bits first, which leaves at most
    2 ** len(RULES) rows whatever the corpus holds; the rest is bitwise arithmetic
    on those counts. n_only: fail no other rule of the policy, tolerated ones
    included. n_stay: are not kept (see `judged`), but would be if the rule were in
    neither the policy nor the base. all_bits and common_bits are the or and the
    and over the texts that fail the rule. An empty ledger gives zeros and null bits.
    """
    rules = policy.must_pass + policy.may_fail
    mask = policy.mask(rules)
    counts = ledgers.groupBy("failed_bits").agg(F.count("*").alias("n"))
    listed = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).cast("long").alias("bit")) for r in rules]))
    each = ledgers.sparkSession.range(1).select(listed.alias("r")).select("r.*")
    hit = F.col("failed_bits").bitwiseAND(F.col("bit")) != 0
    joined = each.join(F.broadcast(counts), hit, "left").withColumn("rest", F.col("failed_bits").bitwiseAND(F.bitwise_not("bit")))
    alone = F.col("failed_bits").bitwiseAND(F.lit(mask)) == F.col("bit")
    keeps = lambda bits: BASE.keeps(bits) & policy.keeps(bits)
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    return joined.groupBy("rule").agg(count(hit).alias("n_failed"), count(alone).alias("n_only"), count(~keeps("failed_bits") & keeps("rest")).alias("n_stay"), F.expr("bit_or(failed_bits)").alias("all_bits"), F.expr("bit_and(failed_bits)").alias("common_bits"))
