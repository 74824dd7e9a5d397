"""Results of searches: fusion, ranking, gates and picking."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane import constants as C
from corvane.functions.urls import host, path
from corvane.sources.shared import numbered


@dataclass(frozen=True)
class Plan:
    """What is searched for: the entity, related terms, what it must not be, and the user's words."""

    entity: str
    related: tuple[str, ...] = ()
    negatives: tuple[str, ...] = ()
    raw: str = ""
    industries: tuple[str, ...] = ()
    aliases: tuple[str, ...] = field(default=())

    @property
    def head(self) -> str | None:
        """The longest run of three or more latin letters in the entity, the first of equals."""
        runs = [r for r in re.findall("[a-z]+", self.entity.lower()) if len(r) >= 3]
        return max(runs, key=len) if runs else None


def fused(results: DataFrame, order: Sequence[str] = ("provider", "rank", "page_id")) -> DataFrame:
    """One row for each normal url: the first arrival, gaps filled from later ones, and its providers.

    `order` is the total order of arrival. Everything is one aggregation on the
    url, partially done before the shuffle.
    """
    at = F.struct(*[F.col(c) for c in order])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at)).alias(c)
    base = lambda c: F.min_by(c, at).alias(c)
    out = results.groupBy("norm_url").agg(base("url"), base("title"), first("snippet"), first("published"), base("rank"), F.array_sort(F.collect_set("provider")).alias("sources"))
    return out.withColumn("hit_count", F.size("sources"))


def merged_signals(signals: DataFrame) -> DataFrame:
    """Largest value of each label of a result."""
    return signals.groupBy("id", "label").agg(F.max("value").alias("value"))


def signal_magnitude(signals: Column) -> Column:
    """Sum of log10(1 + value) over an array of (label, value), negatives as 0."""
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + F.log10(1 + F.greatest(F.lit(0.0), s["value"])))


def time_filtered(results: DataFrame, span: str | None, now: str, date_col: str = "published") -> DataFrame:
    """Rows dated within the span before now, or without a date."""
    if span is None:
        return results
    cutoff = F.lit(now).cast("timestamp") - F.expr(f"interval {C.RANGES[span]} days")
    return results.where(F.col(date_col).isNull() | (F.col(date_col).cast("timestamp") >= cutoff))


def ranked(results: DataFrame, mode: str, now: str, limit: int | None = None) -> DataFrame:
    """Results in one of the orders relevant, quality, recent and mixed, with their place.

    Needs hit_count, relevance, industry, rank, norm_url, published, magnitude.
    Ties end at the normal url, which is unique. The place is the number in the
    sorted order, counted range by range; a limit keeps Spark at a top-k without a
    full sort.
    """
    age = F.greatest(F.datediff(F.lit(now).cast("date"), "published"), F.lit(0))
    mixed = 2 * F.col("hit_count") + F.when(F.col("published").isNull(), 0.25).otherwise(3 * F.pow(F.lit(0.5), age / 30))
    evidence = [F.desc("hit_count"), F.coalesce("relevance", F.lit(0.0)).desc(), F.coalesce("industry", F.lit(0.0)).desc(), F.asc("rank"), F.asc("norm_url")]
    first = {"relevant": [], "quality": [(F.col("magnitude") > 0).desc(), F.desc("magnitude")], "recent": [F.desc_nulls_last("published")], "mixed": [F.round(mixed, 9).desc()]}[mode]
    if limit is None:
        return numbered(results, [*first, *evidence], "place")
    top = results.orderBy(*first, *evidence).limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(*first, *evidence)))


def off_topic(title: Column, url: Column, wanted: str = "") -> Column:
    """招聘, 招标采购, 二手交易 or 用户个人主页; null for others or what the user asks for."""
    at, where = host(url), path(url)
    in_any = lambda domains: F.coalesce(at.rlike(r"(^|\.)(" + "|".join(map(re.escape, domains)) + ")$"), F.lit(False))
    job_sub = F.split_part(F.coalesce(at, F.lit("")), F.lit("."), F.lit(1)).isin(*C.JOB_SUBDOMAINS)
    job_title = title.rlike("|".join(f"(?:{t})" for t in C.JOB_TITLES))
    rules = (("招聘", in_any(C.JOB_DOMAINS)), ("二手交易", in_any(C.TRADE_DOMAINS)), ("招聘", job_sub), ("用户个人主页", F.coalesce(at.startswith("space."), F.lit(False))), ("招聘", where.rlike(C.JOB_PATH)), ("用户个人主页", where.rlike(r"^/(user|people|u)/")), ("招标采购", title.rlike(C.TENDER_TITLE)), ("招聘", job_title), ("二手交易", title.rlike(C.TRADE_TITLE)))
    out = F.lit(None).cast("string")
    for name, rule in reversed(rules):
        if name not in wanted:
            out = F.when(F.coalesce(rule, F.lit(False)), name).otherwise(out)
    return out


def lexical_relevance(title: Column, snippet: Column, url: Column, plan: Plan) -> Column:
    """struct(verdict, score, match, reason) by the words of a result."""
    text = F.lower(F.concat_ws(" ", title, snippet))
    genre = off_topic(title, url, plan.raw)
    hits = sum((F.contains(text, F.lit(t.lower())).cast("int") for t in plan.related), F.lit(0))
    negative = F.lit(False)
    for t in plan.negatives:
        negative = negative | F.contains(text, F.lit(t.lower()))
    head = F.contains(text, F.lit(plan.head)) if plan.head else F.lit(False)
    say = lambda v, s, m, r: F.struct(F.lit(v).alias("verdict"), (s if isinstance(s, Column) else F.lit(float(s))).alias("score"), F.lit(m).cast("string").alias("match"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    rest = say("uncertain", 0.5, None, "no name to look for") if not plan.head else say("unlikely", 0.05, None, "name absent")
    return (
        F.when(genre.isNotNull(), say("unlikely", 0.05, None, genre)).when(~head & (hits == 0), rest).when(negative, say("uncertain", 0.35, None, "negative term"))
        .when(~head, say("likely", F.least(F.lit(0.85), 0.55 + 0.1 * hits), "related", "related terms")).otherwise(say("likely", 0.9, "direct", "name"))
    )


def merged_verdict(a: Column, b: Column) -> Column:
    """One verdict of a lexical and a model's: any unlikely wins, equal ones stay, others are uncertain."""
    score = F.greatest(a["score"], b["score"])
    same = a["verdict"] == b["verdict"]
    both = F.struct(F.when(same, a["verdict"]).otherwise("uncertain").alias("verdict"), score.alias("score"))
    one = lambda x: F.struct(x["verdict"].alias("verdict"), x["score"].alias("score"))
    return F.when(b.isNull(), one(a)).when(a.isNull(), one(b)).when(a["verdict"] == "unlikely", one(a)).when(b["verdict"] == "unlikely", one(b)).otherwise(both)


def candidate(title: Column, snippet: Column, url: Column) -> Column:
    """struct(tier, reasons): reject, low, usable or high."""
    title, snippet = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(snippet, F.lit("")))
    reject = F.array_compact(F.array(
        F.when(host(url).isNull(), "bad url"), F.when(~url.rlike("^(?i)https?://"), "protocol"), F.when(path(url).rlike(C.NON_CONTENT_PATH), "no content"),
        F.when((title == "") & (snippet == ""), "empty"), F.when(title.rlike(C.JUNK_TITLE), "junk title"), F.when(snippet.rlike(C.JUNK_SNIPPET), "junk snippet"),
    ))
    low = F.array_compact(F.array(F.when((F.length(title) < 4) & (F.length(snippet) < 30), "short"), F.when(F.length(snippet) < 60, "short snippet")))
    tier = F.when(F.size(reject) > 0, "reject").when(F.size(low) > 0, "low").when((F.length(title) >= 8) & (F.length(snippet) >= 80), "high").otherwise("usable")
    return F.struct(tier.alias("tier"), F.when(F.size(reject) > 0, reject).otherwise(low).alias("reasons"))


def backfilled(rows: DataFrame, accepted: Column, spare: Column, least: int, order: Sequence[str]) -> DataFrame:
    """Accepted rows, and the first spare ones in order until there are `least`."""
    short = rows.agg(F.greatest(F.lit(least) - F.count_if(accepted), F.lit(0)).alias("short"))
    extra = rows.where(spare & ~accepted).orderBy(*order).limit(least)
    extra = extra.withColumn("_nth", F.row_number().over(W.orderBy(*order))).join(F.broadcast(short)).where("_nth <= short").drop("_nth", "short")
    return rows.where(accepted).unionByName(extra)


def picked(results: DataFrame, least: int = 3) -> DataFrame:
    """What to fetch: never judged unlikely; low value only to reach `least`; then not rejected."""
    rows = results.where(~F.col("verdict").eqNullSafe("unlikely"))
    rows = backfilled(rows, ~F.col("value").eqNullSafe("low"), F.col("value") == "low", least, ["rank", "norm_url"])
    return backfilled(rows, F.col("tier").isin("high", "usable"), F.col("tier") == "low", C.MIN_TARGETS, ["rank", "norm_url"])


def avoided(results: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """Rows with `avoid`, the first pattern of two or more characters their text holds; high values are spared."""
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    hit = F.coalesce(*[F.when(F.contains(text, F.lit(p.lower())), F.lit(p)) for p in patterns if len(p) >= 2], F.lit(None).cast("string"))
    return results.withColumn("avoid", F.when(~F.col("value").eqNullSafe("high"), hit)).withColumn("value", F.when(F.col("avoid").isNotNull(), "low").otherwise(F.col("value")))


def interleaved(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Round robin over groups: first of each, then second, groups as they first appear.

    Rows are numbered in the order of (group, order) as a whole; the place within
    a group is that number less the group's first one, so a group of any size is
    spread over many tasks.
    """
    at = numbered(rows, [F.asc(group), *[F.asc(c) for c in order]], "_at")
    start = at.groupBy(F.col(group).alias("_group")).agg(F.min(F.struct(*order)).alias("start"), F.min("_at").alias("_first"))
    both = at.join(start, F.col(group).eqNullSafe(F.col("_group"))).withColumn("nth", F.col("_at") - F.col("_first") + 1)
    return both.orderBy("nth", "start").drop("start", "_group", "_first", "_at")


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows in place of old ones with the same key; the last of new rows by `seq`."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) for c in new.columns]), "seq").alias("row")).select("row.*")
    return old.join(last.select(key), key, "left_anti").unionByName(last.select(*old.columns))


def chunked(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Consecutive batches of k rows, numbered from 0."""
    return numbered(rows, [F.asc(c) for c in order], "_at").withColumn("batch", F.floor((F.col("_at") - 1) / k)).drop("_at")


def within_budget(rows: DataFrame, eligible: Column, order: Sequence[str], budget: int = 8) -> DataFrame:
    """The first `budget` eligible rows in order of arrival."""
    return rows.where(eligible).orderBy(*order).limit(budget)


def refreshed(results: DataFrame, fresh: DataFrame, previous: DataFrame, key: str = "norm_url") -> DataFrame:
    """Results with their fresh document, else the one they had; results without any go.

    fresh and previous: key and document, one row a key (the last by `document` is
    taken). Old documents stay only where their url is still a result.
    """
    one = lambda x, c: x.groupBy(key).agg(F.max("document").alias(c))
    rows = results.join(one(fresh, "_fresh"), key, "left").join(one(previous, "_old"), key, "left")
    return rows.withColumn("document", F.coalesce("_fresh", "_old")).drop("_fresh", "_old").where("document IS NOT NULL")


def selected(rows: DataFrame, keys: DataFrame | None, on: str) -> DataFrame:
    """Rows whose key is among the given ones, by a semi-join; all of them without keys."""
    return rows if keys is None else rows.join(keys.select(on), on, "left_semi")


def of_kind(rows: DataFrame, want: str = "all") -> DataFrame:
    """All rows, only videos, or only what is no video."""
    return rows if want == "all" else rows.where(F.col("kind").eqNullSafe("video") == F.lit(want == "video"))


def shown(rows: DataFrame, hide_unlikely: bool = False, hide_low: bool = False, hide_unmatched: bool = False) -> DataFrame:
    """Rows of a result list that the switches leave; what is not known is never hidden."""
    keep = F.lit(True)
    if hide_unlikely:
        keep = keep & ~F.col("verdict").eqNullSafe("unlikely")
    if hide_low:
        keep = keep & ~F.col("value").eqNullSafe("low")
    if hide_unmatched:
        keep = keep & F.coalesce(F.size("industries") != 0, F.lit(True))
    return rows.where(keep)


def unmatched(rows: DataFrame) -> DataFrame:
    """How many rows match no industry."""
    return rows.agg(F.count_if(F.size("industries") == 0).alias("unmatched"))


def most_relevant(rows: DataFrame, most: int, *then: str) -> DataFrame:
    """The `most` rows of largest relevance (none counts as 0), then of the largest of the other columns; ids last."""
    return rows.orderBy(F.coalesce("relevance", F.lit(0.0)).desc(), *[F.desc(c) for c in then], "doc_id").limit(most)


def enough(rows: DataFrame, order: Sequence[str], count: str, least: int = 12) -> DataFrame:
    """Steps of a chain that still run: those before which fewer than `least` results were collected.

    rows: one for each step of a chain, which are few; count: its results.
    """
    before = F.coalesce(F.sum(count).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("before", before).where(F.col("before") < least)


def merged_lists(a: Column, b: Column) -> Column:
    """Distinct strings of both lists in order of first mention; a null list is empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(a, none), F.coalesce(b, none)))
