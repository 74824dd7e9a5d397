"""From a search result and what was fetched for it to a document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text, urls

#: Characters from which a video's own text is used at all, and from which it is whole.
LEAST_BODY, FULL_BODY = 30, 300
#: Sites whose thin pages are worth a browser.
THIN_SITES = ("zhihu", "xiaohongshu", "wechat")
#: Milliseconds the topic sources are waited for as a group.
TOPIC_BUDGET = 8000
#: Errors and notices, fixed values.
NO_BODY, THIN_BODY = "该视频没有可用的字幕与简介，仅有标题与标签", "该视频没有可用字幕，正文仅有简介与标签（%d 字）"


def first_found(candidates: Sequence[tuple[str, Column]], snippet: Column, error: Column) -> Column:
    """text, method and error of the first candidate with a text; without one, the snippet as `raw` and the error.

    candidates: names of methods and their texts, best first; a text that failed its checks is null.
    """
    found = [F.when(F.trim(t) != "", F.struct(t.alias("text"), F.lit(m).alias("method"), F.lit(None).cast("string").alias("error"))) for m, t in candidates]
    return F.coalesce(*found, F.struct(F.coalesce(snippet, F.lit("")).alias("text"), F.lit("raw").alias("method"), F.coalesce(error, F.lit("unknown")).alias("error")))


def projected(rows: DataFrame) -> DataFrame:
    """Documents from rows of url, title, found_title, text, markdown, lang, method, error, site and any others.

    The title found on the page comes first; markdown falls back to the text, the
    language to what the text looks like. Words are counted over title and text, as
    the graph reads both.
    """
    t = F.coalesce(F.trim("text"), F.lit(""))
    title = F.coalesce(F.nullif("found_title", F.lit("")), "title", F.lit(""))
    return rows.withColumns(
        {
            "title": title, "text": t, "kind": urls.content_kind(F.col("site"), F.col("url")), "markdown": F.coalesce(F.nullif(F.trim("markdown"), F.lit("")), t), "excerpt": text.excerpt(t),
            "lang": F.coalesce("lang", text.language(t)), "word_count": text.count_words(F.concat(title, F.lit("。"), t)),
        }
    ).drop("found_title")


def wants_browser(mode: str, shell: Column, site: Column, thin: Column) -> Column:
    """Whether a fetched page goes to a browser: always, never, or on demand for shells and thin pages of some sites."""
    if mode != "on-demand":
        return F.lit(mode == "always")
    return F.coalesce(shell | (site.isin(*THIN_SITES) & thin), F.lit(False))


def worth_retry(mode: str, logged_in: Column) -> Column:
    """Whether a request that failed goes to a browser: on demand only where there is a login."""
    if mode in ("off", "always"):
        return F.lit(mode == "always")
    return F.coalesce(logged_in, F.lit(False))


def logged_in(sites: DataFrame, accounts: DataFrame, now: Column) -> DataFrame:
    """site and logged_in for each distinct site asked about; accounts: site, expires (null: never)."""
    valid = accounts.where(F.col("expires").isNull() | (F.col("expires") > now)).select("site", F.lit(True).alias("logged_in")).distinct()
    return sites.select("site").distinct().join(valid, "site", "left").fillna(False, ["logged_in"])


def video_body(description: Column, chapters: Column, transcript: Column) -> Column:
    """substantive and error of a video by the length of its own text: description, chapters (an array) and transcript."""
    parts = F.filter(F.array(description, F.array_join(chapters, "\n"), transcript), lambda p: p != "")
    n = F.length(F.regexp_replace(F.array_join(parts, "\n"), r"^\s+|\s+$", ""))
    error = F.when(n < LEAST_BODY, NO_BODY).when(n < FULL_BODY, F.format_string(THIN_BODY, n))
    return F.struct((n >= LEAST_BODY).alias("substantive"), error.alias("error"))


def in_time(arrivals: DataFrame, budget: int = TOPIC_BUDGET) -> DataFrame:
    """Results that arrived before their query was closed.

    arrivals: query, scope (site or topic), ms. A query closes when all its site
    sources are done and its topic sources are done or the budget is over.
    """
    last = lambda s: F.coalesce(F.max(F.when(F.col("scope") == s, F.col("ms"))), F.lit(0))
    closed = arrivals.groupBy("query").agg(F.greatest(last("site"), F.least(last("topic"), F.lit(budget))).alias("closed"))
    return arrivals.join(closed, "query").where("ms <= closed").drop("closed")


def targets(selected: Sequence[str], providers: DataFrame) -> DataFrame:
    """Sources that are asked, for each selected site.

    providers: provider, site (null: any site), scope, available, place. Sources of
    a site come before general ones, each by place; topic sources are asked only
    where their site is selected. The selection is what a user ticked, so it is a
    list and no table.
    """
    sites = F.array(*[F.lit(s) for s in dict.fromkeys(selected)]).cast("array<string>")
    general = F.col("site").isNull() & (F.col("scope") == "site")
    own = F.filter(F.array("site"), lambda s: F.array_contains(sites, s))
    asked = providers.where("available").withColumns({"step": F.when(general, 1).otherwise(0), "site": F.when(general, sites).otherwise(own)})
    return asked.withColumn("site", F.explode("site")).select("site", "provider", "scope", "step", "place")


def notice(irrelevant: Column, low_value: Column, low_quality: Column, browser: Column, judged_low: Column) -> Column:
    """What a fetch tells of its counters, those above 0 joined; null if there is nothing to tell."""
    said = lambda n, form: F.when(n > 0, F.format_string(form, n))
    parts = F.array_compact(
        F.array(
            said(irrelevant, "已跳过 %d 条疑似与主题不相关的结果（它们仍在列表里；想抓的话在结果里勾选这几条，再点一次抓取）"),
            said(low_value, "已跳过 %d 条预判低价值的结果（仅凭标题与摘要；在结果里勾选可以单独补抓）"),
            said(browser, "本次会话已有 %d 篇靠无头浏览器渲染拿到正文"),
            said(low_quality, "质量过滤层已跳过 %d 条明显无用/低质候选（候选不足时会自动补回低质链接）"),
            said(judged_low, "整理阶段将 %d 篇正文判为低价值（只标记不删除：它们不进拓扑，但仍可预览与下载）"),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "；"))


def refined_intent(intent: Column, missing: Column, queries: Column) -> Column:
    """The intent of a further round: the first one, missing angles and queries (arrays), empty ones left out."""
    none = F.array().cast("array<string>")
    parts = F.concat(F.array(intent), F.coalesce(missing, none), F.coalesce(queries, none))
    return F.array_join(F.filter(parts, lambda p: p != ""), "；")


def video_text(author: Column, tags: Column, description: Column, chapters: Column, transcript: Column) -> Column:
    """A video's text for the corpus, without names of fields: they would become keywords of every video."""
    parts = F.array(F.trim(author), F.array_join(tags, "、"), description, F.array_join(chapters, "\n"), transcript)
    return F.trim(F.array_join(F.filter(parts, lambda p: p != ""), "\n"))


def video_markdown(fields: Sequence[tuple[str, Column]], chapters: Column, transcript: Column) -> Column:
    """A video's text for readers: a line for each named field that has a value, then chapters and transcript."""
    lines = [F.when(F.trim(v) != "", F.concat(F.lit(f"{k}："), F.trim(v))) for k, v in fields]
    block = lambda name, body: F.when(body != "", F.concat(F.lit(f"\n{name}：\n"), body))
    return F.trim(F.array_join(F.array_compact(F.array(*lines, block("章节", F.array_join(chapters, "\n")), block("字幕", transcript))), "\n"))


def statistics(counts: Sequence[tuple[str, Column]]) -> Column:
    """Counts above 0 with their names and short numbers; empty if there are none."""
    return F.array_join(F.array_compact(F.array(*[F.when(n > 0, F.concat(F.lit(f"{k} "), text.compact_count(n))) for k, n in counts])), " · ")
