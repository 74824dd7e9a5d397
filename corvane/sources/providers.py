"""Answers of search providers, as JSON in a table, made search results.

Each function takes rows of (query, json), one for each answer, and gives one row
for each result: query, rank (from 1 within the answer), result_id, title, url,
snippet, domain, site, provider, raw_date, author, thumbnail, duration and signals
(label, value). An answer that is no JSON gives none. Lists stay within their row
until they are filtered and cut, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import html, text, urls

SIGNALS = "array<struct<label:string,value:double>>"


def _or(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def _signals(*pairs: tuple[str, Column]) -> Column:
    listed = F.array(*[F.struct(F.lit(n).alias("label"), v.cast("double").alias("value")) for n, v in pairs]).cast(SIGNALS)
    return text.compact_signals(listed)


def _results(answers: DataFrame, schema: str, items: str, provider: str, keep: Callable[[Column], Column], limit: int | None, **columns: Callable[[Column], Column]) -> DataFrame:
    parsed = answers.select("query", F.from_json("json", schema).alias("a")).select("query", F.filter(F.col(f"a.{items}"), keep).alias("items"))
    parsed = parsed.withColumn("items", F.slice("items", 1, limit)) if limit else parsed
    rows = parsed.select("query", F.posexplode("items").alias("nth", "r"))
    r, none = F.col("r"), F.lit(None)
    url = columns["url"](r)
    get = lambda name, kind="string": columns[name](r).cast(kind) if name in columns else none.cast(kind)
    rank = F.coalesce(get("position", "int"), F.col("nth") + 1)
    site = F.coalesce(get("site"), urls.site_of(url))
    return rows.select(
        "query", rank.alias("rank"), urls.result_id(urls.normalize_url(url)).alias("result_id"), _or(columns["title"](r), url).alias("title"), url.alias("url"),
        F.coalesce(F.trim(get("snippet")), F.lit("")).alias("snippet"), urls.display_domain(url).alias("domain"), site.alias("site"), F.lit(provider).alias("provider"),
        get("date").alias("raw_date"), get("author").alias("author"), get("thumbnail").alias("thumbnail"), get("duration", "int").alias("duration"), get("signals", SIGNALS).alias("signals"),
    )


def searx(answers: DataFrame, domain: str = "", limit: int = 20) -> DataFrame:
    """Results of a meta search: those of the domain only, as engines do not keep to it, the first `limit`."""
    schema = "results array<struct<url:string,title:string,content:string,publishedDate:string,thumbnail:string>>"
    keep = lambda r: r["url"].isNotNull() & (r["url"] != "") & urls.belongs_to(r["url"], domain)
    return _results(answers, schema, "results", "searxng", keep, limit, url=lambda r: r["url"], title=lambda r: r["title"], snippet=lambda r: r["content"], date=lambda r: r["publishedDate"], thumbnail=lambda r: r["thumbnail"])


def serper(answers: DataFrame) -> DataFrame:
    """Results of a web search; the rank is the position it gives, else the place in the list."""
    schema = "organic array<struct<link:string,title:string,snippet:string,position:int,date:string,imageUrl:string>>"
    keep = lambda r: r["link"].isNotNull() & (r["link"] != "")
    return _results(answers, schema, "organic", "serper", keep, None, url=lambda r: r["link"], title=lambda r: r["title"], snippet=lambda r: r["snippet"], date=lambda r: r["date"], thumbnail=lambda r: r["imageUrl"], position=lambda r: r["position"])


def videos(answers: DataFrame, limit: int = 30) -> DataFrame:
    """Results of a video search: the last thumbnail, else the default one."""
    schema = "entries array<struct<id:string,title:string,description:string,channel:string,uploader:string,upload_date:string,duration:double,view_count:double,thumbnails:array<struct<url:string>>>>"
    keep = lambda r: r["id"].isNotNull() & (r["id"] != "")
    thumbnail = lambda r: F.coalesce(F.try_element_at(r["thumbnails"], F.lit(-1))["url"], F.concat(F.lit("https://i.ytimg.com/vi/"), r["id"], F.lit("/mqdefault.jpg")))
    return _results(
        answers, schema, "entries", "yt-dlp", keep, limit, url=lambda r: F.concat(F.lit("https://www.youtube.com/watch?v="), r["id"]), title=lambda r: _or(r["title"], r["id"]), snippet=lambda r: F.substring(r["description"], 1, 300),
        site=lambda _: F.lit("youtube"), date=lambda r: r["upload_date"], author=lambda r: F.coalesce(r["channel"], r["uploader"]), thumbnail=thumbnail, duration=lambda r: r["duration"], signals=lambda r: _signals(("播放", r["view_count"])),
    )


def bilibili(answers: DataFrame, limit: int = 20) -> DataFrame:
    """Results of a video site's own search; answers with a code other than 0 give none."""
    schema = "code int, data struct<result:array<struct<arcurl:string,bvid:string,title:string,description:string,author:string,pic:string,pubdate:string,duration:string,play:double,danmaku:double,like:double>>>"
    answers = answers.where(F.get_json_object("json", "$.code") == "0")
    link = lambda r: F.coalesce(F.regexp_replace(F.nullif(r["arcurl"], F.lit("")), "^http://", "https://"), F.concat(F.lit("https://www.bilibili.com/video/"), r["bvid"]))
    return _results(
        answers, schema, "data.result", "bilibili", lambda r: link(r).isNotNull(), limit, url=link, title=lambda r: html.stripped(r["title"]), snippet=lambda r: html.stripped(r["description"]), site=lambda _: F.lit("bilibili"),
        date=lambda r: r["pubdate"], author=lambda r: r["author"], thumbnail=lambda r: urls.absolute(r["pic"]), duration=lambda r: text.seconds(r["duration"]), signals=lambda r: _signals(("播放", r["play"]), ("弹幕", r["danmaku"]), ("点赞", r["like"])),
    )


def stories(answers: DataFrame) -> DataFrame:
    """Results of a story search: those with a title, the story's own page where it has no url."""
    schema = "hits array<struct<objectID:string,title:string,url:string,story_text:string,created_at:string,author:string,points:double,num_comments:double>>"
    return _results(
        answers, schema, "hits", "hackernews", lambda r: r["title"].isNotNull() & (r["title"] != ""), None, url=lambda r: _or(r["url"], F.concat(F.lit("https://news.ycombinator.com/item?id="), r["objectID"])), title=lambda r: r["title"],
        snippet=lambda r: F.substring(html.stripped(r["story_text"]), 1, 300), date=lambda r: r["created_at"], author=lambda r: r["author"], signals=lambda r: _signals(("赞", r["points"]), ("评论", r["num_comments"])),
    )


def repositories(answers: DataFrame) -> DataFrame:
    """Results of a search for code, dated by the last push; signals are counts of stars, forks and issues."""
    schema = "items array<struct<html_url:string,full_name:string,description:string,language:string,pushed_at:string,owner:struct<login:string>,stargazers_count:double,forks_count:double,open_issues_count:double>>"
    return _results(
        answers, schema, "items", "github", lambda r: r["html_url"].isNotNull() & (r["html_url"] != ""), None, url=lambda r: r["html_url"], title=lambda r: r["full_name"], site=lambda _: F.lit("github"),
        snippet=lambda r: F.substring(F.concat_ws(" · ", r["description"], r["language"]), 1, 300), date=lambda r: r["pushed_at"], author=lambda r: r["owner"]["login"],
        signals=lambda r: _signals(("star", r["stargazers_count"]), ("fork", r["forks_count"]), ("issue", r["open_issues_count"])),
    )


def feed_results(entries: DataFrame, terms: Column, limit: int, each: int = 20) -> DataFrame:
    """The newest `limit` entries of all feeds that match a term, ranked anew.

    entries: feed, nth (place in the feed), title, summary, url, published; the
    first `each` of a feed are read. terms: an array of lower-case terms.
    """
    body = F.lower(F.concat_ws(" ", "title", "summary"))
    near = entries.where(F.col("nth") <= each).where(F.exists(terms, lambda t: F.contains(body, t)))
    return near.orderBy(F.desc_nulls_last("published"), "url").limit(limit)


def probed(entries: DataFrame, sample: int = 3) -> DataFrame:
    """feed, number of entries, date of the first and the titles of the first three; entries: feed, nth, title, published."""
    at = F.row_number().over(W.partitionBy("feed").orderBy("nth"))
    few = entries.withColumn("_at", at).where(F.col("_at") <= sample)  # the limit goes before the shuffle
    first = few.groupBy("feed").agg(F.min_by("published", "_at").alias("latest"), F.sort_array(F.collect_list(F.struct("_at", "title")))["title"].alias("sample"))
    return entries.groupBy("feed").agg(F.count("*").alias("n")).join(first, "feed")
