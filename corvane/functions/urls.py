"""URLs: host tests, normal form, ids, sites and kinds of content."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.constants import DOMESTIC, KEEP, PRIVATE_HOST, SITES, TRACKING


def host(url: Column) -> Column:
    """Host in lower case without port and user; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def belongs_to(url: Column, domain: str) -> Column:
    """The host is the domain or below it; an empty domain takes all, a url without a host belongs to none."""
    if not domain:
        return F.lit(True)
    return F.coalesce((host(url) == domain) | host(url).endswith("." + domain), F.lit(False))


def site_of(url: Column) -> Column:
    """Key of the first registered site the url belongs to, else `web`."""
    out = F.lit("web")
    for key, domain, _ in reversed([s for s in SITES if s[1]]):
        out = F.when(belongs_to(url, domain), key).otherwise(out)
    return F.when(belongs_to(url, "twitter.com"), "x").otherwise(out)


def display_domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def _one_of(of: Callable[[Column], Column], values: tuple[str, ...]) -> Callable[[Column], Column]:
    return lambda p: of(p).isin(*values)


def normalize_url(url: Column) -> Column:
    """https, host without www, known aliases resolved, tracking parameters out, the rest sorted, no fragment, no trailing slash.

    A url without scheme and host is only trimmed.
    """
    bare = display_domain(url)
    bare = F.when(bare.isin("twitter.com", "mobile.twitter.com"), "x.com").when(bare == "m.youtube.com", "youtube.com").otherwise(bare)
    short = bare == "youtu.be"
    where = F.when(short, "youtube.com").otherwise(bare)
    keys = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    params = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~keys(p).rlike(TRACKING))
    for domain, keep in KEEP.items():
        mine = (where == domain) | where.endswith("." + domain)
        params = F.when(mine, F.filter(F.split(query(url), "&"), _one_of(keys, keep))).otherwise(params)
    params = F.when(short, F.array(F.concat(F.lit("v="), F.regexp_replace(path(url), "^/", "")))).otherwise(F.array_sort(params))
    tail = F.when(short, "/watch").otherwise(F.regexp_replace(path(url), "/+$", ""))
    tail = F.when(tail == "", "/").otherwise(tail)
    joined = F.concat(F.lit("https://"), where, tail, F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise(""))
    return F.when(host(url).isNull(), F.trim(url)).otherwise(joined)


def result_id(norm: Column) -> Column:
    """First 16 digits of the SHA-1 of a normal url."""
    return F.substring(F.sha1(norm.cast("binary")), 1, 16)


def youtube_id(url: Column) -> Column:
    at = display_domain(url)
    found = F.when(at == "youtu.be", F.regexp_extract(path(url), "^/([^/]+)", 1)).when(belongs_to(url, "youtube.com"), F.coalesce(F.nullif(F.regexp_extract(query(url), r"(?:^|&)v=([^&]+)", 1), F.lit("")), F.regexp_extract(path(url), r"^/(?:embed|shorts|v)/([^/]+)", 1)))
    return F.nullif(found, F.lit(""))


def content_kind(site: Column, url: Column) -> Column:
    """video, article, social or unknown."""
    at, where = path(url), host(url)
    bili = F.when(where.rlike(r"^(space|live)\."), "unknown").when(at.rlike("^/(list|medialist)/"), "unknown").when(at.rlike("^/(video|bangumi)/"), "video").when(at.rlike("^/(read|opus|article)"), "article").otherwise("unknown")
    return F.when(site == "youtube", "video").when(site == "bilibili", bili).when(site.isin("zhihu", "xiaohongshu", "x"), "social").otherwise("article")


def should_proxy(url: Column) -> Column:
    """False for private hosts and domestic domains; a url without a host goes through the proxy."""
    v6 = F.lower(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?\[([^\]/?#]+)\]", 1), F.lit("")))
    at = F.regexp_replace(F.coalesce(v6, host(url)), r"\.$", "")
    home = reduce(lambda a, d: a | (at == d) | at.endswith("." + d), DOMESTIC, at.rlike(PRIVATE_HOST))
    return ~F.coalesce(home, F.lit(False))


def extension(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1), F.lit("")))


def origin(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.lit(""))


def bilibili_id(url: Column) -> Column:
    """BV or av id in the path, else in the query; none for articles."""
    at = F.nullif(F.regexp_extract(path(url), r"/((?:BV[0-9A-Za-z]+)|(?:av\d+))", 1), F.lit(""))
    asked = F.nullif(F.regexp_extract(query(url), r"(?:^|&)(?:bvid|oid)=([^&]+)", 1), F.lit(""))
    return F.when(belongs_to(url, "bilibili.com") & ~path(url).rlike("^/(read|opus)/"), F.coalesce(at, asked))


def canonical_bilibili(url: Column) -> Column:
    """The plain address of a video, whatever else was in the url."""
    return F.when(bilibili_id(url).isNotNull(), F.concat(F.lit("https://www.bilibili.com/video/"), bilibili_id(url))).otherwise(url)


def absolute(url: Column) -> Column:
    """A url without a scheme gets https."""
    return F.regexp_replace(url, "^//", "https://")


def cookie_header(cookies: Column, url: Column, now: Column) -> Column:
    """Cookies (name, value, domain, expires in seconds) that go to a url: those of its host or above it, not expired."""
    mine = lambda c: (host(url) == F.regexp_replace(c["domain"], r"^\.", "")) | host(url).endswith(F.concat(F.lit("."), F.regexp_replace(c["domain"], r"^\.", "")))
    live = lambda c: c["expires"].isNull() | (c["expires"] <= 0) | (c["expires"] > now)
    return F.array_join(F.transform(F.filter(cookies, lambda c: mine(c) & live(c)), lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ")
