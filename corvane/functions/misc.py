"""Formats, classifiers of errors, and geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import constants as C


def format_bytes(n: Column) -> Column:
    """Bytes in the largest unit of 1,024 powers that leaves one or more, one decimal."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for k, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.1f", F.floor(n / 1024**k * 10 + 0.5) / 10), F.lit(f" {unit}"))).otherwise(out)
    return out


def to_bytes(size: Column) -> Column:
    """Bytes of a text such as 1.5MiB; null if it is none."""
    unit = F.regexp_extract(size, r"^([\d.]+)\s*([KMG]?)i?B$", 2)
    n = F.nullif(F.regexp_extract(size, r"^([\d.]+)\s*([KMG]?)i?B$", 1), F.lit("")).try_cast("double")
    return F.floor(n * F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).otherwise(1) + 0.5)


def is_retryable(error: Column) -> Column:
    """Timeouts, broken connections, too many requests and server errors may pass."""
    return F.coalesce(error.rlike(r"(?i)timeout|timed out|超时|ECONN|socket|network|fetch failed|\b429\b|\b5\d\d\b"), F.lit(False))


def site_note(site: Column, logged_in: Column | bool = False) -> Column:
    """What is to be said of a site whatever happened; null for most sites."""
    known = F.coalesce(logged_in if isinstance(logged_in, Column) else F.lit(logged_in), F.lit(False))
    return F.coalesce(*[F.when(site == s, F.when(known, n[-1]).otherwise(n[0])) for s, n in C.SITE_NOTES.items()])


def known_limitation(site: Column, error: Column, logged_in: Column | bool = False) -> Column:
    """An error that is a site's rule and no fault, in words; null for any other error."""
    hit = F.coalesce(*[F.when((site == s) & error.rlike(p), True) for s, p in C.LIMITED.items()])
    code = F.when(site == "zhihu", "HTTP 403 —— ").when(site == "bilibili", "HTTP 412 —— ").otherwise("")
    cause = F.when(site == "youtube", F.concat(F.lit("（"), F.substring(error, 1, 80), F.lit("）"))).otherwise("")
    return F.when(hit, F.concat(F.lit(C.LIMITATION + "："), code, site_note(site, logged_in), cause))


def is_known_limitation(error: Column) -> Column:
    return F.coalesce(error.startswith(C.LIMITATION), F.lit(False))


def provider_status(ok: Column, count: Column, error: Column) -> Column:
    return F.when(ok & (count > 0), "正常").when(ok, "无命中").otherwise(F.concat(F.lit("失败:"), F.coalesce(error, F.lit(""))))


def node_size(weight: Column, largest: Column) -> Column:
    """14 plus up to 46 by the root of the share of the largest weight."""
    return 14 + 46 * F.sqrt(F.greatest(weight, F.lit(0.0)) / F.greatest(largest, F.lit(1e-9)))


def edge_width(weight: Column, largest: Column) -> Column:
    return 0.4 + 2.4 * weight / F.greatest(largest, F.lit(1e-9))


def clamped(x: Column, low: float, high: float, default: float) -> Column:
    """x within bounds; the default where it is null or no number."""
    return F.when(x.isNull() | F.isnan(x), F.lit(default)).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def joined_subtitles(lines: Column) -> Column:
    """Lines as one text: no blank after CJK characters or CJK punctuation."""
    def add(text: Column, line: Column) -> Column:
        tight = text.rlike(r"[一-鿿，。！？、；：]$") | (text == "")
        return F.when(tight, F.concat(text, line)).otherwise(F.concat(text, F.lit(" "), line))

    return F.aggregate(lines, F.lit(""), add)


def category(name: Column) -> Column:
    """Words for a value and blanks are no category."""
    name = F.trim(F.coalesce(name, F.lit("")))
    return F.when(F.lower(name).isin("", "high", "medium", "low", "高", "中", "低"), "未分类").otherwise(name)
