"""Dates as they are written on pages, made ISO instants; and their display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def _instant(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column, zone: Column) -> Column:
    """Milliseconds of a wall time in a zone (`Z`, an offset or empty for UTC); null if there is no such time."""
    day = F.try_to_timestamp(F.format_string("%04d-%02d-%02d", y, mo, d), F.lit("yyyy-MM-dd"))
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    offset = F.when(zone.rlike("^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(F.replace(zone, F.lit(":")), 4, 2).try_cast("int"))).otherwise(0)
    ok = (h < 24) & (mi < 60) & (s < 60)
    return F.when(ok, F.unix_millis(day) + ((h * 60 + mi - offset) * 60 + s) * 1000)


def _part(text: Column, pattern: str, k: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, pattern, k), F.lit("")).try_cast("int"), F.lit(0))


ABSOLUTE = r"(?i)^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[ T](\d{1,2}):(\d{2})(?::(\d{2}))?)?(?:\.\d+)?\s*(Z|[+-]\d{2}:?\d{2})?$"
CHINESE = r"^(\d{4})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日?(?:\s*(\d{1,2}):(\d{2})(?::(\d{2}))?)?$"
NAMED = r"(?i)^(?:[a-z]{3,9},?\s+)?(?:(\d{1,2})\s+)?(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?:(\d{1,2}),?\s+)?(\d{4})(?:\s+(\d{1,2}):(\d{2})(?::(\d{2}))?)?\s*(?:GMT|UTC|Z)?$"
AGO = r"(?i)^(\d+)\s*(秒|分钟|小时|天|周|个?月|年|seconds?|minutes?|hours?|days?|weeks?|months?|years?)\s*(前|ago)$"
UNITS = (("秒|second", 1), ("分钟|minute", 60), ("小时|hour", 3600), ("天|day", 86400), ("周|week", 604800), ("月|month", 30 * 86400), ("年|year", 365 * 86400))
LEAST_MS, AHEAD_MS = 631152000000, 48 * 3600 * 1000


def to_millis(raw: Column, now_ms: Column) -> Column:
    """Epoch milliseconds of a written date; null if it is none, before 1990 or over 48 hours ahead.

    Digits alone: yyyymmdd if that is a date, else seconds, or milliseconds from
    1e11 on. Words and `n units ago` count back from now, a month as 30 and a
    year as 365 days.
    """
    t = F.trim(raw)
    zero, none = F.lit(0), F.lit("")
    digits = t.rlike(r"^\d+$")
    ymd = F.when(t.rlike(r"^\d{8}$"), _instant(F.substring(t, 1, 4).try_cast("int"), F.substring(t, 5, 2).try_cast("int"), F.substring(t, 7, 2).try_cast("int"), zero, zero, zero, none))
    number = t.try_cast("bigint")
    epoch = F.when(number < 100_000_000_000, number * 1000).otherwise(number)
    per = F.lit(None).cast("long")
    for names, n in UNITS:
        per = F.when(F.regexp_extract(t, AGO, 2).rlike(f"(?i){names}"), F.lit(n).cast("long")).otherwise(per)
    ago = now_ms - F.regexp_extract(t, AGO, 1).try_cast("bigint") * per * 1000
    words = F.when(t.isin("刚刚", "刚才") | (F.lower(t) == "just now"), now_ms).when(t.isin("昨天") | (F.lower(t) == "yesterday"), now_ms - 86_400_000).when(t == "前天", now_ms - 2 * 86_400_000)
    absolute = _instant(*[_part(t, ABSOLUTE, k) for k in range(1, 7)], F.regexp_extract(t, ABSOLUTE, 7))
    chinese = _instant(*[_part(t, CHINESE, k) for k in range(1, 7)], none)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(t, NAMED, 2))).cast("int")
    named = _instant(_part(t, NAMED, 4), month, F.greatest(_part(t, NAMED, 1), _part(t, NAMED, 3)), _part(t, NAMED, 5), _part(t, NAMED, 6), _part(t, NAMED, 7), none)
    out = F.when(digits, F.coalesce(ymd, epoch)).when(words.isNotNull(), words).when(t.rlike(AGO), ago).when(t.rlike(ABSOLUTE), absolute).when(t.rlike(CHINESE), chinese).when(t.rlike(NAMED), named)
    return F.when((out >= LEAST_MS) & (out <= now_ms + AHEAD_MS), out)


def to_iso(raw: Column, now_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(to_millis(raw, now_ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def relative_time(ms: Column, now_ms: Column) -> Column:
    """Age as text: minutes, hours, days, 30-day months, 365-day years, each rounded down."""
    s = F.floor((now_ms - ms) / 1000)
    steps = ((3600, 60, "分钟前"), (86_400, 3600, "小时前"), (30 * 86_400, 86_400, "天前"), (365 * 86_400, 30 * 86_400, "个月前"))
    out = F.concat(F.floor(s / (365 * 86_400)).cast("string"), F.lit("年前"))
    for below, unit, name in reversed(steps):
        out = F.when(s < below, F.concat(F.floor(s / unit).cast("string"), F.lit(name))).otherwise(out)
    return F.when(s < 60, "刚刚").otherwise(out)
