"""Text measures, formats and tests as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane import constants as C

CJK = "[一-鿿]"


def count_words(text: Column) -> Column:
    """CJK characters plus runs of ASCII letters."""
    return (F.regexp_count(text, F.lit(CJK)) + F.regexp_count(text, F.lit("[a-zA-Z]+"))).cast("long")


def language(text: Column) -> Column:
    """zh if more than 15 % of the first 1,000 characters are CJK, else en; empty: unknown."""
    head = F.substring(text, 1, 1000)
    return F.when(F.coalesce(F.trim(head), F.lit("")) == "", "unknown").when(F.regexp_count(head, F.lit(CJK)) / F.length(head) > 0.15, "zh").otherwise("en")


def excerpt(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def normalize_word(word: Column) -> Column:
    """Full-width ASCII made half-width, ideographic space a blank, trimmed."""
    wide = "".join(chr(0xFF01 + k) for k in range(94))
    return F.trim(F.translate(word, wide + "　", "".join(chr(0x21 + k) for k in range(94)) + " "))


def keyword_type(word: Column, tag: Column) -> Column:
    low = F.lower(word)
    foreign = tag.isin("eng", "nz")
    return (
        F.when(word.rlike(C.TYPE_ORGANISATION), "组织").when(word.rlike(C.TYPE_TECHNOLOGY), "技术").when(low.rlike(C.TYPE_PRODUCT), "产品")
        .when(tag == "nt", "组织").when(tag == "nr", "人物").when(tag == "ns", "地点")
        .when(foreign & low.rlike(C.TYPE_ENG_PRODUCT), "产品").when(foreign & low.rlike(C.TYPE_ENG_TECHNOLOGY), "技术").when(foreign, "产品").otherwise("概念")
    )


def looks_like_code(text: Column) -> Column:
    """On the first 3,000 characters: few letters and many marks, or a strong token."""
    head = F.substring(text, 1, 3000)
    n = F.greatest(F.length(head), F.lit(1))
    return F.when(F.length(head) < 40, False).when(F.regexp_count(head, F.lit(r"[\p{L}\p{N}\s]")) / n > 0.75, False).when(F.regexp_count(head, F.lit("[{};=<>]|=>|::")) / n > 0.05, True).otherwise(head.rlike(C.CODE_STRONG))


def boilerplate_reason(text: Column) -> Column:
    """Why a text is a list of recommendations or page chrome; null if it is not."""
    plays = F.regexp_count(text, F.lit(C.PLAY_MARK))
    return F.when(plays >= 3, F.format_string("recommendation list (%d play marks)", plays)).when(text.rlike("|".join(C.CHROME_TEXT)), "page chrome")


def seconds(clock: Column) -> Column:
    """h:mm:ss, m:ss or s as seconds; null if a part is no number."""
    parts = F.transform(F.split(clock, ":"), lambda p: p.try_cast("int"))
    return F.when(F.exists(parts, lambda p: p.isNull()), None).otherwise(F.aggregate(parts, F.lit(0), lambda a, p: a * 60 + p))


def duration(n: Column) -> Column:
    """Seconds as m:ss or h:mm:ss."""
    n = F.floor(n).cast("long")
    h, m, s = F.floor(n / 3600), F.floor(n % 3600 / 60), n % 60
    return F.when(n >= 3600, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def compact_count(n: Column) -> Column:
    """Numbers below 1,000 as they are, then in k, 万 and 亿 with one decimal, `.0` dropped."""
    one = lambda x: F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10), r"\.0$", "")
    return F.when(n < 1000, n.cast("long").cast("string")).when(n < 10_000, F.concat(one(n / 1000), F.lit("k"))).when(n < 100_000_000, F.concat(one(n / 10_000), F.lit("万"))).otherwise(F.concat(one(n / 100_000_000), F.lit("亿")))


def round3(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5) / 1000


def file_stem(ident: Column, title: Column) -> Column:
    """First 8 characters of the id and 60 of the title without characters file names cannot have."""
    return F.concat_ws("-", F.substring(ident, 1, 8), F.substring(F.trim(F.regexp_replace(title, r'[\\/:*?"<>|\s]+', " ")), 1, 60))


def table_cell(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def link_text(text: Column) -> Column:
    """Text between the brackets of a link: backslashes and brackets are escaped."""
    for mark in ("\\", "[", "]"):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return F.regexp_replace(text, r"\r?\n", " ")


def quoted_line(text: Column, most: int = 300) -> Column:
    """Text as one line of a block quote, cut after `most` characters with an ellipsis."""
    line = F.regexp_replace(F.regexp_replace(text, r"\s*\r?\n\s*", " "), r"^\s+|\s+$", "")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def diagram_text(text: Column) -> Column:
    """Text of a diagram's node: no quotes or backticks, round brackets for square ones."""
    return F.regexp_replace(F.translate(text, '[]"`', "()"), r"\r?\n", " ")


def report_file(topic: Column, at: Column) -> Column:
    """File name of a report: the topic without what names cannot hold, and the minute it was made."""
    safe = F.regexp_replace(F.regexp_replace(topic, r'[\\/:*?"<>|\x00-\x1f]', ""), r"^\s+|\s+$", "")
    return F.concat(F.coalesce(F.nullif(safe, F.lit("")), F.lit("report")), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmm"), F.lit(".md"))


def label(key: Column, table: str) -> Column:
    """The label of a key in one of the tables of labels; the key itself where it has none."""
    names = F.create_map(*[F.lit(x) for pair in C.LABELS[table].items() for x in pair])
    return F.coalesce(F.try_element_at(names, key), key)


def xml_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def matched_industries(text: Column, tags: Sequence[str]) -> Column:
    """Tags of which the text holds a keyword; a tag without a preset is its own keyword."""
    low = F.lower(text)
    hits = []
    for tag in tags:
        found = F.lit(False)
        for w in C.INDUSTRIES.get(tag, (tag,)):
            found = found | F.contains(low, F.lit(w.lower()))
        hits.append(F.when(found, F.lit(tag)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def industry_score(matched: Column, tags: Sequence[str]) -> Column:
    return F.size(matched) / F.lit(len(tags)) if tags else F.lit(1.0)


def matches_term(text: Column, term: str) -> Column:
    """ASCII terms at word boundaries, others anywhere; case does not matter."""
    if term.isascii():
        import re

        return text.rlike(rf"(?i)(?<![A-Za-z0-9]){re.escape(term)}(?![A-Za-z0-9])")
    return F.contains(F.lower(text), F.lit(term.lower()))


def vtt_text(vtt: Column) -> Column:
    """Captions as one line: headers, cue times and numbers out, tags out, rolling repeats folded.

    A caption that begins with the one before it replaces it; one that the last
    contains, or that was there before, is dropped.
    """
    lines = F.transform(F.split(vtt, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", "")))
    lines = F.filter(lines, lambda x: (x != "") & ~x.rlike(r"^(WEBVTT|NOTE|Kind:|Language:|\d+$)|-->"))

    def fold(out: Column, line: Column) -> Column:
        last = F.element_at(out, -1)
        grown = (F.size(out) > 0) & line.startswith(last)
        known = (F.size(out) > 0) & F.contains(last, line) | F.array_contains(out, line)
        return F.when(known, out).when(grown, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(line))).otherwise(F.concat(out, F.array(line)))

    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), fold), " ")


def compact_signals(signals: Column) -> Column:
    """Signals with a finite value; null if none is left."""
    kept = F.filter(signals, lambda s: s["value"].isNotNull() & ~F.isnan(s["value"]) & (F.abs(s["value"]) < float("inf")))
    return F.when(F.size(kept) > 0, kept)


def signal_summary(signals: Column) -> Column:
    """The three largest signals as label and short number."""
    top = F.slice(F.array_sort(signals, lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).otherwise(0)), 1, 3)
    return F.array_join(F.transform(top, lambda s: F.concat_ws(" ", s["label"], compact_count(s["value"]))), " · ")


def description(text: Column, title: Column) -> Column:
    """A description without leading numbers and its title; too short: empty."""
    bare = F.trim(F.regexp_replace(text, r"^\d{6,}\s*-+\s*", ""))
    bare = F.when((title != "") & bare.startswith(title), F.trim(F.substr(bare, F.length(title) + 1))).otherwise(bare)
    return F.when(F.length(bare) < 10, "").otherwise(bare)
