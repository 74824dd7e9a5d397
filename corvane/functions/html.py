"""Text of HTML by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.constants import BUTTONS

ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def decoded(text: Column) -> Column:
    """The common references decoded, the ampersand's last."""
    for name, to in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(to))
    return text


def stripped(html: Column) -> Column:
    """Scripts, styles, comments and tags out, references decoded, white space made single."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded(text), r"\s+", " "))


def cleaned(text: Column) -> Column:
    """Line ends unified, blanks made single, at most one empty line, lines trimmed, lines of a page's buttons out."""
    text = F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[ \t\u00a0]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"(?dm)^[^\S\n]+|[^\S\n]+$", "")
    return F.regexp_replace(F.regexp_replace(text, rf"(?dm)^(?:{'|'.join(BUTTONS)})$\n?", ""), r"^\s+|\s+$", "")


def script_share(html: Column) -> Column:
    """Characters of script elements in those of the page."""
    scripts = F.regexp_extract_all(html, F.lit(r"(?is)<script\b.*?</script>"), F.lit(0))
    return F.aggregate(scripts, F.lit(0).cast("long"), lambda a, s: a + F.length(s)) / F.greatest(F.length(html), F.lit(1))


def looks_like_shell(html: Column, thin: Column, marker: str = '<div id="root"></div>') -> Column:
    """A page that is filled in by scripts: thin, and marked as such or more than half script."""
    return thin & (F.contains(html, F.lit(marker)) | (script_share(html) > 0.5))


DATE_KEYS = ("datePublished", "dateCreated", "uploadDate", "dateModified")
DATE_METAS = ("article:published_time", "og:published_time", "publishdate", "pubdate", "date")


def written_dates(html: Column) -> Column:
    """Dates a page states, in order of trust: JSON-LD keys, meta elements, time elements."""
    none = F.array().cast("array<string>")
    found = [F.regexp_extract_all(html, F.lit(rf'"{k}"\s*:\s*"([^"]+)"'), F.lit(1)) for k in DATE_KEYS]
    for m in DATE_METAS:
        found.append(F.regexp_extract_all(html, F.lit(rf"(?is)<meta\b(?=[^>]*\b(?:property|name|itemprop)\s*=\s*[\"']{m}[\"'])[^>]*\bcontent\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))
    found.append(F.regexp_extract_all(html, F.lit(r"(?is)<time\b[^>]*\bdatetime\s*=\s*[\"']([^\"']+)[\"']"), F.lit(1)))
    return F.coalesce(F.concat(*found), none)


def first_date(html: Column, now_ms: Column) -> Column:
    """Milliseconds of the first stated date that can be read; null if there is none."""
    from corvane.functions.dates import to_millis

    return F.get(F.filter(F.transform(written_dates(html), lambda d: to_millis(d, now_ms)), lambda ms: ms.isNotNull()), 0)


def images(html: Column, origin: Column, most: int = 30) -> Column:
    """Absolute image urls, each once: from data-original, data-src or src, no inline data, no icons below 80 pixels."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), F.lit(0))
    big = F.filter(tags, lambda t: F.coalesce(F.nullif(F.regexp_extract(t, r"(?i)\bwidth\s*=\s*[\"']?(\d+)", 1), F.lit("")).try_cast("int"), F.lit(80)) >= 80)
    src = lambda t: F.coalesce(*[F.nullif(F.regexp_extract(t, rf"(?is)\s{a}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit("")) for a in ("data-original", "data-src", "src")])
    full = lambda u: F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).when(u.startswith("/"), F.concat(origin, u)).when(u.rlike("^https?://"), u)
    return F.slice(F.array_distinct(F.array_compact(F.transform(F.transform(big, src), full))), 1, most)


def markdown(html: Column) -> Column:
    """Headings, links, bold text and list items as Markdown; other tags out."""
    text = F.regexp_replace(html, r"(?is)<(script|style|head)\b[^>]*>.*?</\1>", "")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"\s+", " ")
    for k in range(1, 7):
        text = F.regexp_replace(text, rf"(?i)<h{k}\b[^>]*>\s*", "\n\n" + "#" * k + " ")
    text = F.regexp_replace(text, r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</?(b|strong)>", "**"), r"(?i)<li\b[^>]*>\s*", "\n- ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, r"(?i)</?(p|div|ul|ol|article|section|blockquote|table|tr|h[1-6])\b[^>]*>", "\n\n"), r"<[^>]*>", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(decoded(text), r" *\n *", "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""))
