"""URL rules, and block decisions carried to the aliases of a page."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html import unescape
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import no_text
from corvane.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined as a table instead of compiled to an expression.
MOST_COMPILED = 256


class Rule(NamedTuple):
    """`host` and all its subdomains, where the path starts with `path`."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))

_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)"
#: The target is in one of three groups, by the quotes around the content; it may have quotes of the other kind.
_REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*(?:"[^"]*?\burl\s*=\s*'?\s*([^"'\s>]+)|'[^']*?\burl\s*=\s*"?\s*([^"'\s>]+)|[^"'\s>]*?\burl\s*=\s*([^"'\s>]+))"""
#: References end with a semicolon; `&copy=1` in a link is no reference.
_REFERENCE = re.compile(r"&(?:#[xX]?[0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no `://`."""
    url = no_text(url)
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched(pages: DataFrame, rules: Sequence[Rule] | DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """`pages` with rule and action of the longest rule that fits, else nulls.

    A few rules become one expression without any join. More, or a table with
    action, host and path, are joined on the host's suffixes, one row for each
    label of the host, and the longest is kept by a partial aggregation; Spark
    may split a suffix that many pages share. Equal lengths: the longer host.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= MOST_COMPILED:
        best = F.lit(None).cast("struct<rule:string,action:string>")
        for r in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.action == "allow")):
            fits = ((F.col(host) == r.host) | F.col(host).endswith("." + r.host)) & F.col(path).startswith(r.path)
            best = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))).otherwise(best)
        return pages.withColumn("best", best).select(*pages.columns, "best.rule", "best.action")
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    rules = rules.select(F.col("action").alias("r_action"), F.col("host").alias("r_host"), F.col("path").alias("r_path"))
    keys = pages.select(host, path).distinct()
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, 1 << 20), "."))
    found = keys.withColumn("suffix", F.explode(suffixes)).join(rules, F.col("suffix") == F.col("r_host")).where(F.col(path).startswith(F.col("r_path")))
    name = F.concat("r_host", "r_path")
    best = F.max(F.struct(F.length(name), F.length("r_host"), (F.col("r_action") == "allow"), name.alias("rule"), F.col("r_action").alias("action")))
    found = found.groupBy(host, path).agg(best.alias("best")).select(host, path, "best.rule", "best.action")
    return pages.join(found, [host, path], "left").select(*pages.columns, "rule", "action")


def place(url: Column) -> Column:
    """What the server is asked for: the url without its fragment, A-Z of scheme and host lower-cased."""
    part = lambda k: F.regexp_extract(url, r"^([^:/?#]*://)([^/?#]*@)?([^/?#]*)([^#]*)", k)
    folded = lambda k: F.translate(part(k), UPPER, LOWER)
    return F.when(part(1) != "", F.concat(folded(1), part(2), folded(3), part(4))).otherwise(F.regexp_extract(url, r"^([^#]*)", 1))


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link targets with their references decoded, resolved against the page's url; null if that gives no url."""
    for batch in batches:
        out: list[str | None] = []
        for url, to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                to = urljoin(url, _REFERENCE.sub(lambda m: unescape(m[0]), to).strip(" \t\r\n\f\"'"))
            except ValueError:  # a host that is none
                to = ""
            out.append(to if "://" in to else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["url", "to"])


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (u, v) from a page's url to all its canonical links and redirect targets.

    Targets are resolved against the page's url. Pages without a url or html have
    no edge, nor has a target that is not a url then.
    """
    refreshes = F.transform(F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)), lambda x: F.concat(*[F.regexp_extract(x, _REFRESH, k) for k in (1, 2, 3)]))
    targets = F.filter(F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), refreshes)), lambda x: x != "")
    some = pages.select("url", "html").where("url IS NOT NULL AND html IS NOT NULL").where(F.col("html").rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh"))
    some = some.select("url", F.explode(targets).alias("to")).mapInArrow(_resolved, "url string, to string")
    return some.where("to IS NOT NULL").select(place(F.col("url")).alias("u"), place(F.col("to")).alias("v"))


def carried(edges: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """node and alias_verdict of every url with an edge.

    A component is allowed if a rule allows one of its urls, else blocked if a
    rule blocks one, else null. Urls that are not pages count as well.
    """
    nodes = components(edges)
    host, path = host_and_path(F.col("node"))
    ruled = matched(nodes.select("node", "component", host.alias("host"), path.alias("path")), rules)
    says = lambda what: F.max(F.col("action") == what)
    whole = ruled.groupBy("component").agg(F.when(says("allow"), "allow").when(says("block"), "block").alias("alias_verdict"))
    return nodes.join(whole.where("alias_verdict IS NOT NULL"), "component").select("node", "alias_verdict")


def judged(pages: DataFrame, rules: Sequence[Rule] | DataFrame = RULES, edges: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and via of every page.

    The verdict is that of the longest rule which fits the url itself; without
    one that of its aliases (connected over redirect and canonical-link edges,
    an explicit allow before a block), else `default`. via says which: rule,
    alias or default. edges: columns u and v; by default those found in the
    html. A null url has an empty host and path, and no aliases.
    """
    edges = alias_edges(pages) if edges is None else edges
    host, path = host_and_path(F.col("url"))
    rows = matched(pages.select("page_id", place(F.col("url")).alias("node"), host.alias("host"), path.alias("path")), rules)
    rows = rows.join(carried(edges, rules), "node", "left")
    via = F.when(F.col("action").isNotNull(), "rule").when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("action", "alias_verdict", F.lit(default)).alias("verdict"), via.alias("via"))
