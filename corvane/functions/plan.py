"""Search plans: queries built from a topic, its terms and industries."""

from __future__ import annotations

import re
from collections.abc import Sequence

from corvane.constants import DEFAULT_SITES, INDUSTRIES, SITES


def build_query(topic: str, domain: str = "", keyword: str = "") -> str:
    """The topic, restricted to a domain or with a site's keyword."""
    return " ".join(x for x in (topic.strip(), f"site:{domain}" if domain else keyword) if x)


def industry_clause(tags: Sequence[str]) -> str:
    """The first three keywords of each tag, quoted and joined by OR; empty without tags."""
    words = [w for t in tags if t.strip() for w in INDUSTRIES.get(t.strip(), (t.strip(),))[:3]]
    return "(" + " OR ".join(f'"{w}"' for w in words) + ")" if words else ""


def variant(base: str, intent: str = "", related: Sequence[str] = (), industries: Sequence[str] = ()) -> str:
    """The base, the intent if it is not in it, up to four related terms, and the industries' clause."""
    parts = [base.strip()]
    if intent and intent.lower() not in base.lower():
        parts.append(intent)
    if related:
        parts.append("(" + " OR ".join(f'"{r}"' for r in related[:4]) + ")")
    parts.append(industry_clause(industries))
    return " ".join(p for p in parts if p)


def punctuation_forms(term: str) -> list[str]:
    """A term with its dashes and dots as blanks, and without them."""
    return [re.sub(r"[-._]+", " ", term), re.sub(r"[-._\s]+", "", term)]


def query_variants(candidates: Sequence[str], most: int = 5) -> list[str]:
    """Candidates in order, white space made single, equal ones (case aside) once, at most five."""
    out: dict[str, str] = {}
    for c in candidates:
        c = " ".join(c.split())
        if c:
            out.setdefault(c.lower(), c)
    return list(out.values())[:most]


def lexical_plan(raw: str, intent: str = "", industries: Sequence[str] = ()) -> dict:
    """A plan without a model: the words as they are, and their forms."""
    forms = query_variants([raw, *punctuation_forms(raw), variant(raw, intent, (), industries)])
    return {"raw": raw, "entity": raw.strip(), "variants": forms, "industries": [t for t in dict.fromkeys(x.strip() for x in industries) if t], "source": "lexical"}


def sites_of(selected: Sequence[str] = (), direct: bool | None = None) -> list[str]:
    """Known sites among the selected ones, the default ones if none are, in registry order.

    direct: only those reached by a source of their own, or only those found by search engines.
    """
    wanted = set(selected) or set(DEFAULT_SITES)
    return [key for key, _, own in SITES if key in wanted and direct in (None, own)]
