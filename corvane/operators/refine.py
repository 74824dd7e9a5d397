"""Rounds of search that learn from what the rounds before them found."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from itertools import chain

from pyspark.sql import DataFrame

from corvane.operators.search import avoided
from corvane.sources.shared import written

MOST_ROUNDS, MOST_TERMS, MOST_PATTERNS, QUERIES_AS_TERMS = 10, 12, 12, 4


@dataclass(frozen=True)
class Analysis:
    """What a look at the documents of a round says: angles that are missing, queries for them, patterns to avoid."""

    missing: tuple[str, ...] = ()
    queries: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class State:
    """What rounds hand on: the intent, related terms, patterns to avoid, and the number of rounds done."""

    intent: str = ""
    terms: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()
    rounds: int = 0

    def after(self, found: Analysis, terms: Sequence[str] = ()) -> State:
        """The state with an analysis taken in: the first twelve terms, the last twelve patterns of two or more characters."""
        known = [p.strip() for p in chain(self.patterns, found.patterns)]
        words = dict.fromkeys(chain(self.terms, terms, found.queries[:QUERIES_AS_TERMS]))
        return replace(self, terms=tuple(words)[:MOST_TERMS], patterns=tuple(p for p in known if len(p) >= 2)[-MOST_PATTERNS:], rounds=self.rounds + 1)

    def query(self, found: Analysis) -> str:
        """The intent of the next search."""
        return "；".join(x for x in (self.intent, *found.missing, *found.queries) if x)


def added(found: DataFrame, there: DataFrame, patterns: Sequence[str], key: str = "norm_url") -> DataFrame:
    """Results whose url is not there yet, those that hold a pattern marked low; nothing is dropped for it."""
    return avoided(found.join(there.select(key), key, "left_anti"), [p.strip() for p in patterns])


def refined(
    results: DataFrame, state: State, analyse: Callable[[DataFrame, State], Analysis], search: Callable[[str, State], tuple[DataFrame, Sequence[str]]], depth: int
) -> tuple[DataFrame, State]:
    """All results after at most `depth` rounds (ten at most), and the state they end in.

    analyse looks at the results so far; search takes an intent and gives results
    in the shape of `results` and terms. The loop ends when a round adds nothing.
    Each round is written, so a later one does not search again.
    """
    for _ in range(min(depth, MOST_ROUNDS)):
        seen = analyse(results, state)
        found, terms = search(state.query(seen), state)
        state = state.after(seen, terms)
        new = written(added(found, results, seen.patterns).select(*results.columns), "round")
        if new.isEmpty():
            break
        results = written(results.unionByName(new), "results")
    return results, state
