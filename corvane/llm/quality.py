"""Document quality by Bradley-Terry ranking of preference pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import if_small, written
from corvane.llm.textkit import SPACE_PARTED, Words, pieces, rolled, utf8

FEATURES = ("log_words", "short", "capitals", "symbols", "exclamations", "bars", "marks", "beyond_ascii", "word_length", "types", "fours", "stutter", "lines", "same_line", "blank")
CUT = 0.3


@dataclass(frozen=True)
class Settings:
    """most_labelled: rows the model is fitted on, those of least hash of the id.

    pairs: preference pairs drawn from them; ridge: weight of the squared
    coefficients. The decision quantile is taken over all labelled rows.
    """

    most_labelled: int = 20_000
    pairs: int = 200_000
    ridge: float = 1.0
    seed: int = 1


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _LOWERS = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz")
_SYMBOL, _BANG, _BAR, _MARK = _class("#*$%&<>@^~=+\\_{}[]"), _class("!"), _class("|"), _class(".,;:?")
_BEYOND = np.arange(256) >= 0xC0  # first bytes of characters beyond ASCII


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; all from the text alone, and 0 where it has no words."""
    rows = []
    for _, part, at in pieces(data, offsets):
        words = Words(part, at, SPACE_PARTED, lower=False)
        n = np.diff(words.first).astype(float)
        some = np.maximum(n, 1)

        def count(kind: np.ndarray, part: np.ndarray = part, at: np.ndarray = at) -> np.ndarray:
            sums = np.zeros(len(part) + 1, np.int64)
            np.cumsum(kind[part], out=sums[1:])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        upper, lower = count(_UPPER), count(_LOWERS)
        length = words.end - words.start
        sums = np.concatenate([[0], np.cumsum(length)])
        chars = (sums[words.first[1:]] - sums[words.first[:-1]]).astype(float)
        hashes = words.hashes()
        again = np.zeros(len(hashes), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        again[words.first[:-1][n > 0]] = False  # a document's first word follows none
        sums = np.concatenate([[0], np.cumsum(again)])
        stutter = (sums[words.first[1:]] - sums[words.first[:-1]]).astype(float)
        pairs = rolled(hashes, 4)
        types, fours = np.ones(len(n)), np.ones(len(n))
        for k in range(len(n)):
            a, b = words.first[k], words.first[k + 1]
            if b > a:
                types[k] = len(np.unique(hashes[a:b])) / math.sqrt((b - a) * min(b - a, 100))
            if b - a >= 4:
                fours[k] = len(np.unique(pairs[a : b - 3])) / (b - a - 3)
        breaks = count(_class("\n"))
        same = np.zeros(len(n))
        raw = part.tobytes()
        for k in np.flatnonzero(breaks):
            lines = [x for x in raw[at[k] : at[k + 1]].split(b"\n") if x.strip()]
            same[k] = 1 - len(set(lines)) / max(1, len(lines))
        rate = lambda x: np.minimum(np.log1p(8 * x / some), 3)  # noqa: E731, B023
        out = np.stack([np.log1p(n) / 10, n < 20, upper / np.maximum(upper + lower, 1), rate(count(_SYMBOL)), rate(count(_BANG)), rate(count(_BAR)), rate(count(_MARK)), count(_BEYOND) / np.maximum(chars, 1), np.minimum(chars / some, 20) / 10, types, fours, stutter / some, np.minimum(breaks / some, 1), same, n == 0], axis=1)
        rows.append(np.where((n == 0)[:, None], np.eye(1, len(FEATURES), len(FEATURES) - 1), out))
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(*utf8(batch.column(2))).astype(np.float32)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["key", "h", "x"])


@dataclass(frozen=True)
class Model:
    """raw score = weights . x; score = logistic(raw - threshold + logit(CUT))."""

    weights: tuple[float, ...]
    threshold: float = 0.0

    def raw(self, x: Column) -> Column:
        total = F.lit(0.0)
        for k, w in enumerate(self.weights):
            total = total + F.get(x, k).cast("double") * F.lit(w)
        return total

    def score(self, x: Column) -> Column:
        z = self.raw(x) - F.lit(self.threshold) + F.lit(math.log(CUT / (1 - CUT)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.least(z, F.lit(500.0)), F.lit(-500.0))))


def bradley_terry(x: np.ndarray, better: np.ndarray, settings: Settings) -> tuple[float, ...]:
    """Weights w for which w . (winner - loser) explains the preferences best.

    Pairs are drawn evenly from all (preferred, other) pairs; the logistic loss of
    their feature differences plus a ridge is minimised by Newton's method.
    Without a row of either kind there is no preference and all weights are 0.
    """
    good, bad = np.flatnonzero(better), np.flatnonzero(~better)
    if not len(good) or not len(bad):
        return (0.0,) * x.shape[1]
    rng = np.random.default_rng(settings.seed)
    n = min(settings.pairs, len(good) * len(bad))
    scale = x.std(axis=0) + 1e-3
    d = (x[rng.choice(good, n)] - x[rng.choice(bad, n)]) / scale
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance that the loser wins
        gradient = settings.ridge * w - d.T @ p
        hessian = settings.ridge * np.eye(len(w)) + (d * (p * (1 - p))[:, None]).T @ d
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-7:
            break
    return tuple((w / scale).tolist())


def is_held_out(id_col: str) -> Column:
    """Rows never learned from: crc32 of the id as text divides by five. Null ids: false."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(featured: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model of the labelled rows that are not held out.

    featured: key, x. labels: doc_id, quality; ids labelled twice count as 0 if any
    label is. The weights come from a bounded sample; the threshold is the quantile
    of the raw scores of all those rows at the level of their share of label 0,
    halfway between the quantiles at 98 % and 102 % of that level.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("y"))
    known = featured.join(known, F.col("key") == F.col("doc_id")).where(~is_held_out("key")).select("key", "x", "y")
    known = written(known, "labelled")
    sample = known.orderBy(F.xxhash64("key"), "key").limit(settings.most_labelled).select("x", "y").toArrow()
    if not sample.num_rows:
        return Model((0.0,) * len(FEATURES))
    x = np.stack(sample["x"].to_numpy()).astype(float)
    weights = bradley_terry(x, sample["y"].to_numpy() > 0, settings)
    share = known.agg(F.avg(F.when(F.col("y") > 0, 0.0).otherwise(1.0))).first()[0]
    near = [min(1.0, max(0.0, share * k)) for k in (0.98, 1.02)]
    low, high = known.agg(F.percentile_approx(Model(weights).raw(F.col("x")), near, 100_000)).first()[0]
    return Model(weights, (low + high) / 2)


def _judged(documents: DataFrame, labels: DataFrame, settings: Settings, model: Model | None, id_col: str, text_col: str) -> DataFrame:
    """key, h, held_out, score and predicted of every row; h is a hash of its text."""
    rows = documents.select(F.col(id_col).cast("long").alias("key"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    featured = written(rows.mapInArrow(_featured, "key long, h long, x array<float>"), "features")
    model = model or fitted(featured, labels, settings)
    # Rounding of the logistic may not move a row on the threshold.
    out = featured.select("key", "h", is_held_out("key").alias("held_out"), F.round(model.score(F.col("x")), 12).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def scored(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.3) of every document.

    Learned from labels.quality of the rows that are not held out. The score sees
    the whole text and nothing else; null counts as empty, and an empty text has
    the score of a text without words. Repeated ids give a row each. Without any
    labels all scores are 0.3.
    """
    return _judged(documents, labels, settings, model, id_col, text_col).select(F.col("key").alias("doc_id"), "held_out", "score", "predicted")


def accepted(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not rejected.

    Each row is judged by its own text, also where ids are null or shared.
    """
    rejected = _judged(documents, labels, settings, None, id_col, text_col).where("predicted = 0")
    rejected = if_small(written(rejected.select(F.col("key").alias("_rejected"), F.col("h").alias("_rejected_h")).distinct(), "rejected"))
    mine = documents[id_col].cast("long").eqNullSafe(rejected["_rejected"]) & (F.xxhash64(documents[text_col]) == rejected["_rejected_h"])
    return documents.join(rejected, mine, "left_anti")
