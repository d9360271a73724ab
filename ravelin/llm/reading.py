"""Reading level of each document, on the scale of graded examples.

Method: each word gets an acquisition grade from the graded texts it stands in: its share of the words of each level,
set against the size of the level, is a distribution over levels, and the grade is that distribution's mean. A document's
level is predicted from the quantiles of the grades of its known words, calibrated on the graded documents by ridge
regression. Words that mostly stand in texts graded as no prose (logs, tables, code) carry no grade; a document with too
small a share of graded words has no prose to grade, the share being calibrated on the graded documents too.

Only graded documents are used for fitting, at most MAX_GRADED of them (chosen by a hash of their key); their word counts
are summed where they are read and shuffled as one row for each word and task. Prediction is one pass over all whole
texts, without a shuffle; the model, at most MAX_WORDS grades, is broadcast.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import spread
from ravelin.session import cut, small_side

LEVELS = 5
#: Bound of the sample the model is fitted on, and of the model itself (the most widespread words are kept).
MAX_GRADED, MAX_WORDS = 200_000, 400_000
#: A word is known if at least so many graded documents have it.
MIN_DOCS = 3
QUANTILES = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
RIDGE = 0.5
#: Share of graded words that prose has at least, where no graded example tells.
DEFAULT_SHARE = 0.4
#: Documents at or above this level are demanding (levels 4 and 5, with rounding).
DEMANDING = 3.5

_WORD = re.compile(r"[^\W\d_]+(?:[’'-][^\W\d_]+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Model:
    grades: dict[str, float]  # NaN: known, but no word of prose
    weights: np.ndarray
    share: float

    def features(self, text: str | None) -> tuple[np.ndarray | None, float]:
        """(features, share of the words that carry a grade); no features without any graded word."""
        words = words_of(text) if text else []
        get, nan = self.grades.get, float("nan")
        g = np.fromiter((get(w, nan) for w in words), float, len(words))
        g = g[~np.isnan(g)]
        if not len(g):
            return None, 0.0
        return np.concatenate([[1.0], np.quantile(g, QUANTILES), [g.mean(), (g >= DEMANDING).mean()]]), len(g) / len(words)

    def level(self, text: str | None) -> float | None:
        """The predicted level within the scale, None where there is no prose to grade."""
        x, share = self.features(text)
        if x is None or share < self.share:
            return None
        return float(np.clip(x @ self.weights, 1, LEVELS))


def graded(documents: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """(k, t, y): graded documents, y the mean of their grades, null if graded as no prose. Grades beyond the scale don't count."""
    level = F.col("reading_level")
    marks = labels.where(F.col(key).isNotNull() & (level.isNull() | level.between(1, LEVELS))).groupBy(F.col(key).alias("lk")).agg(F.avg("reading_level").alias("y"))
    n = marks.count()
    if n > MAX_GRADED:
        marks = marks.where(F.pmod(F.xxhash64("lk"), F.lit(1_000_000)) < int(1_000_000 * MAX_GRADED / n))
    return documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(small_side(marks, MAX_GRADED), F.col("k") == F.col("lk")).select("k", "t", "y")


def word_grades(sample: DataFrame) -> dict[str, float]:
    """Grade of each known word, NaN for words of texts without prose."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[float]] = {}
        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                none = y is None or y != y
                low = 0 if none else int(y)
                part = 0.0 if none else y - low
                for w, n in Counter(words_of(t) if t else ()).items():
                    row = seen.setdefault(w, [0.0] * (LEVELS + 2))
                    row[low] += n * (1 - part)
                    if part:
                        row[low + 1] += n * part
                    row[-1] += 1
        yield pd.DataFrame([(w, *row) for w, row in seen.items()], columns=["w", *(f"n{i}" for i in range(LEVELS + 1)), "docs"])

    columns = [f"n{i}" for i in range(LEVELS + 1)]
    counts = sample.mapInPandas(count, "w string, " + ", ".join(f"{c} double" for c in columns) + ", docs double")
    every = cut(counts.groupBy("w").agg(*[F.sum(c).alias(c) for c in columns], F.sum("docs").alias("docs")))
    totals = np.array([x or 0.0 for x in every.agg(*[F.sum(c) for c in columns]).first()])
    known = every.where(F.col("docs") >= MIN_DOCS).orderBy(F.desc("docs"), "w").limit(MAX_WORDS).toPandas()
    if known.empty:
        return {}
    rates = known[columns].to_numpy() / np.maximum(totals, 1)
    prose = rates[:, 1:].sum(axis=1)
    mean = rates[:, 1:] @ np.arange(1, LEVELS + 1) / np.maximum(prose, 1e-300)
    return dict(zip(known["w"], np.where(rates[:, 0] > prose, np.nan, mean), strict=True))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Word grades, calibration of the quantiles, and the least share of graded words."""
    sample = cut(graded(documents, labels, key, text))  # at most MAX_GRADED documents, read three times from here on
    n = len(QUANTILES) + 3
    blank = Model(word_grades(sample), np.zeros(n), 0.0)
    shared = documents.sparkSession.sparkContext.broadcast(blank)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xx, xy, bins = np.zeros((n, n)), np.zeros(n), np.zeros((2, 101))
        for pdf in batches:
            for t, y in zip(pdf["t"], pdf["y"], strict=True):
                x, share = shared.value.features(t)
                none = y is None or y != y
                bins[int(none), int(100 * share)] += 1
                if x is not None and not none:
                    xx += np.outer(x, x)
                    xy += x * y
        yield pd.DataFrame({"m": [np.concatenate([xx.ravel(), xy, bins.ravel()]).tolist()]})

    # the sums of all tasks: a vector of fixed length
    parts = sample.mapInPandas(measure, "m array<double>").select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("v")).orderBy("pos").toPandas()["v"].to_numpy()
    if not len(parts):
        return Model({}, np.zeros(n), DEFAULT_SHARE)
    xx, xy, bins = parts[: n * n].reshape(n, n), parts[n * n : n * n + n], parts[n * n + n :].reshape(2, 101)
    penalty = RIDGE * np.eye(n)
    penalty[0, 0] = 1e-6
    prior = np.zeros(n)
    prior[-2] = 1.0  # without data the level is the mean of the grades
    weights = np.linalg.solve(xx + penalty, xy + penalty @ prior)
    share = DEFAULT_SHARE
    if bins.sum(axis=1).min() > 0:
        # the threshold with the fewest errors, in the middle of those that are as good
        wrong = np.array([bins[0, :c].sum() + bins[1, c:].sum() for c in range(102)])
        best = np.nonzero(wrong == wrong.min())[0]
        run = max(np.split(best, np.nonzero(np.diff(best) > 1)[0] + 1), key=len)
        share = (run[0] + run[-1]) / 200
    return Model(blank.grades, weights, share)


def levels(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, level DOUBLE): the estimate for every document, null for null, empty and blank texts and those without prose."""
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, key, text))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "level": pd.array([m.level(t) for t in pdf["t"]], dtype="Float64")})

    base = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")), "k")
    return base.mapInPandas(run, f"k {kind}, level double").withColumnRenamed("k", key)


def demanding(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id) of the documents at level 4 or 5."""
    return levels(documents, labels).where(F.col("level") >= DEMANDING).select("doc_id")
