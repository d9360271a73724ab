"""Relevance: BM25 over title, body and names, with corpus-wide statistics, and the two-stage top list."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Weights of body and names beside the title's.
BODY_WEIGHT, NAMES_WEIGHT = 1.0, 0.5
#: The first stage keeps this many times the page, and at least so many.
OVERFETCH, LEAST_FETCH = 10, 100

Term = list[str]


def occurrences(tokens: Column, term: Term) -> Column:
    """How often a token, or a sequence of tokens, stands in an array."""
    if len(term) == 1:
        return F.size(F.filter(tokens, lambda t: t == term[0]))
    places = F.sequence(F.lit(1), F.size(tokens) - len(term) + 1)
    whole = F.array(*[F.lit(t) for t in term])
    n = F.size(F.filter(places, lambda i: F.slice(tokens, i, len(term)) == whole))
    return F.when(F.size(tokens) >= len(term), n).otherwise(0)


def matches(terms: list[Term], columns: list[str]) -> Column:
    """Any of the terms in any of the columns."""
    if not terms:
        return F.lit(False)
    single = [t[0] for t in terms if len(t) == 1]
    out = F.lit(False)
    for c in columns:
        if single:
            out = out | F.arrays_overlap(F.col(f"{c}_toks"), F.array(*[F.lit(t) for t in single]))
        for t in terms:
            if len(t) > 1:
                out = out | (occurrences(F.col(f"{c}_toks"), t) > 0)
    return out


@dataclass(frozen=True)
class Corpus:
    """Counts that scores depend on: rows, mean length, and for each term the rows that have it."""

    n: int
    mean_length: float
    df: tuple[int, ...]

    def idf(self, i: int) -> float:
        return max(math.log((self.n - self.df[i] + 0.5) / (self.df[i] + 0.5)), LEAST_IDF)


def corpus(records: DataFrame, terms: list[Term], columns: list[str]) -> Corpus:
    """One aggregate over the whole index; the result is one row."""
    aggs = [F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n_toks"), F.lit(0.0)).alias("len")]
    aggs += [F.sum(matches([t], columns).cast("int")).alias(f"t{i}") for i, t in enumerate(terms)]
    r = records.agg(*aggs).first()
    return Corpus(r["n"], r["len"], tuple(r[f"t{i}"] or 0 for i in range(len(terms))))


def bm25(terms: list[Term], stats: Corpus, weights: dict[str, float], length: Column | None = None) -> Column:
    """The score of a row over the columns that have a weight."""
    length = F.col("n_toks") if length is None else length
    norm = K1 * (1 - B + B * length / (stats.mean_length or 1.0))
    out = F.lit(0.0)
    for i, t in enumerate(terms):
        f = sum((w * occurrences(F.col(f"{c}_toks"), t) for c, w in weights.items()), F.lit(0.0))
        out = out + stats.idf(i) * f * (K1 + 1) / (f + norm)
    return out


def two_stage(scored: DataFrame, limit: int, offset: int = 0, newest: bool = False) -> DataFrame:
    """The page: best rows by ``score``, then by ``score * boost``; ties by date, newest first, then by number.

    A boosted row outside of the first stage isn't brought back.
    """
    if newest:
        return scored.orderBy(F.desc_nulls_last("date"), F.desc("seq")).offset(offset).limit(limit).withColumn("relevance", F.col("score") * F.col("boost"))
    first = scored.orderBy(F.desc("score"), F.asc("seq")).limit(max(OVERFETCH * (offset + limit), LEAST_FETCH))
    boosted = first.withColumn("relevance", F.col("score") * F.col("boost"))
    return boosted.orderBy(F.desc("relevance"), F.desc_nulls_last("date"), F.asc("seq")).offset(offset).limit(limit)
