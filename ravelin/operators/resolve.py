"""Finding the group a caller means: exact key, key in any case, name, part of either, and at last likeness.

The first tier that finds anything wins. More than one hit is an ambiguity that is handed back, never a guess.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as tx

TIERS = ("exact", "case_insensitive", "name", "contains", "fuzzy")
LEAST_LIKENESS = 0.6
MAX_HITS = 50


def _contains(c: Column, text: str) -> Column:
    return F.coalesce(c.contains(text), F.lit(False))


def resolve(groups: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(key, name, records, match_type, similarity) of the best tier, largest groups first.

    One pass over the groups: each row gets the first tier it meets, and the best tier of all rows decides.
    Likeness is only computed where no other tier holds.
    """
    raw, norm = query.strip(), tx.normalize_name(query)
    limit = max(1, min(limit, MAX_HITS))
    likeness = F.round(F.greatest(F.coalesce(tx.dice_with(F.col("key_lower"), norm), F.lit(0.0)), F.coalesce(tx.dice_with(F.col("name_normalized"), norm), F.lit(0.0))), 2)
    plain = F.when(F.col("key") == raw, 0).when(F.col("key_lower") == raw.lower(), 1).when(F.col("name_normalized") == norm, 2).when(_contains(F.col("name_normalized"), norm) | _contains(F.col("key_lower"), norm), 3)
    rows = groups.withColumn("_plain", plain).withColumn("similarity", F.when(F.col("_plain").isNull(), likeness))
    tier = F.coalesce("_plain", F.when(F.col("similarity") >= LEAST_LIKENESS, 4))
    rows = rows.withColumn("_tier", tier).where(F.col("_tier").isNotNull())
    if not raw:
        rows = rows.where(F.lit(False))
    best = rows.agg(F.min("_tier").alias("_best"))  # one row
    hits = rows.join(F.broadcast(best), F.col("_tier") == F.col("_best"))
    hits = hits.select("key", "name", F.col("record_count").alias("records"), F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_tier") + 1).alias("match_type"), "similarity")
    return hits.orderBy(F.desc_nulls_last("similarity"), F.desc("records"), F.asc("key")).limit(limit)


def resolve_all(groups: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, key, match_type) for many queries at once, the tiers up to the name only: hash joins, no pairs.

    ``queries`` has the column query. Ambiguous queries keep all their rows.
    """
    q = queries.select("query", F.trim("query").alias("_raw"), F.lower(F.trim("query")).alias("_low"), tx.name_key(F.col("query")).alias("_norm")).distinct()
    parts = None
    for i, (own, other) in enumerate((("_raw", "key"), ("_low", "key_lower"), ("_norm", "name_normalized"))):
        part = q.join(groups, q[own] == groups[other]).select("query", "key", F.lit(i).alias("_tier"))
        parts = part if parts is None else parts.unionByName(part)
    best = parts.withColumn("_best", F.min("_tier").over(Window.partitionBy("query"))).where("_tier = _best")
    return best.select("query", "key", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("_tier") + 1).alias("match_type")).distinct()
