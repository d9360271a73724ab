"""Exact counts, distinct counts, sums, averages, least and greatest numbers, in total or by up to two dimensions.

A record's own numbers are folded before anything is exploded, so a record in several buckets counts once in each and once
in the total, and the shuffle carries one small row for each record and bucket, combined on the map side.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.functions.dates import in_range
from ravelin.operators.mapping import numbers_at, scalars_at

METRICS = {"count": "count", "sum": "sum", "avg": "avg", "mean": "avg", "average": "avg", "min": "min", "max": "max", "distinct": "distinct", "count_distinct": "distinct", "unique": "distinct"}
#: An aggregate with more buckets is refused.
MAX_BUCKETS = 1_000_000
MAX_ROWS = 200
JOINT = " · "


class BadRequest(ValueError):
    pass


@dataclass(frozen=True)
class Condition:
    """``field op number``: holds if any number at the field does."""

    field: str
    op: str
    value: float

    @classmethod
    def parse(cls, raw: str) -> Condition:
        for op in (">=", "<=", "!=", ">", "<", "="):
            if op in raw:
                name, _, number = raw.partition(op)
                try:
                    value = float(number.strip().replace(",", "").replace("_", "x"))
                except ValueError:
                    break
                if name.strip() and math.isfinite(value):
                    return cls(name.strip(), op, value)
                break
        raise BadRequest(f"numeric condition {raw!r} must be <field><op><number>, op one of > >= < <= = !=")

    def column(self, numbers: Column) -> Column:
        test = {">=": lambda v: v >= self.value, "<=": lambda v: v <= self.value, "!=": lambda v: v != self.value, ">": lambda v: v > self.value, "<": lambda v: v < self.value, "=": lambda v: v == self.value}[self.op]
        return F.exists(numbers, test)


@dataclass
class AggregateRequest:
    query: str = ""
    group: str | None = None
    group_contains: str | None = None
    filters: list[tuple[str, str]] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    by: str = ""
    metric: str = "count"
    field: str | None = None
    limit: int = 20


def facet_values(name: str) -> Column:
    return F.transform(F.filter(F.coalesce("facets", F.array().cast("array<struct<field:string,value:string>>")), lambda x: x["field"] == name), lambda x: x["value"])


def facet_filter(filters: list[tuple[str, str]]) -> Column:
    """Values of one field are alternatives, fields must all hold; case and outer white space don't matter."""
    by_field: dict[str, list[str]] = {}
    for f, v in filters:
        by_field.setdefault(f, []).append(v.strip().lower())

    def any_of(f: str, values: list[str]) -> Column:
        return F.coalesce(F.exists("facets", lambda x: (x["field"] == f) & F.lower(F.trim(x["value"])).isin(*values)), F.lit(False))

    out = F.lit(True)
    for f, values in by_field.items():
        out = out & any_of(f, values)
    return out


def dimension(raw: str, facets: list[str], doc: str = "doc") -> Column:
    """The keys of a record in a dimension, sorted and distinct; ``['']`` where it has none."""
    if raw == "group":
        keys = F.array(F.coalesce("grp", F.lit("")))
    elif raw in ("year", "month", "day"):
        keys = F.array(F.substring(F.coalesce("date", F.lit("")), 1, {"year": 4, "month": 7, "day": 10}[raw]))
    elif raw in facets:
        keys = facet_values(raw)
    else:
        keys = scalars_at(F.col(doc), raw)
    keys = F.array_sort(F.array_distinct(keys))
    return F.when(F.size(keys) == 0, F.array(F.lit(""))).otherwise(keys)


def dimensions(by: str) -> list[str]:
    dims = [d for x in by.split(",") if (d := x.strip())]
    if len(dims) > 2:
        raise BadRequest("by takes at most two dimensions")
    return dims


def metric_of(name: str, fld: str | None) -> str:
    metric = METRICS.get(name.strip().lower())
    if metric is None:
        raise BadRequest(f"unknown metric {name!r}")
    if metric != "count" and not (fld or "").strip():
        raise BadRequest(f"{metric} needs a field")
    return metric


def folded(base: DataFrame, metric: str, numbers: Column | None, texts: Column | None) -> DataFrame:
    """Adds what a record brings to its buckets: count, sum, least and greatest of its numbers, or its distinct texts."""
    if metric == "distinct":
        return base.withColumn("_texts", F.array_distinct(texts))
    if metric == "count":
        return base
    base = base.withColumn("_nums", numbers)
    return base.withColumn("_n", F.size("_nums")).withColumn("_s", F.aggregate("_nums", F.lit(0.0), lambda a, x: a + x)).withColumn("_lo", F.array_min("_nums")).withColumn("_hi", F.array_max("_nums"))


def value_of(metric: str) -> Column:
    if metric == "count":
        return F.count(F.lit(1)).cast("double")
    if metric == "sum":
        return F.coalesce(F.round(F.sum("_s"), 6), F.lit(0.0))
    if metric == "avg":
        return F.coalesce(F.round(F.try_divide(F.sum("_s"), F.sum("_n")), 6), F.lit(0.0))
    return F.coalesce(F.min("_lo") if metric == "min" else F.max("_hi"), F.lit(0.0))


def totals(base: DataFrame, metric: str) -> DataFrame:
    """One row (records, value) over all matching records."""
    if metric == "distinct":
        n = base.agg(F.count(F.lit(1)).alias("records"))
        d = base.select(F.explode("_texts").alias("t")).distinct().agg(F.count(F.lit(1)).cast("double").alias("value"))
        return n.crossJoin(d)  # one row each
    return base.agg(F.count(F.lit(1)).alias("records"), value_of(metric).alias("value"))


def buckets(base: DataFrame, metric: str, keys: list[Column]) -> DataFrame:
    """(k1[, k2], records, value), a row for each bucket."""
    names = [f"k{i + 1}" for i in range(len(keys))]
    for n, k in zip(names, keys, strict=True):
        base = base.withColumn(f"_{n}", k)
    for n in names:
        base = base.withColumn(n, F.explode(f"_{n}"))
    if metric != "distinct":
        return base.groupBy(*names).agg(F.count(F.lit(1)).alias("records"), value_of(metric).alias("value"))
    # two steps, so that no bucket's texts are gathered
    counts = base.groupBy(*names).agg(F.count(F.lit(1)).alias("records"))
    each = base.select(*names, F.explode("_texts").alias("_t")).distinct().groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return counts.join(each, names, "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def top(rows: DataFrame, n_dims: int, limit: int, groups: DataFrame | None = None, group_dim: int | None = None) -> DataFrame:
    """(key, keys, name, records, value): greatest value first, then key; names are looked up for these rows only."""
    names = [f"k{i + 1}" for i in range(n_dims)]
    out = rows.select(F.concat_ws(JOINT, *names).alias("key"), F.array(*names).alias("keys"), "records", "value")
    out = out.orderBy(F.desc("value"), F.asc("key")).limit(max(1, min(limit, MAX_ROWS)))
    if groups is None or group_dim is None:
        return out.withColumn("name", F.lit(None).cast("string"))
    named = groups.select(F.col("key").alias("_g"), "name")
    return out.join(named, out["keys"][group_dim] == named["_g"], "left").drop("_g")


def group_contains(groups: DataFrame, text: str) -> DataFrame:
    """(key) of groups whose name has the text as whole words, or whose key begins with it."""
    t = " ".join(text.split()).lower()
    return groups.where(F.concat(F.lit(" "), F.coalesce("name_normalized", F.lit("")), F.lit(" ")).contains(f" {t} ") | F.col("key_lower").startswith(t)).select("key")


def date_range(since: str | None, until: str | None) -> Column:
    return F.lit(True) if since is None and until is None else F.coalesce(in_range(F.col("date"), since, until), F.lit(False))


def numbers_of(path: str, doc: str = "doc") -> Column:
    return numbers_at(F.col(doc), path)


_SPLIT = re.compile(r"\s*,\s*")


def comma_list(value: str | list[str] | None) -> list[str]:
    """``a, b`` or a list, blanks left out."""
    if value is None:
        return []
    return [x for x in (_SPLIT.split(value.strip()) if isinstance(value, str) else value) if x.strip()]


def where_pairs(where: dict | list | str | None) -> list[tuple[str, str]]:
    """Filters given as ``{field: value or values}``, ``[{field, value}]`` or ``["field=value"]``."""
    if not where:
        return []
    if isinstance(where, dict):
        return [(f, str(v)) for f, vs in where.items() for v in (vs if isinstance(vs, list) else [vs])]
    out = []
    for x in [where] if isinstance(where, str) else where:
        if isinstance(x, dict):
            out.append((x["field"], str(x["value"])))
        elif "=" in x:
            f, _, v = x.partition("=")
            out.append((f.strip(), v.strip()))
        else:
            raise BadRequest(f"filter {x!r} must be field=value")
    return out


def as_bool(value: object) -> bool:
    """Booleans, also as text."""
    return value.strip().lower() in ("true", "1", "yes", "on") if isinstance(value, str) else bool(value)
