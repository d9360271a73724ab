"""Per-key results where a few keys own most rows.

Method: distributed exact selection. A key's values are never gathered. Each key gets a histogram of its
values whose cells hold only mergeable numbers (count, smallest, largest), so that every task folds its own
rows before the shuffle; cells that don't settle the wanted ranks are refined in another round, until they do.

* ``distinct_per_key``: the histogram is over hashed values; a cell whose smallest and largest image agree holds
  one distinct value, so the rank of a key's last value is its number of settled cells. Cells are hashed on
  (key, cell), so a hot key is spread over all tasks, and a task gets each key's cells already counted.
* ``quantiles_per_key``: keys of a bounded size are settled at once by a mergeable exact aggregate; for the hot
  ones (at most rows / limit of them) the cell that holds each wanted rank is split again until it holds one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.session import cut, small_side

#: Bits of the hashed value that the first histogram and its refinement look at.
FIRST_BITS, NEXT_BITS = 48, 64


def _prefix(image: Column, bits: int) -> Column:
    return image if bits >= 64 else F.shiftrightunsigned(image, 64 - bits)


def _cells(df: DataFrame, bits: int) -> DataFrame:
    """One row for each (key, cell) with its mergeable numbers."""
    return df.groupBy("_k", _prefix(F.col("_v"), bits).alias("_cell"), *(["_w"] if bits > 64 else [])).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_v0"), F.max("_v").alias("_v1"), F.min("_w").alias("_w0"), F.max("_w").alias("_w1"),
    )


def _settled() -> Column:
    return (F.col("_v0") == F.col("_v1")) & (F.col("_w0") == F.col("_w1"))


def distinct_per_key(df: DataFrame, key: str, value: str, first_bits: int = FIRST_BITS, next_bits: int = NEXT_BITS) -> DataFrame:
    """(key, n_rows, n_values): rows with a value, and distinct values, of each key.

    Rows with a null key or a null value don't count; an empty table gives no rows. A value is known by two
    independent 64-bit hashes, 128 bits together. ``first_bits`` sets how fine the first histogram is; cells that hold
    several values are refined on ``next_bits``, then on both hashes. Refining reads the rows again, but only the
    cells in question are shuffled.
    """
    rows = df.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{value}`").isNotNull())
    rows = rows.select(F.col(f"`{key}`").alias("_k"), F.xxhash64(F.col(f"`{value}`")).alias("_v"), F.xxhash64(F.lit(1), F.col(f"`{value}`")).alias("_w"))
    done, levels, bits = None, [b for b in (next_bits, 128) if b > first_bits], first_bits
    while True:
        cells = _cells(rows, bits)
        sums = cut(cells.groupBy("_k").agg(
            F.sum(F.when(_settled(), F.col("_n")).otherwise(0)).alias("n_rows"),
            F.sum(F.when(_settled(), 1).otherwise(0)).cast("long").alias("n_values"),
            F.sum(F.when(_settled(), 0).otherwise(1)).alias("_open"),
        ))
        done = sums.drop("_open") if done is None else done.unionByName(sums.drop("_open"))
        if not levels or sums.where("_open > 0").isEmpty():
            break
        wanted = cells.where(~_settled()).select(F.col("_k").alias("_ok"), F.col("_cell").alias("_oc"))
        rows = rows.join(wanted, (F.col("_k") == F.col("_ok")) & (_prefix(F.col("_v"), bits) == F.col("_oc")), "left_semi")
        bits = levels.pop(0)
    return done.groupBy(F.col("_k").alias(key)).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_values").alias("n_values"))


def wrong_counts(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(key): keys of groups whose record_count isn't the number of distinct ids in records with exactly that grp.

    A missing record_count is wrong; null keys are no keys; a key listed twice is given once.
    """
    counts = distinct_per_key(records.select("grp", "id"), "grp", "id")
    known = groups.where(F.col("key").isNotNull()).select("key", "record_count")
    found = known.join(counts, known["key"] == counts["grp"], "left")
    return found.where(~F.col("record_count").eqNullSafe(F.coalesce("n_values", F.lit(0)))).select("key").distinct()


def key_counts(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(key, n_rows, n_ids) for every key of groups, 0 where records has none."""
    counts = distinct_per_key(records.select("grp", "id"), "grp", "id")
    known = groups.where(F.col("key").isNotNull()).select("key").distinct()
    return known.join(counts, known["key"] == counts["grp"], "left").select("key", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_values", F.lit(0)).alias("n_ids"))


#: Keys with at most this many rows are settled in one aggregate; this bounds what one key takes in a task.
DIRECT_ROWS = 100_000
#: Cells a round splits an open range into, rounds before giving up, and most open (key, probability) pairs to broadcast.
CELLS, ROUNDS, MAX_OPEN = 256, 64, 200_000


def _scale(x: Column, log: bool) -> Column:
    """Monotone; every other round looks at magnitudes, so that values spread over many of them are split too."""
    return F.when(F.abs(x) > 1e-300, F.signum(x) * (F.ln(F.abs(x)) + 700)).otherwise(F.lit(0.0)) if log else x


def quantiles_per_key(df: DataFrame, key: str, value: str, probs: list[float], direct_rows: int = DIRECT_ROWS, cells: int = CELLS) -> DataFrame:
    """(key, n, prob, value): exact quantiles of each key, the smallest value with at least ``prob`` of the values up to it.

    Null keys, null values and NaN don't count. Ties are one value with their full count. The value comes out as DOUBLE.
    """
    if not probs or any(not 0 <= p <= 1 for p in probs):
        raise ValueError("probs must lie in 0..1")
    v = F.col(f"`{value}`").cast("double")
    rows = df.where(F.col(f"`{key}`").isNotNull() & v.isNotNull() & ~F.isnan(v)).select(F.col(f"`{key}`").alias("_k"), v.alias("_x"))
    sizes = cut(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
    hot = sizes.where(F.col("n") > direct_rows)
    probs_col = F.array(*[F.lit(float(p)) for p in sorted(set(probs))])
    hot_keys = small_side(hot.select(F.col("_k").alias("_hk")), MAX_OPEN)
    tail = rows.join(hot_keys, F.col("_k") == F.col("_hk"), "left_anti")
    # a mergeable table of value -> count for each key, at most direct_rows entries
    aggs = [F.expr(f"percentile_disc({float(p)!r}D) WITHIN GROUP (ORDER BY _x)").alias(f"_q{i}") for i, p in enumerate(sorted(set(probs)))]
    settled = tail.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), *aggs)
    settled = settled.select("_k", "n", F.posexplode(F.array(*[F.col(f"_q{i}") for i in range(len(aggs))])).alias("_i", "value")).select("_k", "n", F.element_at(probs_col, F.col("_i") + 1).alias("prob"), "value")
    open_ = hot.select("_k", "n", "_lo", "_hi", F.explode(probs_col).alias("prob")).withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("prob") * F.col("n"))).cast("long"))
    for turn in range(ROUNDS):
        if turn:
            open_ = cut(open_)
        ready = open_.where(F.col("_lo") == F.col("_hi")).select("_k", "n", "prob", F.col("_lo").alias("value"))
        settled = settled.unionByName(ready)
        open_ = open_.where(F.col("_lo") < F.col("_hi"))
        if open_.isEmpty():
            return settled.select(F.col("_k").alias(key), "n", "prob", "value")
        side = small_side(open_.withColumnRenamed("_k", "_ok"), MAX_OPEN)
        log = bool(turn % 2)
        part = (_scale(F.col("_x"), log) - _scale(F.col("_lo"), log)) / (_scale(F.col("_hi"), log) - _scale(F.col("_lo"), log))
        cell = F.least(F.lit(cells - 1), F.greatest(F.lit(0), F.floor(F.coalesce(part, F.lit(0.0)) * cells)))
        inside = rows.join(side, (F.col("_k") == F.col("_ok")) & F.col("_x").between(F.col("_lo"), F.col("_hi")))
        histogram = inside.groupBy("_k", "n", "prob", "_rank", cell.alias("_c")).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"))
        # at most `cells` rows for each open pair: the running sum over a histogram is bounded
        listed = histogram.groupBy("_k", "n", "prob", "_rank").agg(F.array_sort(F.collect_list(F.struct("_c", "_n", "_x0", "_x1"))).alias("_h"))
        walk = F.aggregate(
            "_h",
            F.struct(F.col("_rank").alias("r"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi")),
            lambda a, h: F.when(a["lo"].isNotNull(), a).when(a["r"] > h["_n"], F.struct((a["r"] - h["_n"]).alias("r"), a["lo"].alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["r"].alias("r"), h["_x0"].alias("lo"), h["_x1"].alias("hi"))),
        )
        open_ = listed.withColumn("_a", walk).select("_k", "n", F.col("_a.lo").alias("_lo"), F.col("_a.hi").alias("_hi"), "prob", F.col("_a.r").alias("_rank"))
    raise RuntimeError(f"ranks are still open after {ROUNDS} rounds")
