"""Per-key counts and quantiles against plain Python, with coarse histograms so that refinement is exercised."""

import math
import random

import pytest

from ravelin.operators import skew

COLS = "grp string, id string, x double, _k int, _v string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = []
    for i in range(6000):
        grp = "hot" if rnd.random() < 0.4 else rnd.choice([f"g{k}" for k in range(40)] + [None])
        x = rnd.choice([None, float("nan"), 0.0, -1.5, rnd.gauss(0, 1), rnd.uniform(0, 1) ** 40 * 1e9, float(rnd.randint(1, 5))])
        out.append((grp, rnd.choice([None, f"id{rnd.randint(0, 1500)}", f"id{i}"]), x, 1, "z"))
    return out


@pytest.mark.parametrize("bits", [(2, 8), (10, 64), (48, 64)])
def test_distinct(spark, rows, bits):
    want = {}
    for g, i, *_ in rows:
        if g is not None and i is not None:
            want.setdefault(g, []).append(i)
    got = skew.distinct_per_key(spark.createDataFrame(rows, COLS), "grp", "id", *bits).collect()
    assert {r["grp"]: (r["n_rows"], r["n_values"]) for r in got} == {g: (len(v), len(set(v))) for g, v in want.items()}


@pytest.mark.parametrize("direct", [0, 500, 10**6])
def test_quantiles(spark, rows, direct):
    probs = [0.0, 0.5, 0.9, 1.0]
    want = {}
    for g, _, x, *_ in rows:
        if g is not None and x is not None and x == x:
            want.setdefault(g, []).append(x)
    want = {(g, p): (len(v), sorted(v)[max(1, math.ceil(p * len(v))) - 1]) for g, v in want.items() for p in probs}
    got = skew.quantiles_per_key(spark.createDataFrame(rows, COLS), "grp", "x", probs, direct_rows=direct, cells=8).collect()
    assert {(r["grp"], r["prob"]): (r["n"], r["value"]) for r in got} == want


def test_wrong_counts(spark):
    groups = spark.createDataFrame([("a", 2, "x"), ("b", 0, None), ("c", 1, None), ("d", None, None), (None, 5, None), ("e", 3, None), ("e", 3, None)], "key string, record_count long, grp string")
    records = spark.createDataFrame([("a", "1", 9), ("a", "1", 9), ("a", "2", 9), ("c", None, 9), (None, "7", 9), ("A", "8", 9)], "grp string, id string, key int")
    assert sorted(r["key"] for r in skew.wrong_counts(groups, records).collect()) == ["c", "d", "e"]
    assert {tuple(r) for r in skew.key_counts(groups, records).collect()} == {("a", 3, 2), ("b", 0, 0), ("c", 0, 0), ("d", 0, 0), ("e", 0, 0)}


def test_empty(spark):
    none = spark.createDataFrame([], COLS)
    assert skew.distinct_per_key(none, "grp", "id").collect() == []
    assert skew.quantiles_per_key(none, "grp", "x", [0.5]).collect() == []
    assert skew.wrong_counts(spark.createDataFrame([], "key string, record_count long"), none).collect() == []
    with pytest.raises(ValueError):
        skew.quantiles_per_key(none, "grp", "x", [1.5])
