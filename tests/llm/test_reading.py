"""Levels of made-up texts on held-out documents, and the odd cases."""

import random

from ravelin.llm import reading

COMMON = [f"word{i}" for i in range(30)]


def token(level, k):
    return "".join(chr(97 + int(c)) for c in f"{level}{k:03}") + "xyz"


def text(rnd, level):
    own = [token(level, rnd.randrange(60)) for _ in range(70)]
    near = [token(min(5, max(1, level + rnd.choice([-1, 1]))), rnd.randrange(60)) for _ in range(30)]
    words = own + near + rnd.choices(["alpha", "beta", "gamma"], k=20)
    rnd.shuffle(words)
    return " ".join(words)


def corpus(n=400):
    rnd = random.Random(6)
    docs = []
    for i in range(n):
        level = rnd.choice([None, 1, 2, 3, 4, 5])
        docs.append((i, "rc=1; id=7 INFO sync\n" * 20 if level is None else text(rnd, level), level))
    return docs


def test_held_out(spark):
    docs = corpus()
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in docs], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, lv, "r1") for i, _, lv in docs if i % 2], "doc_id long, reading_level int, text string")
    got = {r["doc_id"]: r["level"] for r in reading.levels(d, labels).collect()}
    held = [(lv, got[i]) for i, _, lv in docs if not i % 2]
    assert all(v is None for lv, v in held if lv is None)
    errors = [abs(lv - v) for lv, v in held if lv is not None]
    assert sum(errors) / len(errors) < 0.35
    hard = {r["doc_id"] for r in reading.demanding(d, labels).collect()}
    wrong = [i for i, _, lv in docs if not i % 2 and (lv in (4, 5)) != (i in hard)]
    assert len(wrong) <= 0.03 * len(held)


def test_odd_cases(spark):
    labels = "doc_id long, reading_level int"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "some words here"), (1, None), (4, "long words " * 50_000)], "doc_id long, text string")
    none = spark.createDataFrame([], labels)
    rows = reading.levels(docs, none).collect()
    assert len(rows) == 6 and all(r["level"] is None for r in rows)
    odd = spark.createDataFrame([(4, 9), (None, 3), (4, None), (77, 2)], labels)
    assert len(reading.levels(docs, odd).collect()) == 6
    assert reading.demanding(docs.limit(0), odd).collect() == []
    assert reading.levels(docs.limit(0), none).collect() == []


def test_fitting_is_bounded(spark, monkeypatch):
    docs = corpus(120)
    d = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, lv) for i, _, lv in docs], "doc_id long, reading_level int")
    monkeypatch.setattr(reading, "MAX_GRADED", 40)
    monkeypatch.setattr(reading, "MAX_WORDS", 50)
    model = reading.fit(d, labels)
    assert 0 < len(model.grades) <= 50
    assert reading.graded(d, labels, "doc_id", "text").count() < 100
