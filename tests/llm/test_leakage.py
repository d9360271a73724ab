"""Stretches of passages, copied whole, in part and with changes; items asked again with other values."""

import itertools
import random

import numpy as np

from ravelin.llm import leakage

WORDS = [f"w{i}x" for i in range(400)] + ["the", "and", "near", "pulses", "12", "97"]


def passage(rnd, n=60):
    return [rnd.choice(WORDS) for _ in range(n)]


def noise(rnd, n):
    return [f"n{rnd.randrange(10**6)}" for _ in range(n)]


def changed(rnd, words, rate):
    out = []
    for w in words:
        x = rnd.random()
        if x < rate:
            out += [[], ["extra", w], [rnd.choice(WORDS)]][rnd.randrange(3)]
        else:
            out.append(w)
    return out


def leaks(spark, items, docs, kind=leakage.COPY):
    """The items found in each document."""
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    found = leakage.find_leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    return [sorted(r["item_id"] for r in found if r["doc_id"] == i and r["kind"] == kind) for i in range(len(docs))]


def test_stretches(spark):
    rnd = random.Random(9)
    items = [(i, " ".join(passage(rnd))) for i in range(40)]
    docs, expected = [], []
    for i, text in items:
        words = text.split()
        at = rnd.randrange(30)
        for piece in (words, words[at : at + 22], changed(rnd, words, 0.06)):
            doc = " ".join([*noise(rnd, 30), *piece, *noise(rnd, 30)])
            docs += [doc, doc.upper().replace(" ", ",\n<b>&nbsp;")]
            expected += [[i], [i]]
        docs += [" ".join([*noise(rnd, 30), *words[at : at + 12], *noise(rnd, 30)]), " ".join(changed(rnd, words, 0.8))]
        expected += [[], []]
    docs.append(" ".join([*noise(rnd, 5), items[3][1], *noise(rnd, 5), items[4][1]]))
    assert leaks(spark, items, docs) == [*expected, [3, 4]]


FRAME = "near gate {} the keeper {} counted {} pulses while the {} drum of hall {} ran dry for {} hours and nobody in row {} saw {} leave gate {} again"


def test_slots_decide(spark):
    a = FRAME.format(1, "Anna", 22, "red", 5, 7, 9, "Bert", 1)
    b = FRAME.format(8, "Olga", 31, "red", 6, 3, 2, "Emil", 8)  # every value replaced, one for one
    c = FRAME.format(8, "Olga", 8, "red", 8, 8, 8, "Olga", 3)  # no such mapping
    docs = ["x " * 20 + t for t in (a, b, c, a.upper(), b.lower())]
    assert leaks(spark, [(1, a)], docs) == [[1], [], [], [1], []]
    assert leaks(spark, [(1, a)], docs, leakage.AGAIN)[:4] == [[], [1], [], []]
    known = [(1, a), (2, "in hall nine we met Olga and then we met Emil")]  # names of any item are names in any case
    assert leaks(spark, known, docs, leakage.AGAIN) == [[], [1], [], [], [1]]


def test_without_templates_nothing_is_asked_again(spark):
    a, b = FRAME.format(1, "Anna", 22, "red", 5, 7, 9, "Bert", 1), FRAME.format(8, "Anna", 31, "red", 6, 3, 2, "Bert", 8)
    assert leaks(spark, [(1, a)], [b], leakage.AGAIN) == [[1]]
    forms = leakage.Templates(leakage.Bits())
    numbers = [np.array([leakage.word_hash(w) & ~3 for w in t.split()], dtype=np.uint64) for t in (a, b)]
    assert len(np.intersect1d(*map(leakage.windows, numbers))) < leakage.LEAST_WINDOWS <= len(np.intersect1d(*[leakage.windows(forms.numbers(t.split())) for t in (a, b)]))


def test_long_documents_and_repeats(spark):
    rnd = random.Random(3)
    items = [(1, " ".join(passage(rnd)))]
    bait = " ".join(items[0][1].split()[:9])
    assert leaks(spark, items, [" ".join([bait + " other"] * 3000), " ".join([bait + " other"] * 3000 + [items[0][1]])]) == [[], [1]]


def test_copy_far_behind_a_stray_window(spark):
    rnd = random.Random(5)
    words = passage(rnd)
    docs = [" ".join([*words[20:25], *noise(rnd, 300), *words]), " ".join([*words[20:25], *noise(rnd, 300), *words[40:45], *noise(rnd, 300), *words[3:25]])]
    assert leaks(spark, [(1, " ".join(words))], docs) == [[1], [1]]


def test_every_place_of_changed_words(spark):
    rnd = random.Random(7)
    words, around, docs = [f"p{i}" for i in range(60)], [f"n{i}" for i in range(40)], []
    for n in range(20, 27):
        at = rnd.randrange(60 - n)
        for gone in itertools.combinations(range(n), 2 if n < 24 else 3):
            docs.append(" ".join(around + ["other" if i in gone else w for i, w in enumerate(words[at : at + n])] + around))
    few = [" ".join([*around, *words[9:26], *around]), " ".join([*around, *words[9:14], "other", *words[15:20], "other", *words[21:24], "other", *words[25:29], *around])]
    assert leaks(spark, [(1, " ".join(words))], docs + few) == [[1]] * len(docs) + [[], []]


def test_names_in_any_case(spark):
    german = "als der Wärter die Straße zum Hafen sperrte zählte die Pumpe im Keller des Turms noch zwölf Stöße bevor das Wasser den Zaun der Mühle erreichte"
    english = "in the evening the keeper asked Mark to mark the gate of Rowan Hill before the rowan by the hill lost all of its leaves"
    names = "we saw Wolfgang and Amadeus and Bartholomew with Giulia near Rossini while old Chidi met Okonkwo and then Bogdan went home to sleep a while"
    items = [(1, german), (2, english), (3, "we were told that the Keeper and the Gate and the Evening were names of ships"), (4, names), (5, "here wolfgang and giulia are written small")]
    docs = [x for t in (german, english, names) for doc in (t, t.upper(), t.lower(), t.title()) for x in ("x " * 20 + doc, "x " * 20 + " ".join(doc.split()[:20]))]
    assert leaks(spark, items, docs) == [[i] for i in (1, 2, 4) for _ in range(8)]


def test_aligned():
    a = [str(i) for i in range(30)]
    assert leakage.aligned(a, a)[:2] == (30, 30)
    assert leakage.aligned(a, ["x"] + a[:10] + a[11:] + ["y"])[:2] == (30, 29)
    assert leakage.aligned(a, ["q"] * 5)[:2] == (0, 0) == leakage.aligned([], a)[:2]


def test_rows(spark, monkeypatch):
    rnd = random.Random(1)
    p = [" ".join(passage(rnd, 30)) for _ in range(3)]
    bench = spark.createDataFrame([(1, p[0] + "\nQuestion: why?", "s"), (2, p[1], "s"), (2, p[1], "s"), (3, None, "s"), (4, " \n", "s"), (None, p[2], "s")], "item_id long, text string, k string")
    docs = spark.createDataFrame([(1, p[0], 1), (1, p[0], 1), (2, None, 1), (3, "", 1), (4, "Question: why?", 1), (None, p[1], 1), (5, p[2], 1)], "doc_id long, text string, t int")
    want = sorted([("1", 1), ("1", 1), ("None", 2)])
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in leakage.find_leaks(docs, bench).collect()) == want
    monkeypatch.setattr(leakage, "SMALL", 0)  # joined by shuffles
    assert sorted({(str(r["doc_id"]), r["item_id"]) for r in leakage.find_leaks(docs, bench).collect()}) == sorted(set(want))
    assert leakage.find_leaks(docs.limit(0), bench).collect() == [] == leakage.find_leaks(docs, bench.limit(0)).collect()
