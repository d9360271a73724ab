"""Passages of held-out evaluation items inside a corpus.

Method: template canonicalisation. Texts are cut down to words (case, markup, punctuation, line breaks and invisible
characters go), numbers, units and names become typed placeholders, and the windows of five words of the items' passages
make a table (hash, item, place). The windows of the documents are joined with it by hash. Each document and item that
share windows close together are then aligned around them, and the slots behind the placeholders decide: if the words
agree, slots included, the stretch is a ``copy``; if it agrees but for slots whose values are replaced by others one for
one, the question was asked again with other values (``reparameterised``); all else is neither.

What stands for a name is told without case: a word that looks like a name in any item stands for one wherever it stands.
A name that only the document has is told by its capital; its windows are looked up with and without it.

A Bloom filter of the item windows, sized by their number, tells most windows of documents apart where these are read, and
only documents in which hits stand as close as any leak has them are kept, cut down to the regions around; those are joined.
Nothing of the benchmark passes through the driver but the filters' bits, and nothing of the documents.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import Bits, spread, word_hash
from ravelin.session import cut, small_side

#: Words of a window; a stretch of 20 words with two of them changed still has a window that is clean.
WINDOW = 5
#: A leak is a stretch of at least MIN_WORDS words of the passage, up to MAX_CHANGED of them changed, added or left out.
MIN_WORDS, MAX_CHANGED = 20, 0.13
#: A local alignment ends before a changed word near its ends, so that its stretch is up to SLACK words short; one that is
#: shorter still, but has the score of a leak, is looked at by ``stretch``.
SLACK = 2
#: Longer leaks hold a leak of at most this length: of two halves of at least MIN_WORDS words one has no more changes.
LONGEST = 2 * MIN_WORDS - 1
#: Words that a region of the document reaches beyond its shared windows.
DRIFT = 12
#: Alignment scores: a word kept, a word changed, added or left out.
KEPT, EDIT = 1.0, -2.0
#: A leak of n words with e changes keeps at least n - 4 - 5 e of its windows (each change takes five at most), and scores at
#: least n - 3 e; the least of these over all lengths, as (n, e): (24, 3) keeps 5 windows, (20, 2) scores 14.
_LEAKS = [(n, int(MAX_CHANGED * n)) for n in range(MIN_WORDS, LONGEST + 1)]
LEAST_WINDOWS = min(n - (WINDOW - 1) - WINDOW * e for n, e in _LEAKS)
LEAST_SCORE = min((n - e) * KEPT + e * EDIT for n, e in _LEAKS)
LONGEST_IN_DOC = LONGEST + int(MAX_CHANGED * LONGEST)
#: A leak lies within this many words of the shared windows that are close enough to be one's.
REACH = LONGEST_IN_DOC + DRIFT
#: A window or item table of at most so many rows is broadcast; a larger one is joined by a shuffle.
SMALL = 500_000
#: Words kept of the first or last MIN_WORDS words of any leak, whichever has more: both hold an edit only where they overlap.
LEAST_KEPT = min(MIN_WORDS - min(e, (e + 2 * MIN_WORDS - n) // 2) for n, e in _LEAKS)
MOST_EDITS = max(e for _, e in _LEAKS)
COPY, AGAIN = "copy", "reparameterised"

#: Units that follow numbers.
UNITS = set(
    "pulses kilopascal minutes seconds hours days weeks degrees revolutions litres liters millimetres millimeters centimetres "
    "metres meters kilometres pallets entries percent kilograms grams tonnes volts amperes watts bar kelvin celsius hertz rpm "
    "mm cm km kg mg ml kpa mpa sec min ms mb gb kb tb".split()
)
_TAG = re.compile(r"<[^<>\n]{1,300}>")
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_NAME = re.compile(r"(?:(?<=[a-zß-ÿ] )|(?<=[a-zß-ÿ], ))[A-Z][^\W\d_A-Z]+")
_HYPHEN = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?=[a-zß-ÿ])")


def words_of(text: str) -> list[str]:
    """The words of a text, in their order, case and markup disregarded."""
    t = text
    if "&" in t:
        t = html.unescape(t)
    if "<" in t:
        t = _TAG.sub(" ", t)
    t = _INVISIBLE.sub("", t)
    if "\n" in t:
        t = _HYPHEN.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t)
    return _WORD.findall(t)


def passage_of(text: str | None) -> str:
    """An item's passage: the first line."""
    return (text or "").strip().split("\n")[0]


def names_in(text: str) -> set[str]:
    """Words that look like names, case folded."""
    return {w.casefold() for w in _NAME.findall(text)}


def _numbered(item: list[str], doc: list[str]) -> tuple[np.ndarray, np.ndarray]:
    vocabulary: dict[str, int] = {}
    a = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in item), np.int64, len(item))
    return a, np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in doc), np.int64, len(doc))


def aligned(item: list[str], doc: list[str]) -> tuple[int, int, float, list[tuple[int, int]]]:
    """(words of the item covered, words kept, score, places of the kept words) of the best local alignment.

    Smith-Waterman, rows in numpy.
    """
    n, m = len(item), len(doc)
    if not n or not m:
        return 0, 0, 0.0, []
    a, b = _numbered(item, doc)
    score = np.zeros((n + 1, m + 1))
    steps = np.arange(m + 1) * EDIT
    for i in range(1, n + 1):
        row = np.zeros(m + 1)
        row[1:] = np.maximum(0, np.maximum(score[i - 1, :-1] + np.where(b == a[i - 1], KEPT, EDIT), score[i - 1, 1:] + EDIT))
        score[i] = np.maximum.accumulate(row - steps) + steps  # words added in the document
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    end, pairs, best = i, [], float(score[i, j])
    while i > 0 and j > 0 and score[i, j] > 0:
        same = a[i - 1] == b[j - 1]
        if abs(score[i, j] - (score[i - 1, j - 1] + (KEPT if same else EDIT))) < 1e-9:
            i, j = i - 1, j - 1
            if same:
                pairs.append((int(i), int(j)))
        elif abs(score[i, j] - (score[i - 1, j] + EDIT)) < 1e-9:
            i -= 1
        else:
            j -= 1
    return int(end - i), len(pairs), best, pairs


def stretch(item: list[str], doc: list[str]) -> bool:
    """Whether a stretch of MIN_WORDS to LONGEST words of the item stands in the document with at most MAX_CHANGED edits.

    Edit distances from every start in the item at once, against stretches of the document with free ends.
    """
    n, m = len(item), len(doc)
    if n < MIN_WORDS:
        return False
    a, b = _numbered(item, doc)
    differ = np.ones((n, m + 1), dtype=np.int16)
    differ[:, 1:] = a[:, None] != b[None, :]
    place = np.arange(m + 1, dtype=np.int16)
    row = np.zeros((n, m + 1), dtype=np.int16)  # row s: the item from word s on
    for length in range(1, min(LONGEST, n) + 1):
        row = row[: n - length + 1]
        new = row + 1  # left out
        np.minimum(new[:, 1:], row[:, :-1] + differ[length - 1 :, 1:], out=new[:, 1:])  # kept or changed
        row = np.minimum.accumulate(new - place, axis=1) + place  # added
        if length >= MIN_WORDS and row.min() <= int(MAX_CHANGED * length):
            return True
    return False


#: The last two bits of a word's number tell its case.
_TITLE, _LOWER = 1, 2


_SLOT = {c: word_hash(c) & ~3 for c in ("#n", "#u", "#p")}
_SLOT_NUMBERS = set(_SLOT.values())


class Templates(dict):
    """Word as written -> number of its template form, with its case. Filled as words come; it only saves time."""

    def __init__(self, names: Bits):
        super().__init__()
        self.names, self.forms = names, {}

    def form(self, w: str) -> str:
        """Typed placeholder of a number, unit or name, else the word itself (case folded)."""
        out = self.forms.get(w)
        if out is None:
            if len(self.forms) > 200_000:
                self.forms.clear()
            out = self.forms[w] = "#n" if w[0].isdigit() else "#u" if w in UNITS else "#p" if self.names.holds(w) else w
        return out

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        case = _TITLE if word.istitle() and len(word) > 1 else _LOWER if word.islower() else 0
        n = self[word] = (word_hash(self.form(word.casefold())) & ~3) | case
        return n

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(numbers: np.ndarray) -> np.ndarray:
    """A hash for each window of word numbers, case disregarded."""
    n = len(numbers) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    plain, h = numbers & ~np.uint64(3), np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        h = (h ^ plain[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def own_names(numbers: np.ndarray) -> np.ndarray | None:
    """The numbers with capitalised words after words in lower case as names, None if there are none."""
    case = numbers & np.uint64(3)
    own = np.zeros(len(numbers), dtype=bool)
    own[1:] = (case[1:] == _TITLE) & (case[:-1] == _LOWER) & (numbers[1:] & ~np.uint64(3) != _SLOT["#p"])
    return np.where(own, np.uint64(_SLOT["#p"]), numbers) if own.any() else None


def close(places: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of sorted places that hold as many windows as a leak has, as close as a leak has them."""
    if len(places) < LEAST_WINDOWS:
        return []
    p, q = places[: len(places) - LEAST_WINDOWS + 1], places[LEAST_WINDOWS - 1 :]
    ok = q - p <= LONGEST_IN_DOC - WINDOW
    return list(zip(p[ok].tolist(), q[ok].tolist(), strict=True))


def regions(places: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stretches of a document of n words that hold every leak around these places, merged."""
    out: list[tuple[int, int]] = []
    for p, q in close(places):
        lo, hi = max(0, p - REACH), min(n, q + WINDOW + REACH)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _holds(item: list[str], part: list[str]) -> tuple[bool, list[tuple[int, int]], int]:
    """(whether a long enough stretch of the item stands in the part, places of kept words, words of the item covered)."""
    covered, kept, score, pairs = aligned(item, part)
    if covered >= MIN_WORDS - SLACK and covered - kept <= MAX_CHANGED * covered:
        return True, pairs, covered
    return score >= LEAST_SCORE and stretch(item, part), pairs, covered


def replaced(item: list[str], part: list[str], slots: list[tuple[int, int]]) -> int | None:
    """How many slots contradict the mapping of the others; None if all values are the item's own.

    A value must become the same value wherever it stands, and no two the same one.
    """
    seen = Counter((item[i], part[j]) for i, j in slots)
    if all(a == b for a, b in seen):
        return None
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    wrong = 0
    for (a, b), n in seen.most_common():
        if to.setdefault(a, b) != b or back.setdefault(b, a) != a:
            wrong += n
    return wrong


def straight(item: np.ndarray, part: np.ndarray, diagonals: list[int]) -> tuple[int, int, int] | None:
    """(begin, length, diagonal) of a long enough stretch whose changed words are replaced one for one, the usual kind."""
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(part) - d)
        if hi - lo < MIN_WORDS:
            continue
        other = np.concatenate([[0], np.cumsum(item[lo:hi] != part[lo + d : hi + d])])
        for n, most in _STEPS:
            if n <= hi - lo:
                edits = other[n:] - other[:-n]
                at = int(edits.argmin())
                if edits[at] <= most:
                    return lo + at, n, d
    return None


#: The lengths at which a leak may have one more change.
_STEPS = [next((n, e) for n, e in _LEAKS if e == most) for most in sorted({e for _, e in _LEAKS})]


def judge(item: list[str], part: list[str], forms: Templates, own: set[str], copied: bool) -> str | None:
    """``copy``, ``reparameterised`` or None, by alignment. ``own``: words that are names in the document (case folded); ``copied``: whether it can be a copy."""
    if copied and _holds(item, part)[0]:
        return COPY
    a = list(map(forms.form, item))
    shapes = [list(map(forms.form, part))]
    if not own.isdisjoint(part):
        shapes.append(["#p" if w in own else x for w, x in zip(part, shapes[0], strict=True)])
    for b in shapes:
        holds, pairs, covered = _holds(a, b)
        slots = [(i, j) for i, j in pairs if a[i].startswith("#")]
        if holds and _again(item, part, slots, covered, len(pairs)):
            return AGAIN
    return None


def _again(item: list[str], part: list[str], slots: list[tuple[int, int]], covered: int, kept: int) -> bool:
    wrong = replaced(item, part, slots)
    return wrong is not None and covered - kept + wrong <= MAX_CHANGED * covered


def likely(item: np.ndarray, part: np.ndarray, diagonals: list[int]) -> bool:
    """Whether enough of some MIN_WORDS words in a row stand near one of the diagonals, as in any leak: it has no more edits than MOST_EDITS."""
    n = len(item)
    if n < MIN_WORDS:
        return False
    wide = np.zeros(len(part) + 2 * (n + MOST_EDITS), dtype=part.dtype)
    wide[n + MOST_EDITS : n + MOST_EDITS + len(part)] = part
    shifted = np.lib.stride_tricks.sliding_window_view(wide, n)
    for d in diagonals:
        if -n < d < len(part):
            same = (shifted[n + d : n + d + 2 * MOST_EDITS + 1] == item).any(axis=0)
            total = np.cumsum(same)
            if total[MIN_WORDS - 1] >= LEAST_KEPT or (n > MIN_WORDS and (total[MIN_WORDS:] - total[:-MIN_WORDS]).max() >= LEAST_KEPT):
                return True
    return False


class _Hashes(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[w] = word_hash(w)
        return n

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class _Read:
    """Words and numbers of items and documents."""

    def __init__(self, forms: Templates):
        self.forms, self.plain, self.passages = forms, _Hashes(), {}

    def item(self, no: int, passage: str) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words, their numbers, numbers of their template forms)."""
        hit = self.passages.get(no)
        if hit is None:
            if len(self.passages) > 20_000:
                self.passages.clear()
            words = [w.casefold() for w in words_of(passage)]
            hit = self.passages[no] = words, self.plain.of(words), self.forms.numbers(words) & ~np.uint64(3)
        return hit

    def document(self, starts, parts, own: set[str]) -> list[tuple[int, list[str], np.ndarray, list[np.ndarray]]]:
        out = []
        for start, text in zip(starts, parts, strict=True):
            words = text.split(" ")
            shapes = [self.forms.numbers(words) & ~np.uint64(3)]
            if not own.isdisjoint(words):
                shapes.append(np.where([w in own for w in words], np.uint64(_SLOT["#p"]), shapes[0]))
            out.append((start, words, self.plain.of(words), shapes))
        return out


def _judged(item: tuple[list[str], np.ndarray, np.ndarray], parts: list[tuple[int, list[str], np.ndarray, list[np.ndarray]]], p: np.ndarray, k: np.ndarray, forms: Templates, own: set[str]) -> str | None:
    best, (asked, plain, shape) = None, item
    for start, words, numbers, shapes in parts:
        inside = (p >= start) & (p < start + len(words))
        diagonals = np.unique(p[inside] - start - k[inside]).tolist()
        some = [x for x in shapes if likely(shape, x, diagonals)]
        if not some:
            continue
        copied = likely(plain, numbers, diagonals)
        if copied and straight(plain, numbers, diagonals):
            return COPY
        if not copied and (at := straight(shape, some[0], diagonals)):  # no copy: the slots decide
            i, n, d = at
            same = np.nonzero(shape[i : i + n] == some[0][i + d : i + d + n])[0] + i
            slots = [(x, x + d) for x in same.tolist() if int(shape[x]) in _SLOT_NUMBERS]
            best = best or (AGAIN if _again(asked, words, slots, n, len(same)) else None)
            continue
        for lo, hi in regions(np.unique(p[inside]) - start, len(words)):
            for x in range(lo, hi, 3 * REACH):  # long regions piece by piece, the pieces overlapping by more than a leak
                kind = judge(asked, words[x : min(hi, x + 5 * REACH)], forms, own, copied)
                if kind == COPY:
                    return COPY
                best = best or kind
    return best


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_id, no, passage): every item with a passage; ``no`` tells apart repeated ids. Null ids and blank texts are no items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"item_id": pdf["item_id"], "passage": [passage_of(t) for t in pdf["text"]]})

    kind = benchmark.schema["item_id"].dataType.simpleString()
    rows = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).mapInPandas(run, f"item_id {kind}, passage string")
    return cut(rows.where(F.col("passage") != "").withColumn("no", F.monotonically_increasing_id()))


def _names(items: DataFrame) -> Bits:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"h": np.array([word_hash(w) for w in sorted(set().union(*map(names_in, pdf["passage"])))], dtype=np.uint64).view(np.int64)})

    most = items.agg(F.coalesce(F.sum(F.length("passage")), F.lit(0))).first()[0] // 8  # hardly more words, let alone names
    return Bits.gather(items.mapInPandas(run, "h long"), most)


def find_leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, kind) of documents that hold a stretch of an item's passage, ``kind`` being copy or reparameterised.

    Null, empty and blank texts hold none; repeated documents are cases of their own, an item given twice is one. Whole
    texts are read.
    """
    spark = documents.sparkSession
    kinds = documents.schema[key].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = _items(benchmark)
    names = spark.sparkContext.broadcast(_names(items).table)

    def item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Templates(Bits(names.value))
        for pdf in batches:
            for no, passage in zip(pdf["no"], pdf["passage"], strict=True):
                h = windows(forms.numbers(words_of(passage))).view(np.int64)
                yield pd.DataFrame({"h": h, "no": no, "k": np.arange(len(h))})

    table = cut(items.select("no", "passage").mapInPandas(item_windows, "h long, no long, k int"))
    n = table.count()
    if not n:
        return spark.createDataFrame([], f"`{key}` {kinds[0]}, item_id {kinds[1]}, kind string")
    shared = spark.sparkContext.broadcast(Bits.gather(table, n).table)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms, known = Templates(Bits(names.value)), Bits(shared.value)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                words = words_of(t)
                numbers = forms.numbers(words)
                h = windows(numbers)
                at = known.has(h)
                places, hashes = at, h[at]
                if (again := own_names(numbers)) is not None:
                    h = windows(again)
                    at = known.has(h)
                    places, hashes = np.concatenate([places, at]), np.concatenate([hashes, h[at]])
                around = regions(np.unique(places), len(words)) if len(places) >= LEAST_WINDOWS else []
                if around:
                    low = [w.casefold() for w in words]
                    own = [] if again is None else sorted({low[i] for i in np.nonzero(again != numbers)[0].tolist()})
                    out.append((k, [lo for lo, _ in around], [" ".join(low[lo:hi]) for lo, hi in around], own, places.tolist(), hashes.view(np.int64).tolist()))
            yield pd.DataFrame(out, columns=["k", "starts", "parts", "own", "p", "h"])

    schema = f"k {kinds[0]}, starts array<int>, parts array<string>, own array<string>, p array<int>, h array<bigint>"
    base = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()), "k")
    kept = cut(base.mapInPandas(hits, schema).withColumn("id", F.monotonically_increasing_id()))
    pairs = kept.select("id", F.inline(F.arrays_zip("p", "h"))).join(small_side(table, SMALL), "h")
    places = pairs.groupBy("id", "no").agg(F.sort_array(F.collect_set(F.struct("p", "k"))).alias("at"))
    last = LEAST_WINDOWS - 1
    near = f"exists(sequence(0, size(at) - {LEAST_WINDOWS}), i -> at[i + {last}].p - at[i].p <= {LONGEST_IN_DOC - WINDOW})"
    cases = places.where(F.size("at") >= LEAST_WINDOWS).where(near)
    # a row for each document, with all of its items: what they share is not copied for each of them
    near_items = cases.select("id", "no", F.col("at.p").alias("p"), F.col("at.k").alias("k")).join(small_side(items, SMALL), "no")
    listed = near_items.groupBy("id").agg(F.collect_list(F.struct("no", "item_id", "passage", "p", "k")).alias("cases"))
    texts = kept.select("id", "k", "starts", "parts", "own").join(listed, "id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forms = Templates(Bits(names.value))
        read = _Read(forms)
        for pdf in batches:
            rows = []
            for x in pdf.itertuples():
                own = set(x.own)
                document = read.document(x.starts, x.parts, own)
                for c in x.cases:
                    kind = _judged(read.item(c["no"], c["passage"]), document, np.asarray(c["p"]), np.asarray(c["k"]), forms, own)
                    if kind:
                        rows.append((x.id, x.k, c["item_id"], kind))
            yield pd.DataFrame(rows, columns=["id", "k", "item_id", "kind"])

    found = texts.mapInPandas(run, f"id long, k {kinds[0]}, item_id {kinds[1]}, kind string")
    return found.groupBy("id", "item_id").agg(F.first("k").alias(key), F.min("kind").alias("kind")).select(key, "item_id", "kind")
