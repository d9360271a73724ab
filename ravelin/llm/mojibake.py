"""Text that was decoded with a wrong encoding: find it, and restore it where the bytes still tell.

Method: best-first search. A state is a piece of text (a run without ASCII white space); an edge encodes it with one
code page and decodes the bytes with another, or undoes an escape. States are hashed, so none is looked at twice; the
queue is ordered by a character-plausibility cost plus the cost of the steps taken, and the cheapest reachable text
wins. UTF-8 sequences are decoded one by one, so a piece may hold garbled and correct characters side by side.

A branch ends where a lower bound of every text behind it reaches the best one. Such bounds are exact for decoded UTF-8
sequences, which are followed however dear the text between is, as text garbled several times is dear until the last
step; a piece read again in another code page is followed while another such step can still make it the best. A search that
runs out of states says so, and what it found doesn't count as complete.

Pieces repeat a lot: results are memoised in each task. Texts in plain ASCII without question marks inside of words
never reach Python. One pass, no shuffle.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import spread

#: Code pages that text was wrongly read with, and single- and multi-byte ones it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-2", "iso8859-15", "koi8-r", "cp866", "cp1253", "cp1254")
WRITTEN_IN = ("cp932", "euc_jp", "koi8-r", "cp1251", "cp866", "cp1250", "cp1252", "cp850", "iso8859-2", "cp1253", "cp1254", "cp1255", "gb18030", "big5", "cp949")
#: Cost of a step (valid UTF-8 sequences hardly arise by chance, other code pages fit anything), least gain for a text to
#: count as garbled, and bounds of one search.
UTF8_COST, PAGE_COST, LEAST_GAIN, MAX_STATES = 1.0, 4.0, 2.0, 2_000
#: Least cost of a character, and most characters of a text that one of another can stand for.
LEAST_CHAR, MOST_BYTES = 0.1, 4
#: Rare words of a script may read as another text by chance; such a gain counts only if it is so much for each character.
PAGE_GAIN = 0.5
#: In longer pieces paths are looked for in parts of this length, which overlap so that no character's bytes are cut in
#: all of them, and which may begin or end so many characters later or earlier, inside of no character. A path is then
#: applied to the whole piece, or as far as it goes.
PIECE, OVERLAP, CUTS = 1_000, 100, 3
MEMO = 200_000

#: How often (in 1000 letters) a letter stands in Russian text.
RUSSIAN = {"о": 110, "е": 85, "а": 80, "и": 74, "н": 67, "т": 63, "с": 55, "р": 47, "в": 45, "л": 44, "к": 35, "м": 32, "д": 30, "п": 28, "у": 26, "я": 20, "ы": 19, "ь": 17, "г": 17, "з": 16, "б": 16, "ч": 14, "й": 12, "х": 10, "ж": 9, "ш": 7, "ю": 6, "ц": 5, "щ": 4, "э": 3, "ф": 3, "ъ": 1, "ё": 2}
#: Greek and Hebrew letters, the most frequent first; the cost of a letter rises with its place.
GREEK = "αοιετσνηυρπκμλςωόίάδγέύήχθώφβξζψϊϋ"
HEBREW = "יוהלארתבשמםנקדחעפטןצגכזסךץףם"
#: Letters of the larger European languages beyond a-z, and signs that are usual in prose.
COMMON_LETTERS = "äöüßéèêëàâçñáíóúãõôîïûùœæøåąćęłńśźżòìýčšžřěůďťňğşıőű"
COMMON_SIGNS = "’‘“”„‚«»‹›–—…·•°§€£¥©®™½¼¾×µªº−±²³¿¡№†‡、。・「」『』（）！？：；ー　"
BETWEEN_LETTERS = "’‘·–—-'"
#: Letters that, alone between spaces, are words of some language.
ONE_LETTER_WORDS = set("àáèéêòóôyaeiouìAÀEYOIавикосуяВИКОСУЯА")


def _pages() -> dict[str, dict[str, int]]:
    """Code page -> character -> byte, undefined bytes standing for the control character of the same number."""
    out = {}
    for page in READ_AS:
        table = {}
        for b in range(256):
            try:
                c = bytes([b]).decode(page)
            except UnicodeDecodeError:
                c = chr(b)
            table.setdefault(c, b)
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
        out[page] = table
    return out


PAGES = _pages()


def _sequences(page: dict[str, int]) -> re.Pattern:
    """Matches the characters that the bytes of one UTF-8 character became."""
    group = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in page.items() if lo <= b <= hi) + "]"
    tail = group(0x80, 0xBF)
    return re.compile(f"{group(0xC2, 0xDF)}{tail}|{group(0xE0, 0xEF)}{tail}{{2}}|{group(0xF0, 0xF4)}{tail}{{3}}")


UTF8 = {page: _sequences(table) for page, table in PAGES.items()}
#: Something outside of ASCII, or question marks that may stand for lost characters, or an escape.
SUSPECT = r"[^\x00-\x7f]|\w\?\?+\w|(?:^|[\s\"(])\?\?+\w|\w\?\w|&#?\w{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}"
_SCRIPTS = (("CYRILLIC", "c"), ("LATIN", "l"), ("GREEK", "g"), ("CJK", "j"), ("HIRAGANA", "j"), ("KATAKANA", "j"), ("HANGUL", "k"), ("FULLWIDTH", "j"), ("HEBREW", "h"))


#: Lead bytes of the usual characters in the Japanese, Chinese and Taiwanese standards.
_USUAL = (("cp932", 0x88, 0x97), ("gb2312", 0xB0, 0xD7), ("big5", 0xA4, 0xC6))


def _kanji(c: str) -> float:
    """Characters of the first level of a national standard are the usual ones; the more standards agree, the more so."""
    n = 0
    for page, lo, hi in _USUAL:
        try:
            n += lo <= c.encode(page)[0] <= hi
        except UnicodeEncodeError:
            pass
    return (8.0, 4.5, 4.0, 3.5)[n]


def _hangul(c: str) -> float:
    """Syllables of KS X 1001 are the usual ones."""
    try:
        c.encode("euc_kr")
    except UnicodeEncodeError:
        return 8.0
    return 3.5


_KANA = re.compile("[぀-ヿ]")


@lru_cache(maxsize=70_000)
def _foreign(c: str) -> bool:
    """Whether a Han character is none of Japanese."""
    try:
        return "一" <= c <= "鿿" and not c.encode("cp932")
    except UnicodeEncodeError:
        return True


@lru_cache(maxsize=70_000)
def _char(c: str) -> tuple[float, str]:
    """(cost, kind): kind is a script letter for letters, else ``.`` sign, ``#`` symbol, ``!`` damage, ``0`` the rest."""
    o = ord(c)
    if o < 0x80:
        return (8.0, "!") if (o < 32 and c not in "\n\r\t") or o == 127 else (0.1, "l" if c.isalpha() else "0")
    if c == "\ufffd" or 0x80 <= o < 0xA0 or 0xE000 <= o < 0xF900:
        return 12.0, "!"
    cat = unicodedata.category(c)
    if c in COMMON_SIGNS:
        return 1.5, "."
    if cat[0] == "L":
        name = unicodedata.name(c, "")
        script = next((s for n, s in _SCRIPTS if n in name), "o")
        low = c.lower()
        if script == "c":
            return (-0.8 - 0.7 * math.log(RUSSIAN[low] / 1000) if low in RUSSIAN else 6.0) + 0.3 * (c != low), "c"
        if script == "l":
            return (1.2 if low in COMMON_LETTERS else 4.0), "l"
        if script == "j" and "CJK" in name:
            return _kanji(c), "j"
        if script == "k":
            return _hangul(c), "k"
        if script in "gh":
            at = (GREEK if script == "g" else HEBREW).find(low)
            return (1.0 + 0.08 * at if at >= 0 else 5.0) + 0.3 * (c != low), script
        return (6.0 if 0xFF61 <= o <= 0xFF9F or script == "o" else 1.0 if script == "j" else 1.6 + 0.3 * (c != low)), script
    if c == "\u00a0":
        return 1.5, "0"
    if cat[0] in "CZ":
        return 6.0, "#"
    return (5.0 if cat[0] != "M" else 3.0 if o < 0x370 else 6.0), "#"


def plausibility(text: str) -> float:
    """Cost of a text: rare characters, signs inside of words, mixed scripts and odd case make it dear."""
    cost, before, before_c, run = 0.0, " ", " ", 0
    n = len(text)
    for i, c in enumerate(text):
        own, kind = _char(c)
        cost += own
        if kind in "lcgjkho" and before in "lcgjkho":
            if kind != before:
                cost += 4.0
            elif kind in "lcg" and c.isupper() and before_c.islower():
                cost += 3.0
            elif kind == "l" and ord(c) > 0x7F and ord(before_c) > 0x7F and c.islower() and before_c.isupper():
                cost += 2.5
        elif kind in ".#" and before in "lcgo" and i + 1 < n and _char(text[i + 1])[1] in "lcgo" and c not in BETWEEN_LETTERS:
            cost += 3.5
        elif kind in ".#" and before in ".#" and (ord(c) > 0x7F and ord(before_c) > 0x7F) and kind + before != "..":
            cost += 1.5
        elif kind == "." and before == "." and c not in "…”“’„。」":
            cost += 1.0
        elif kind == "." and before in "lcgo" and c in "¿¡°§©№„“«‚½¼¾³²":
            cost += 2.5
        run = run + 1 if kind == "l" and ord(c) > 0x7F else 0
        if run > 1:  # hardly any language has accented letters in a row
            cost += 0.7 if run == 2 else 3.0
        before, before_c = kind, c
    if _KANA.search(text):  # kana stand beside Japanese characters only
        cost += 3.0 * sum(map(_foreign, text))
    return cost


def _utf8_part(page: str, text: str) -> str:
    table = PAGES[page]

    def one(m: re.Match) -> str:
        try:
            return bytes(table[c] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    return UTF8[page].sub(one, text)


def _raw(page: str, text: str) -> bytes | None:
    try:
        return bytes(map(PAGES[page].__getitem__, text))
    except KeyError:
        return None


def _read(raw: bytes | None, source: str) -> str | None:
    try:
        return None if raw is None else raw.decode(source)
    except UnicodeDecodeError:
        return None


def _unescaped(text: str) -> str | None:
    out = html.unescape(text) if "&" in text else text
    if "\\" in out:
        out = re.sub(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})", lambda m: chr(int(m.group(1) or m.group(2), 16)), out)
    return None if any(0xD800 <= ord(c) < 0xE000 for c in out) else out


def _step(name: str, text: str) -> str | None:
    if name == "unescape":
        return _unescaped(text)
    page, _, source = name.partition(">")
    return _utf8_part(page, text) if source == "utf-8" else _read(_raw(page, text), source)


class _Costs(dict):
    def __missing__(self, c: str) -> float:
        x = self[c] = _char(c)[0]
        return x


_COSTS = _Costs()


def least_cost(text: str) -> float:
    """No text is more plausible than its characters one by one: what ``plausibility`` adds for neighbours is never negative."""
    return sum(map(_COSTS.__getitem__, text))


def _edges(text: str) -> Iterator[tuple[str, float, str]]:
    """(name of the step, its cost, what it makes of the text); equal bytes of several code pages are read once."""
    for page in READ_AS:
        out = _utf8_part(page, text)
        if out != text:
            yield f"{page}>utf-8", UTF8_COST, out
    if "&" in text or "\\" in text:
        out = _unescaped(text)
        if out is not None and out != text:
            yield "unescape", UTF8_COST, out
    seen = set()
    for page in READ_AS:
        raw = _raw(page, text)
        if raw is None or raw in seen:
            continue
        seen.add(raw)
        for source in WRITTEN_IN:
            if source != page and (out := _read(raw, source)) is not None:
                yield f"{page}>{source}", PAGE_COST, out


def search(text: str) -> tuple[str, tuple[str, ...]]:
    """(cheapest text reachable, names of the steps to it)."""
    return searched(text)[:2]


def searched(text: str) -> tuple[str, tuple[str, ...], bool]:
    """``search``, and whether all that could be cheaper was looked at."""
    start = plausibility(text)
    floor = UTF8_COST + LEAST_CHAR * (len(text) / MOST_BYTES)
    if start - floor < LEAST_GAIN:  # no text at all would be a gain
        return text, (), True
    best, best_cost, best_path = text, start, ()
    seen = {text}
    queue: list[tuple[float, float, str, tuple[str, ...]]] = [(start, 0.0, text, ())]
    while queue:
        if len(seen) >= MAX_STATES:
            break
        _, spent, state, path = heappop(queue)
        if spent + UTF8_COST + LEAST_CHAR * (len(state) / MOST_BYTES) >= best_cost:
            continue
        for name, price, out in _edges(state):
            if out in seen:
                continue
            seen.add(out)
            decoded = len(out) < len(state) and price == UTF8_COST
            low = spent + price + least_cost(out)
            if low >= best_cost and not decoded and low > start:
                continue
            total = spent + price + plausibility(out)
            if total < best_cost and (price == UTF8_COST or total < start - PAGE_GAIN * len(text) or path):
                best, best_cost, best_path = out, total, (*path, name)
            if decoded or total <= best_cost + PAGE_COST:
                heappush(queue, (total, spent + price, out, (*path, name)))
    whole = not queue
    return (best, best_path, whole) if start - best_cost >= LEAST_GAIN else (text, (), whole)


def follow(text: str, path: tuple[str, ...], sure: bool = False) -> str:
    """Take the steps that helped another piece of the same text; the text itself where they make it no likelier.

    ``sure``: the whole text was read in one code page, so what is as likely is taken too.
    """
    out = _applied(text, path)
    if out is None:
        return text
    new, old = plausibility(out), plausibility(text)
    return out if new < old or sure and new == old else text


def _applied(text: str, path: tuple[str, ...]) -> str | None:
    out: str | None = text
    for name in path:
        out = _step(name, out)
        if out is None:
            return None
    return out


def _widest(text: str, lo: int, hi: int, path: tuple[str, ...], whole: bool) -> tuple[float, int, int, str] | None:
    """(gain, begin, end, what replaces it) of the widest stretch around a part that the path makes likelier."""
    page = PAGES.get(path[0].split(">")[0])
    first, last = lo, hi  # the run of characters that the code page has
    while page and first > 0 and text[first - 1] in page:
        first -= 1
    while page and last < len(text) and text[last] in page:
        last += 1
    tries = [(0, len(text))] if whole else []
    tries += [(a, b) for a in (*range(first, min(first + CUTS, lo)), lo) for b in (*range(last, max(last - CUTS, hi), -1), hi)]
    for a, b in tries:
        out = _applied(text[a:b], path)
        if out is not None and (gain := plausibility(text[a:b]) - plausibility(out)) >= LEAST_GAIN:
            return gain, a, b, out
    return None


def search_long(text: str) -> tuple[str, tuple[str, ...], bool]:
    """``searched`` for texts of any length: paths are found on parts, and applied to all of the text that they fit."""
    at, used, whole = 0, {}, True
    while at < len(text):
        end = min(at + PIECE, len(text))
        part = text[at:end]
        best = None
        if not part.isascii() or "&" in part or "\\" in part:
            cut_before, cut_behind = at and not text[at : at + CUTS].isascii(), end < len(text) and not text[end - CUTS : end].isascii()
            for late in range(CUTS if cut_before else 1):
                tries = [searched(text[at + late : end - early]) for early in range(CUTS if cut_behind else 1)]
                whole &= all(x[2] for x in tries)
                paths = {x[1] for x in tries} - {()}
                tried = [(x, path) for path in sorted(paths) for x in (_widest(text, at + late, end, path, path not in used) or _widest(text, at + late, end - CUTS, path, False),) if x]
                if tried:
                    best = max(tried, key=lambda x: x[0][0])
                    break
        if best is None:
            at += PIECE - OVERLAP if end < len(text) else PIECE
            continue
        (_, a, b, out), path = best
        used[path] = used.get(path, 0) + b - a
        text = text[:a] + out + text[b:]  # and the same part again, until nothing makes it likelier
        at = min(at, len(text))
    return text, max(used, key=used.get, default=()), whole


_LOST = re.compile(r"[^\W\d_]\?\?+[^\W\d_]|^[\"(]*\?\?+[^\W\d_]|^[^\W\d_]+\?[^\W\d_]+$")
_DAMAGE = re.compile("[\ufffd\x80-\x9f]|[^\\W_][─-▟]|[─-▟][^\\W_]")


class Restorer:
    """Looks at whole texts, remembering pieces."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[str, tuple[str, ...], bool]] = {}

    def piece(self, p: str) -> tuple[str, tuple[str, ...], bool]:
        hit = self.memo.get(p)
        if hit is None:
            hit = search_long(p) if len(p) > PIECE else searched(p)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            if len(p) <= 200:
                self.memo[p] = hit
        return hit

    def text(self, t: str) -> tuple[str, bool, bool]:
        """(restored text, garbled?, fully restored?).

        A lone letter or quotation mark is evidence only beside other evidence: texts that quote such characters as their
        topic show them alone and are otherwise correct.
        """
        parts = re.split(r"([ \t\r\n]+)", t)
        before = list(parts)
        strong = lost = cut = False
        paths: dict[tuple[str, ...], int] = {}
        plain: list[int] = []
        for i in range(0, len(parts), 2):
            p = parts[i]
            if not p:
                continue
            if "?" in p and _LOST.search(p) and "=" not in p and "/" not in p:
                strong = lost = True
            if p.isascii() and "&" not in p and "\\" not in p:
                continue
            if p.isascii():  # escapes alone are a way of writing, not damage; what they stand for may be garbled
                u = _unescaped(p)
                out, path, whole = self.piece(u) if u and u != p else (p, (), True)
                if all(step == "unescape" for step in path):
                    plain.append(i)
                    continue
                path = ("unescape", *path)
            else:
                out, path, whole = self.piece(p)
            cut |= bool(path) and not whole
            damaged = bool(_DAMAGE.search(out))
            if path or damaged:
                core = out.strip(".,;:!?()[]\"'")
                alone = len(core) == 1 and (core in "’‘“”\ufffd" or core.isalpha())
                strong |= not alone
                lost |= damaged
                if path:
                    paths[path] = paths.get(path, 0) + 1
                parts[i] = out
            else:
                plain.append(i)
        if not strong:  # words too short to tell on their own may tell together
            dense = [parts[i] for i in plain if 2 * sum(not c.isascii() for c in parts[i]) > len(parts[i])]
            path = self.piece(" ".join(dense))[1] if len(dense) > 1 else ()
            if not path:
                return t, False, True
            paths[path] = 1
        for i in plain:
            for path in sorted(paths, key=paths.get, reverse=True):
                out = follow(parts[i], path, paths[path] > 1 and not path[-1].endswith("utf-8"))
                if out != parts[i]:
                    parts[i] = out
                    break
        if any(not p[-1].endswith("utf-8") and p[-1] != "unescape" for p in paths):
            # read again in another code page: the words of a text agree on one, which tells more than each alone
            own = [i for i in range(0, len(before), 2) if not before[i].isascii()]
            path = self.piece(" ".join(before[i] for i in own))[1] if len(own) > 1 else ()
            new = {i: out for i in own if path and (out := _applied(before[i], path)) is not None and plausibility(out) <= plausibility(before[i]) + LEAST_GAIN}
            each_its_own = 2 * PAGE_COST * (len(paths) - 1)
            if sum(map(plausibility, new.values())) < sum(plausibility(parts[i]) for i in new) + each_its_own:
                for i, out in new.items():
                    parts[i] = out
        for i in range(0, len(parts) - 1, 2):  # a no-break space that became a space left the first byte of à alone
            if parts[i] == "Ã" and parts[i + 1][:2] == "  ":
                parts[i], parts[i + 1] = "à", parts[i + 1][1:]
        return "".join(parts), True, not lost and not cut


def _suspect(c: Column) -> Column:
    return c.rlike(SUSPECT)


def fields_of(tickets: DataFrame, key: str = "seq", fields: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """(key, field, text) of the texts worth a look."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return tickets.select(key, *fields).select(key, F.inline(cells)).where(_suspect(F.col("text")))


def restore(tickets: DataFrame, key: str = "seq", fields: tuple[str, ...] = ("subject", "body")) -> DataFrame:
    """(key, field, restored, complete): the garbled fields, with their text as far as it can be restored.

    ``complete`` is false where characters are lost for good (these stay as they are) and where a search ran out of states. Null, empty and plain texts give no
    row; repeated rows give their rows again.
    """
    kind = tickets.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer()
        for pdf in batches:
            rows = [(k, f, out, whole) for k, f, t in zip(pdf["k"], pdf["field"], pdf["text"], strict=True) for out, bad, whole in (restorer.text(t),) if bad]
            yield pd.DataFrame(rows, columns=["k", "field", "restored", "complete"])

    cells = fields_of(spread(tickets.select(key, *fields), key), key, fields).withColumnRenamed(key, "k")
    return cells.mapInPandas(run, f"k {kind}, field string, restored string, complete boolean").withColumnRenamed("k", key)


def found(tickets: DataFrame) -> DataFrame:
    """(seq, field) of the garbled fields."""
    return restore(tickets).select("seq", "field")
