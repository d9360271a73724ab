"""Names of persons in free text, by general evidence and by what other texts of the corpus tell.

Evidence within a text: a title before a name (``Frau Krähbusch``), an initial (``T. Halvick``), a place where letters and
tickets name people (``Regards, X Y``, ``spoke to X Y``, ``Dear X``), an honorific behind a name written without spaces,
or a usual given name.

Evidence across texts: ``learn`` counts, in one pass over all texts, how often each word stands as the given name or the
surname of somebody introduced in one of these ways, and how often it is capitalised at all. Words that are introduced
in several places, and in a fair share of them, are names wherever they stand, in any case and without any introduction.
They are kept in Bloom filters, whose size is bounded whatever the corpus holds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm.common import Bits, word_hash
from ravelin.session import cut

#: A word is a learned name if it is introduced as one so often, and in such a share of the places where it is capitalised.
LEAST_INTRODUCED, LEAST_SHARE = 2, 0.2
#: Words remembered in a task; when full they are handed on, so memory is bounded.
MOST_WORDS = 300_000

#: Usual given names of several languages, with the gender they are usual for (n: either).
GIVEN = {
    "alexander": "m", "andrea": "n", "anna": "f", "antonio": "m", "carlos": "m", "charles": "m", "christian": "m", "claudia": "f", "daniel": "m", "david": "m",
    "elena": "f", "elizabeth": "f", "emma": "f", "fatima": "f", "francesco": "m", "giulia": "f", "giovanni": "m", "hans": "m", "helena": "f", "ibrahim": "m",
    "ivan": "m", "james": "m", "jan": "m", "jean": "n", "jennifer": "f", "johann": "m", "john": "m", "josé": "m", "juan": "m", "julia": "f",
    "katarzyna": "f", "klaus": "m", "laura": "f", "linda": "f", "luis": "m", "marco": "m", "maria": "f", "maría": "f", "marie": "f", "martin": "m",
    "mary": "f", "michael": "m", "mohammed": "m", "natalia": "f", "olga": "f", "patricia": "f", "paul": "m", "pedro": "m", "peter": "m", "petra": "f",
    "philippe": "m", "piotr": "m", "pierre": "m", "robert": "m", "sarah": "f", "sofia": "f", "stefan": "m", "susan": "f", "thomas": "m", "ursula": "f",
    "william": "m", "wolfgang": "m", "yuki": "n", "анна": "f", "иван": "m", "мария": "f", "ольга": "f", "сергей": "m",
}
#: Titles and the gender they tell.
TITLES = {"herr": "m", "herrn": "m", "frau": "f", "mr": "m", "mrs": "f", "ms": "f", "miss": "f", "mme": "f", "mlle": "f", "monsieur": "m", "madame": "f", "dr": "n", "prof": "n", "señor": "m", "señora": "f", "sr": "m", "sra": "f", "senhor": "m", "senhora": "f", "signor": "m", "signora": "f", "господин": "m", "госпожа": "f"}
PARTICLES = "von|van|de|der|den|di|da|del|della|al|el|la|le|du|bin|ibn|zu|ter|dos|das"
_PARTICLES = set(PARTICLES.split("|"))
#: Last words of names of companies, sites and products.
NO_PERSON = set(
    "foods rail freight logistics clinics insurance timber textiles robotics studios schools labs energy steel press motors telecom "
    "mining ports farms optics hotels works water group gmbh inc ltd sa ag llc plc kg co énergie bay site gateway editor console "
    "agent portal forms billing mail archive router scheduler ledger vault reports sync server plugin team office project street road "
    "lane hill way cottage crescent avenue system service desk support helpdesk department sales accounts bank university".split()
)
#: Words that begin sentences or greet nobody by name; an initial or a greeting before them doesn't make a name.
STARTERS = set(
    "the this that these those we you they he she it i a an please is are was were if when after before since can could let nothing "
    "in on at for from to of and or but not no our your my their there here what why how who which every some only whenever "
    "all both sir madam everyone everybody colleague colleagues customer team support friends again "
    "die der das ein eine wir sie ist bitte nach für im am le la les un une merci où el los las una por o os as se ça alle".split()
)
#: Words before a name of a person ...
_BEFORE_INITIAL = set("regards contact sender by to ask reach with laut gruß llame a appeler d’appeler employee von an bei from for dear hi hello hallo bonjour cc attn thanks cheers sincerely greetings grüße best saludos cordialement merci wishes and et und y e de".split())
#: ... of letters, labels, and speaking: (the word before, what stands before that, if it alone doesn't tell).
_SIGNED = set("regards wishes sincerely cheers greetings gruß grüße cordialement saludos atentamente abraços saluti уважением".split())
_LABELS = set("contact sender caller requester reporter author attn ansprechpartner absender kontakt contacto remitente expéditeur signed name".split())
_GREETED = set("dear hi hello hallo bonjour hola olá liebe lieber greetings ciao caro cara".split())
_TOLD = re.compile(r"\b(?:spoke|talked|speak|talk|agreed|filled in|signed|lost|forwarded|written|sent|reported|approved|confirmed|taken|handled|answered|met|can|could) (?:to|with|by|up by|over by|reach)\s$", re.I)
_ALONE = re.compile(r"(?:\b(?:laut|llame a|appeler|new employee|neuer mitarbeiter|neue mitarbeiterin|nouvel employé|nuevo empleado)|\bd’appeler)\s$", re.I)
#: Words that one of the introductions ends in.
_LAST = _SIGNED | _LABELS | _GREETED | set("to with by over reach laut a appeler d’appeler employee mitarbeiter mitarbeiterin employé empleado".split())
_THINGS_NEAR = re.compile(r"plug-?ins?\b|\bmodules?\b|\btemplates?\b|product names?", re.I)
#: Honorifics behind names that are written without spaces, and ends of words for groups of people.
_HONOURED = re.compile(r"(?P<n>[一-鿿々]{2,4})(?=さん|様|さま|氏|先生|女士|小姐|くん)")
_GROUPS = tuple("者客員方社")

_TOKEN = re.compile(r"[^\W\d_](?:[\w’'-]{0,60}\w)?")
_INITIAL = re.compile(r"(?<![\w.’'-])[^\W\d_]\.\s")


@dataclass(frozen=True)
class Lexicon:
    """Learned given names and surnames."""

    given: Bits = field(default_factory=Bits)
    surnames: Bits = field(default_factory=Bits)
    memo: dict[str, tuple[str | None, bool]] = field(default_factory=dict)

    def look(self, low: str) -> tuple[str | None, bool]:
        """(gender if it is a given name, whether it is a surname)."""
        hit = self.memo.get(low)
        if hit is None:
            if len(self.memo) > MOST_WORDS:
                self.memo.clear()
            hit = self.memo[low] = (GIVEN.get(low, "n" if self.given.holds(low) else None), self.surnames.holds(low))
        return hit


NONE = Lexicon()


def _cap(w: str) -> bool:
    return w[0].isupper()


def _no_name(low: str) -> bool:
    return low in NO_PERSON or low in STARTERS


def _same_case(given: str, surname: str) -> bool:
    if given.isupper():
        return surname.isupper()
    if given[0].isupper():
        return surname[0].isupper()
    return surname.islower() and len(surname) > 3


def _behind(text: str, toks: list[re.Match], i: int) -> int | None:
    """The number of the token that follows with nothing but white space between, particles passed over."""
    while i + 1 < len(toks):
        if not text[toks[i].end() : toks[i + 1].start()].isspace():
            return None
        i += 1
        if toks[i].group().lower() not in _PARTICLES:
            return i
    return None


def persons(text: str, things: set[str], lexicon: Lexicon = NONE) -> Iterator[tuple[int, int, str, str | None, str | None]]:
    """(begin, end, gender, given name, surname) of the names of a text, not overlapping; names known by evidence within it first.

    Either name is None where only the other is told; both are in lower case. ``things``: words that count or name things.
    """
    toks = list(_TOKEN.finditer(text))
    low = [m.group().lower() for m in toks]
    taken = [False] * len(toks)
    told, look = lexicon.memo.get, lexicon.look
    known = [told(w) or look(w) for w in low]

    def found(i: int, j: int, gender: str, given: str | None, surname: str | None, end: int | None = None):
        taken[i : j + 1] = [True] * (j + 1 - i)
        return toks[i].start(), end or toks[j].end(), gender, given, surname

    def free(i: int, j: int) -> bool:
        return not any(taken[i : j + 1])

    givens = [i for i, k in enumerate(known) if k[0] is not None]
    for g in givens:  # Surname, Given
        i, m = g - 1, toks[g - 1]
        if g and _cap(m.group()) and len(m.group()) > 1 and re.fullmatch(r",\s+", text[m.end() : toks[g].start()]) and not _no_name(low[i]) and low[i] not in _BEFORE_INITIAL and low[i] not in _GREETED and low[i] not in _SIGNED:
            first, end = i, toks[g].end()
            while first and low[first - 1] in _PARTICLES and text[toks[first - 1].end() : toks[first].start()].isspace():
                first -= 1
            if g + 1 < len(toks) and len(low[g + 1]) == 1 and _cap(toks[g + 1].group()) and text[toks[g].end() : toks[g + 1].start()].isspace() and text[toks[g + 1].end() : toks[g + 1].end() + 1] == ".":
                end, g = toks[g + 1].end() + 1, g + 1
            if free(first, g):
                yield found(first, g, known[i + 1][0], low[i + 1], low[i], end)
    for i in givens:  # Given Surname, Given alone
        m = toks[i]
        if taken[i] or (m.start() and text[m.start() - 1] in "@.-_’'") or text[m.end() : m.end() + 1] in ("’", "'", "-", "@") and text[m.end() : m.end() + 2] != "’s":
            continue
        w, gender, j = m.group(), known[i][0], i
        if i + 1 < len(toks) and len(low[i + 1]) == 1 and text[m.end() : toks[i + 1].start()].isspace() and text[toks[i + 1].end() : toks[i + 1].end() + 1] == ".":
            rest = re.match(r"\.\s+", text[toks[i + 1].end() :])
            j = i + 1 if rest and i + 2 < len(toks) and toks[i + 2].start() == toks[i + 1].end() + rest.end() else i
        s = _behind(text, toks, j) if j == i else j + 1
        if j > i:
            while s + 1 < len(toks) and low[s] in _PARTICLES and text[toks[s].end() : toks[s + 1].start()].isspace():
                s += 1
        if s is not None and not taken[s] and _same_case(w, toks[s].group()) and not _no_name(low[s]) and (_cap(w) or low[s] not in things):
            yield found(i, s, gender, low[i], low[s])
        elif s is not None and low[s] in NO_PERSON and _cap(w):
            continue
        elif _cap(w) and not w[1:2].isupper():
            yield found(i, i, gender, low[i], None)
    for i in [i for i, w in enumerate(low) if w in TITLES]:  # Title Surname, Title Given Surname
        if _cap(toks[i].group()) and not taken[i]:
            j = i
            while j + 1 < len(toks) and re.fullmatch(r"\.?\s+", text[toks[j].end() : toks[j + 1].start()]) and (low[j + 1] in _PARTICLES or low[j + 1] in ("dr", "prof")):
                j += 1
            if j + 1 < len(toks) and re.fullmatch(r"\.?\s+", text[toks[j].end() : toks[j + 1].start()]) and _cap(toks[j + 1].group()) and len(low[j + 1]) > 1:
                j = first = j + 1
                if (k := _behind(text, toks, j)) is not None and _cap(toks[k].group()) and len(low[k]) > 1:
                    j = k
                sentence = re.split(r"[!?\n]|\.\s", text[toks[j].end() :], maxsplit=1)[0]
                if free(i, j) and not _THINGS_NEAR.search(sentence) and low[j] not in NO_PERSON:
                    yield found(i, j, TITLES[low[i]], low[first] if first < j else None, low[j])
    if _INITIAL.search(text):
        for i, m in enumerate(toks[:-1]):  # I. Surname
            if len(m.group()) == 1 and _cap(m.group()) and (m.start() == 0 or text[m.start() - 1].isspace() or text[m.start() - 1] in "(<-") and re.fullmatch(r"\.\s", text[m.end() : toks[i + 1].start()]):
                j = i + 1
                while j + 1 < len(toks) and low[j] in _PARTICLES and text[toks[j].end() : toks[j + 1].start()].isspace():
                    j += 1
                gap = text[toks[i - 1].end() if i else 0 : m.start()]
                cue = gap.strip()[-1:] in tuple(".!?:,;(<-") if gap.strip() else i == 0 or "\n" in gap or low[i - 1] in _BEFORE_INITIAL
                if cue and _cap(toks[j].group()) and len(low[j]) > 1 and not _no_name(low[j]) and free(i, j):
                    yield found(i, j, "n", None, low[j])
    told_at = {i + 1 for i, w in enumerate(low[:-1]) if w in _LAST}
    for s, k in enumerate(known):
        if k[1]:
            first = s - 1
            while first > 0 and low[first] in _PARTICLES:
                first -= 1
            told_at.add(first)
    for i in sorted(told_at - {-1}):  # introduced, or a pair of which the second is a learned surname
        m = toks[i]
        if taken[i] or not _cap(m.group()) or _no_name(low[i]) or len(low[i]) == 1:
            continue
        gap = text[toks[i - 1].end() : m.start()] if i else ""
        introduced = i > 0 and (low[i - 1] in _SIGNED and gap.strip() in ("", ",") or low[i - 1] in _LABELS and gap.strip() == ":" or gap.isspace() and (_TOLD.search(text[: m.start()][-60:]) or _ALONE.search(text[: m.start()][-60:])))
        j = _behind(text, toks, i)
        pair = j is not None and not taken[j] and _cap(toks[j].group()) and len(low[j]) > 1 and not _no_name(low[j])
        if pair and (introduced or known[j][1]):
            more = _behind(text, toks, j)
            if more is None or not _cap(toks[more].group()) or low[more] not in NO_PERSON:
                yield found(i, j, "n", low[i], low[j])
        elif not pair and i and not (j is not None and _cap(toks[j].group())) and re.match(r"\s*(?:[,!.)\n]|$)", text[m.end() :]) and (low[i - 1] in _GREETED and gap.strip() in ("", ",") or low[i - 1] in _SIGNED and gap.strip() == ","):
            yield found(i, i, "n", low[i], None)
    for m in _HONOURED.finditer(text):
        if not m.group("n").endswith(_GROUPS):
            yield m.start("n"), m.end("n"), "n", None, m.group("n")


def learn(texts: DataFrame, things: set[str]) -> Lexicon:
    """The names that the texts introduce. ``texts`` has a column ``text``.

    One pass over all texts; each task hands on one row for each word it saw capitalised, which are summed by word.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, list[int]] = {}

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(w, *n) for w, n in seen.items()], columns=["w", "given", "surname", "n"])
            seen.clear()
            return out

        for pdf in batches:
            for text, times in Counter(pdf["text"]).items():  # equal texts of a batch are read once
                for w in _TOKEN.findall(text):
                    if w[0].isupper():
                        seen.setdefault(w.lower(), [0, 0, 0])[2] += times
                for _, _, _, given, surname in persons(text, things):
                    if given is not None and surname is not None and given != surname:
                        seen.setdefault(given, [0, 0, 0])[0] += times
                    if surname is not None:
                        seen.setdefault(surname, [0, 0, 0])[1] += times
            if len(seen) > MOST_WORDS:
                yield rows()
        yield rows()

    each = texts.mapInPandas(count, "w string, given long, surname long, n long").groupBy("w").agg(*[F.sum(c).alias(c) for c in ("given", "surname", "n")])
    told = cut(each.where(F.greatest("given", "surname") >= LEAST_INTRODUCED))

    def role(c: str) -> Bits:
        words = told.where((F.col(c) >= LEAST_INTRODUCED) & (F.col(c) >= LEAST_SHARE * F.col("n")))
        return Bits.gather(words.mapInPandas(_hashes, "h long"), size)

    size = told.count()
    return Lexicon(role("given"), role("surname"))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"h": pd.Series([word_hash(w) - (1 << 64) * (word_hash(w) >> 63) for w in pdf["w"]], dtype="int64")})

