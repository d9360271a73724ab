"""Personal information inside free text: find it, and put typed placeholders or surrogates in its place.

Method: surrogate generation. Each item found becomes a keyed replacement of its own kind: the same person, address or
number gets the same replacement in every text of a run with the same key (coreference), different ones get different
ones, and format, script, letter case and the gender of a given name are kept. Replacements come from a keyed hash
(HMAC-SHA-256). A name is replaced word by word, so that ``Anna Braun``, ``Ms Braun`` and ``BRAUN, A.`` still belong
together. Surrogates are checked for collisions over the whole corpus, in every way an item is written, and those
that collide draw again; ``redacted`` and ``surrogate_table`` use the same draws. The default replacement is a typed
placeholder such as ``[NAME_F_3K7Q2M9DA5XHZ4TB]``, which no text can hold by chance and which keeps the text readable;
it needs no shared state and no shuffle, as two of its codes (80 bits) hardly ever are equal.

Detection takes the kinds one after the other, longest evidence first, each on what the former left: email addresses,
identity numbers (known by the word before them or by their check digit), street addresses, phone numbers (by format, unless the
word before says they count something else), names (``ravelin.llm.names``, with what other texts of the corpus tell).
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelin.llm import names
from ravelin.llm.common import Bits, spread
from ravelin.llm.names import GIVEN, PARTICLES, TITLES, Lexicon

KINDS = ("email", "phone", "id_number", "address", "name")
#: Texts remembered in a task; short texts repeat a lot.
MEMO, MEMO_LENGTH = 100_000, 400
#: Draws after the first so many are longer by a digit or syllable each, so that a small space can't run out.
WIDER_AFTER = 4

#: Words before a number that say it counts or names a thing.
THINGS = set(
    "meter carton part batch case order asset tag serial invoice form build version ticket lane route queue length box pallet "
    "sku item lot firmware code error line badge machine reference ref article artikel charge auftrag rechnung seriennummer "
    "zähler commande facture pedido factura lote compteur colis caja unit model license licence port step page room row bin "
    "shelf drum tracking shipment contract policy".split()
)
#: Parts of names are bounded, so that no text can make a search run back and forth over all of it.
_CAP = r"[^\W\d_a-zß-öø-ÿ][\w’'-]{0,60}\w"

EMAIL = re.compile(
    r"(?<![\w.+-])(?P<u>\w[\w.+-]*)[@＠](?P<d>(?:[\w-]+[.．])+[^\W\d_]{2,})(?![\w@])"
    r"|(?<![\w.+-])\w[\w.+-]*\s?(?:\(at\)|\[at\]|\{at\}|<at>)\s?[\w-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[\w-]+)+"
    r"|(?<![\w.+-])\w[\w.+-]*\s{1,2}[@＠]\s{1,2}(?:[\w-]+[.．])+[^\W\d_]{2,}(?![\w@])"
    r"|(?<![\w.+-])\w[\w.+-]*\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)+",
    re.I,
)
_ID_WORD = (
    r"SSN|social security(?:\s+(?:number|no\.?|nr\.?))?|NI\s+(?:number|no\.?)|NINO|national insurance(?:\s+(?:number|no\.?))?|CPF|DNI|NIE|NIF|NIR|PESEL|BSN|"
    r"passport(?:\s+(?:number|no\.?|nr\.?))?|reisepass(?:nummer|\s*-?\s*nr\.?)?|(?:personal)?ausweis(?:nummer|\s*-?\s*nr\.?)|(?:national\s+)?(?:ID|identity)\s+card(?:\s+(?:number|no\.?))?|"
    r"tax\s+(?:id|number|no\.?)|TIN|steuer-?(?:id|nummer|identifikationsnummer)|sozialversicherungsnummer|pasaporte|passeport|num[ée]ro\s+de\s+s[ée]curit[ée]\s+sociale"
)
ID = re.compile(rf"\b(?:{_ID_WORD})(?:\s*[:#]\s*|\s+(?:is\s+|ist\s+|est\s+|es\s+|n[o°º]\.?\s*)?)(?P<v>(?=[\w .-]{{0,20}}\d[\w .-]{{0,20}}\d)[A-Z]{{0,3}}[ -]?(?:[A-Z]?\d[\dA-Z]*)(?:[ .-](?:\d[\dA-Z]*|[A-Z]\b))*)", re.I)
CPF = re.compile(r"(?<![\d.])\d{3}\.\d{3}\.\d{3}-\d{2}(?!\d)")
DNI = re.compile(r"(?<![\dA-Za-z.-])\d{8}-?[A-Z](?![\w-])")
_TOWN = r"[^\W\d_a-zß-öø-ÿ][^\W\d_]+(?:[’'-][^\W\d_]+)*"
_CITY = rf"{_TOWN}(?:[ -](?:[a-z]{{2,4}} )?{_TOWN}){{0,2}}"
_EN_WAY = r"(?:Street|St\.?|Road|Rd\.?|Lane|Ln\.?|Avenue|Ave\.?|Way|Hill|Crescent|Cres\.?|Close|Drive|Court|Ct\.?|Place|Square|Sq\.?|Terrace|Boulevard|Blvd\.?|Row|Mews|Gardens|Grove|Parkway)"
ADDRESS = re.compile(
    rf"(?:{_CAP}(?: {_CAP})? (?:Cottage|House|Lodge|Farm), )?\b\d{{1,5}}[A-Za-z]? (?:{_CAP} ){{1,3}}{_EN_WAY}(?!\w)(?:,? (?:Apt|Apartment|Flat|Unit|Suite)\.? ?\w+)?(?:, {_CITY})?(?:,? [A-Z]{{1,2}}\d[\dA-Z]? ?\d[A-Z]{{2}}\b|,? [A-Z]{{2}} \d{{5}}\b)?"
    rf"|\b[^\W\d_][\w’'-]{{0,60}}(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|ufer|damm|chaussee) \d{{1,4}} ?[a-z]?\b(?:, (?:[A-Z]-)?\d{{4,5}} {_CITY})?"
    rf"|\b{_CAP}(?:er)? (?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring) \d{{1,4}}[a-z]?\b(?:, (?:[A-Z]-)?\d{{4,5}} {_CITY})?"
    rf"|\b\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?i:rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours|route) (?:de la |de l[’']|du |des |de |d[’'])?{_CAP}(?:[ -]{_CAP}){{0,3}}(?:, \d{{5}} {_CITY})?"
    rf"|\b(?i:calle|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|rua|travessa|via|viale|ulica|ul\.) (?:de la |de los |de las |del |de |das |dos |da |do )?{_CAP}(?: (?:de |del )?{_CAP}){{0,3}},? \d{{1,4}}(?:, \d+\.?[ºª°] ?\w+)?(?:, (?:\d{{4,5}}(?:-\d{{3}})? )?{_CITY})?"
)
_EXT = r"(?:\s?(?:ext\.?|x|Durchwahl|poste)\s?\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w.+/-])(?:"
    r"(?:\+|00)[1-9]\d{0,2}(?:[ .\-/]?\(0\))?(?:[ .\-/]?\(?\d{1,5}\)?){1,6}"
    r"|\(\d{2,5}\) ?\d{3,4}(?:[ .-]\d{2,4}){0,3}"
    r"|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}(?= ?(?:ext|x\d))"
    r"|0\d{9,11}|0[1-9](?:[ .]\d{2}){4}|0\d{2,4}[ /]\d{3,8}(?: \d{2,5}){0,2}"
    r")" + _EXT + r"(?![\w@]|[.-]\d)"
)
_PHONE_WORD = re.compile(r"(?:phone|tel|téléphone|teléfono|telefon|call|fax|mobile|handy|appeler|llame|rückruf|callback)[^.!?\n]{0,40}$", re.I)
#: Signs without which a text can hold nothing of a kind; looked for in lower case before the patterns are.
_ID_SIGNS = "ssn|security|ni n|nino|insurance|cpf|dni|nie|nif|nir|pesel|bsn|pass|ausweis|card|tax|tin|steuer|sozial|curit|pasaporte".split("|")
_WAYS = set(
    "street st road rd lane ln avenue ave way hill crescent cres close drive court ct place square sq terrace boulevard blvd row mews gardens grove parkway "
    "strasse straße str weg allee platz gasse ring rue chemin allée impasse quai cours route calle avda avenida plaza paseo camino carrera ronda rua travessa via viale ulica ul".split()
)
_WAY_ENDS = ("straße", "strasse", "str", "weg", "allee", "platz", "gasse", "ring", "ufer", "damm", "chaussee")
_LETTERS_ONLY = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_AT = re.compile(r"\bat\b|[\[({<]at[\])}>]")


@dataclass(frozen=True)
class Item:
    start: int
    end: int
    kind: str
    gender: str = ""


def _cpf_ok(text: str) -> bool:
    d = [int(c) for c in text if c.isdigit()]
    for n in (9, 10):
        r = sum(x * w for x, w in zip(d[:n], range(n + 1, 1, -1), strict=True)) * 10 % 11 % 10
        if r != d[n]:
            return False
    return True


def _dni_ok(text: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(text[:8]) % 23] == text[-1]


def _counts_things(before: str) -> bool:
    """Whether the word before a number says that it isn't a phone number."""
    words = re.findall(r"[^\W\d_]+|[:#]", before[-60:])
    while words and words[-1].lower() in ("no", "nr", "number", "num", "nummer", "is", "was", ":", "#", "the", "numéro", "número"):
        words.pop()
    return bool(words) and words[-1].lower() in THINGS


def detect(text: str, lexicon: Lexicon = names.NONE) -> list[Item]:
    """The items of a text in their order, not overlapping. Empty for null and blank texts."""
    found: list[Item] = []
    if not text or not text.strip():
        return found
    left, low = text, text.lower()

    def take(start: int, end: int, kind: str, gender: str = "") -> None:
        nonlocal left
        found.append(Item(start, end, kind, gender))
        left = left[:start] + "\0" * (end - start) + left[end:]

    if "@" in text or "＠" in text or ("at" in low and _AT.search(low)):
        for m in EMAIL.finditer(left):
            take(m.start(), m.end(), "email")
    digits = len(_DIGIT.findall(text))
    if digits:
        if digits > 1 and any(x in low for x in _ID_SIGNS):
            for m in ID.finditer(left):
                take(m.start("v"), m.end("v"), "id_number")
        if digits >= 8:
            for pattern, ok in ((CPF, _cpf_ok), (DNI, _dni_ok)):
                for m in pattern.finditer(left):
                    if ok(m.group()):
                        take(m.start(), m.end(), "id_number")
        words = _LETTERS_ONLY.findall(low)
        if not _WAYS.isdisjoint(words) or any(w.endswith(_WAY_ENDS) for w in words):
            for m in ADDRESS.finditer(left):
                take(m.start(), m.end(), "address")
        if digits >= 8:
            for m in PHONE.finditer(left):
                n = sum(c.isdigit() for c in m.group())
                if 8 <= n <= 20 and (not _counts_things(left[: m.start()]) or _PHONE_WORD.search(left[: m.start()])):
                    take(m.start(), m.end(), "phone")
    found += [Item(start, end, "name", gender) for start, end, gender, _, _ in names.persons(left, THINGS, lexicon)]
    return sorted(found, key=lambda x: x.start)


# replacements


def canonical(kind: str, text: str) -> str:
    """What stays the same when an item is written another way."""
    t = unicodedata.normalize("NFKC", text).casefold()
    if kind == "email":
        t = re.sub(r"\s*(?:\(at\)|\[at\]|\{at\}|<at>)\s*|\s+at\s+", "@", t)
        return re.sub(r"\s*(?:\(dot\)|\[dot\])\s*|\s+dot\s+", ".", t)
    if kind == "phone":
        return re.sub(r"\D", "", re.sub(r"\(0\)|(?:ext\.?|x)\s?\d+$", "", t)).lstrip("0")
    if kind == "id_number":
        return re.sub(r"\W", "", t)
    if kind == "name":
        if "," in t:
            last, _, first = t.partition(",")
            t = f"{first.strip()} {last.strip()}"
        return " ".join(w for w in _NAME_WORD.findall(t) if w not in TITLES and (len(w) > 1 or _no_case(w)))
    return re.sub(r"\W+", " ", t).strip()


def draw(key: bytes, kind: str, what: str, turn: int = 0) -> bytes:
    return hmac.new(key, f"{kind}\0{what}\0{turn}".encode(), hashlib.sha256).digest()


def placeholder(key: bytes, item: Item, text: str) -> str:
    """``[KIND_CODE]``, for names ``[NAME_GENDER_CODE]``."""
    code = base64.b32encode(draw(key, item.kind, canonical(item.kind, text)))[:16].decode()
    label = {"id_number": "ID", "address": "ADDRESS"}.get(item.kind, item.kind.upper())
    return f"[{label}_{item.gender.upper() or 'N'}_{code}]" if item.kind == "name" else f"[{label}_{code}]"


_FIRST = {g: [n for n, x in GIVEN.items() if x in (g, "n") and n.isascii()] for g in "mf"} | {"n": [n for n in GIVEN if n.isascii()]}
_NAME_WORD = re.compile(r"[^\W\d_](?:[\w’'-]*\w)?")


def parts(item: Item, text: str, lexicon: Lexicon = names.NONE) -> list[tuple[int, int, str, str]]:
    """(begin, end, entity, gender) of what is replaced on its own: the words of a name, all of anything else.

    Titles, particles and initials tell no person; an initial is replaced with the word behind it. Only given names have a gender.
    """
    own = text[item.start : item.end]
    if item.kind != "name":
        return [(item.start, item.end, canonical(item.kind, own), "")]
    out = []
    for m in _NAME_WORD.finditer(own):
        low = unicodedata.normalize("NFKC", m.group()).casefold()
        if low not in TITLES and not (low in _PARTICLE_WORDS and m.group().islower()) and (len(low) > 1 or _no_case(low)):
            out.append((item.start + m.start(), item.start + m.end(), low, lexicon.look(low)[0] or ""))
    return out


def _no_case(c: str) -> bool:
    return c.upper() == c.lower()


_PARTICLE_WORDS = set(PARTICLES.split("|"))


def _like(sample: str, word: str) -> str:
    return word.upper() if sample.isupper() and len(sample) > 1 else word.capitalize() if sample[:1].isupper() else word


#: Consonants and vowels of made-up words.
_LETTERS = {"LATIN": ("bdfgklmnprstvz", "aeiou"), "CYRILLIC": ("бвгдзклмнпрстф", "аеиоу"), "GREEK": ("βγδζθκλμνπρστφ", "αεηιο")}


@lru_cache(maxsize=4_096)
def _pool(c: str) -> tuple[str, str | None]:
    """(consonants, vowels) of a letter's script, or (its letters, None) where letters are no consonants and vowels."""
    script = unicodedata.name(c, "LATIN").split()[0]
    if script in _LETTERS:
        return _LETTERS[script]
    row = map(chr, range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1))
    letters = "".join(x for x in row if unicodedata.category(x) in ("Lo", "Ll") and unicodedata.name(x, "").startswith(script + " "))
    return (letters, None) if letters else _LETTERS["LATIN"]


def _syllables(bits: int, n: int, like: str = "a") -> str:
    """A made-up word of n syllables in the script of another."""
    first, second = _pool(next((c for c in like if c.isalpha()), "a"))
    if second is None:
        return "".join(first[(bits >> (7 * i)) % len(first)] for i in range(n))
    return "".join(first[(bits >> (7 * i) & 127) % len(first)] + second[(bits >> (7 * i + 4)) % len(second)] for i in range(n))


def surrogate(key: bytes, item: Item, text: str, turn: int = 0) -> str:
    """A made-up item of the same kind, format, script, letter case and gender."""
    bits = int.from_bytes(draw(key, item.kind, canonical(item.kind, text), turn), "big")
    wider = max(0, turn - WIDER_AFTER + 1)
    if item.kind == "email":
        return _like(text, f"{_syllables(bits, 5)}{bits % 9973}@example.org")
    if item.kind in ("phone", "id_number"):  # separators and letters' places stay; the first digits of a phone number show its country
        keep = 3 if item.kind == "phone" else 0
        same = [m.span() for m in re.finditer(r"^\D*0+|\(0\)", text)] if keep else []  # ways of writing the same number
        out = []
        for i, c in enumerate(text):
            if any(a <= i < b for a, b in same):
                pass
            elif c.isdigit() and keep > 0:
                keep -= 1
            elif c.isdigit():
                bits, d = divmod(bits, 10)
                c = str(d)
            elif item.kind == "id_number" and c.isalpha() and c.isupper():
                bits, d = divmod(bits, 26)
                c = chr(65 + d)
            out.append(c)
        return "".join(out) + (str(bits % 10**wider).rjust(wider, "0") if wider else "")
    if item.kind == "address":
        out = []
        for c in re.findall(r"\d+|[^\W\d_]+|\W+|_", text):
            if c.isdigit():
                bits, d = divmod(bits, 10 ** (len(c) + wider))
                c = str(d).rjust(len(c), "1")
            elif len(c) > 3 and c[0].isupper() and not re.fullmatch(_EN_WAY + r"|Cottage|Calle|Plaza|Avenida|Rue", c):
                bits, d = divmod(bits, 1 << 21)
                tail = re.search(r"(?:straße|strasse|str|weg|allee|platz|gasse)$", c)
                c = _like(c, _syllables(d, 3, c)) + (tail.group() if tail else "")
            out.append(c)
        return "".join(out)
    if item.gender and not turn and "LATIN" in unicodedata.name(text[0], ""):  # the list is short: who collides gets a made-up name
        first = _FIRST[item.gender]
        return _like(text, first[bits % len(first)])
    return _like(text, _syllables(bits, 4 + wider, text) + ({"f": "na", "m": "rd"}.get(item.gender, "") if text[0].isascii() else ""))


class Redactor:
    def __init__(self, key: bytes, how: str = "placeholder", lexicon: Lexicon | None = None):
        self.key, self.how, self.lexicon = key, how, lexicon or names.NONE
        self.memo: dict[str, list[Item]] = {}

    def items(self, text: str) -> list[Item]:
        hit = self.memo.get(text)
        if hit is None:
            hit = detect(text, self.lexicon)
            if len(text) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = hit
        return hit

    def parts(self, text: str) -> list[tuple[str, int, int, str, str]]:
        """(kind, begin, end, entity, gender) of what surrogates replace."""
        return [(x.kind, *p) for x in self.items(text) for p in parts(x, text, self.lexicon)]

    def replacements(self, text: str, drawn: dict[tuple[str, str], int] | None = None) -> list[tuple[str, int, int, str]]:
        """(kind, begin, end, replacement) of the items. ``drawn``: the turns of the text's entities, 0 for all others."""
        if self.how == "placeholder":
            return [(x.kind, x.start, x.end, placeholder(self.key, x, text[x.start : x.end])) for x in self.items(text)]
        drawn = drawn or {}
        out = [(k, a, b, surrogate(self.key, Item(0, b - a, k, g), text[a:b], drawn.get((k, e), 0))) for k, a, b, e, g in self.parts(text)]
        for x in self.items(text):
            if x.kind == "name":  # initials take the letter of the word behind them, so that they go on fitting it
                for m in re.finditer(r"(?<!\w)[^\W\d_](?=\.)", text[x.start : x.end]):
                    at = x.start + m.start()
                    near = next((r for _, a, _, r in out if a > at), None) or next((r for _, a, b, r in reversed(out) if x.start <= a < at), "X")
                    out.append(("name", at, at + 1, near[0].upper()))
        return sorted(out, key=lambda x: x[1])

    def redact(self, text: str, drawn: dict[tuple[str, str], int] | None = None) -> str:
        if not self.items(text):
            return text
        out, at = [], 0
        for _, start, end, new in self.replacements(text, drawn):
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]])


def texts_of(tickets: DataFrame, key: str = "seq") -> DataFrame:
    """(key, field, pos, text) of every non-blank text: body and resolution at 0, comments at their 1-based place."""
    base = spread(tickets.select(key, "body", F.col("comments.text").alias("_c"), "resolution"), key)
    one = lambda f: F.array(F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), F.col(f).alias("text")))
    many = F.transform(F.coalesce("_c", F.array().cast("array<string>")), lambda t, i: F.struct(F.lit("comments").alias("field"), (i + 1).alias("pos"), t.alias("text")))
    cells = F.filter(F.concat(one("body"), many, one("resolution")), lambda x: x["text"].rlike(r"\S"))
    return base.select(key, F.inline(cells))


def lexicon_of(tickets: DataFrame, key: str = "seq") -> tuple:
    """The learned names of the texts, as a broadcast of their filters' bits."""
    learned = names.learn(texts_of(tickets, key).select("text"), THINGS)
    return tickets.sparkSession.sparkContext.broadcast((learned.given.table, learned.surnames.table))


def _lexicon(shared) -> Lexicon:
    return Lexicon(*map(Bits, shared.value))


def found(tickets: DataFrame, key: str = "seq") -> DataFrame:
    """(seq, field, pos, kind): a row for each kind of item that is replaced in a text. One pass to learn names, one to replace; no shuffle of texts."""
    return redacted(tickets, "", key).select(key, "field", "pos", F.explode("kinds").alias("kind"))


def redacted(tickets: DataFrame, secret: str, key: str = "seq", how: str = "placeholder") -> DataFrame:
    """(seq, field, pos, redacted, kinds): every non-blank text with its items replaced, unchanged where it has none; which kinds they are.

    Surrogates are those of ``surrogate_table``: a text is joined, by its hash, with the turns of its entities; only
    entities that didn't keep their first draw take part.
    """
    if how not in ("placeholder", "surrogate"):
        raise ValueError("how is placeholder or surrogate")
    kind = tickets.schema[key].dataType.simpleString()
    texts, shared = texts_of(tickets, key).withColumnRenamed(key, "k"), lexicon_of(tickets, key)
    if how == "placeholder":
        texts = texts.withColumn("turns", F.lit(None).cast("array<struct<kind:string,entity:string,turn:int>>"))
    else:
        again = _drawn(tickets, secret, key, shared=shared).where("turn > 0").select("kind", "entity", "turn").distinct()
        texts = texts.withColumn("_h", F.sha2("text", 256))
        held = texts.select("_h", "text").dropDuplicates(["_h"]).mapInPandas(_entities_of(shared), "h string, kind string, entity string")
        turns = held.join(again, ["kind", "entity"]).groupBy("h").agg(F.collect_list(F.struct("kind", "entity", "turn")).alias("turns"))
        texts = texts.join(turns, texts["_h"] == turns["h"], "left").select("k", "field", "pos", "text", "turns")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Redactor(secret.encode(), how, _lexicon(shared))
        for pdf in batches:
            new, kinds = [], []
            for t, x in zip(pdf["text"], pdf["turns"], strict=True):
                drawn = None if x is None else {(y["kind"], y["entity"]): y["turn"] for y in x}
                new.append(r.redact(t, drawn))
                kinds.append(sorted({i.kind for i in r.items(t)}))
            yield pd.DataFrame({"k": pdf["k"], "field": pdf["field"], "pos": pdf["pos"], "redacted": new, "kinds": kinds})

    return texts.mapInPandas(run, f"k {kind}, field string, pos int, redacted string, kinds array<string>").withColumnRenamed("k", key)


def _entities_of(shared) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Redactor(b"", lexicon=_lexicon(shared))
        for pdf in batches:
            rows = [(h, *e) for h, t in zip(pdf["_h"], pdf["text"], strict=True) for e in sorted({(k, e) for k, _, _, e, _ in r.parts(t)})]
            yield pd.DataFrame(rows, columns=["h", "kind", "entity"])

    return run


def surrogate_table(tickets: DataFrame, secret: str, key: str = "seq", turns: int = 16) -> DataFrame:
    """(kind, entity, surrogate, turn): one row for each entity of the corpus (of names: for each word), surrogates distinct within a kind.

    The surrogate is that of the first way of writing the entity; others differ in format only.
    """
    first = F.min(F.struct("sample", "gender", "surrogate", "turn")).alias("x")
    return _drawn(tickets, secret, key, turns).groupBy("kind", "entity").agg(first).select("kind", "entity", "x.surrogate", "x.turn")


def _drawn(tickets: DataFrame, secret: str, key: str, turns: int = 16, shared=None) -> DataFrame:
    """(kind, entity, sample, gender, surrogate, same, turn): one row for each way of writing each entity.

    Ways of writing are deduplicated before any drawing. Entities of which any surrogate is the same, however it is
    written, as one of another entity draw again, all but the first of them, until none collides.
    """

    shared = shared or lexicon_of(tickets, key)

    def entities(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = Redactor(b"", lexicon=_lexicon(shared))
        for pdf in batches:
            rows = {(k, e, t[a:b], g) for t in pdf["text"] for k, a, b, e, g in r.parts(t)}
            yield pd.DataFrame(sorted(rows), columns=["kind", "entity", "sample", "gender"])

    def drawn(turn: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [surrogate(secret.encode(), Item(0, len(s), k, g), s, turn) for k, s, g in zip(pdf["kind"], pdf["sample"], pdf["gender"], strict=True)]
                yield pdf.assign(surrogate=out, same=[canonical(k, s) for k, s in zip(pdf["kind"], out, strict=True)], turn=turn)

        return run

    schema = "kind string, entity string, sample string, gender string"
    from ravelin.session import cut

    todo, done = cut(texts_of(tickets, key).select("text").mapInPandas(entities, schema).distinct()), None
    for turn in range(turns):
        now = todo.mapInPandas(drawn(turn), schema + ", surrogate string, same string, turn int")
        both = now if done is None else done.unionByName(now)
        first = both.groupBy("kind", "same").agg(F.min(F.struct("turn", "entity")).alias("_f"))
        marked = both.join(first, ["kind", "same"]).withColumn("_bad", F.col("_f.entity") != F.col("entity"))
        bad = marked.groupBy("kind", "entity").agg(F.max("_bad").alias("_again"))
        marked = cut(both.join(bad, ["kind", "entity"]))
        done, todo = marked.where("NOT _again").drop("_again"), marked.where("_again").select("kind", "entity", "sample", "gender")
        if todo.isEmpty():
            return done
    raise RuntimeError("surrogates still collide")
