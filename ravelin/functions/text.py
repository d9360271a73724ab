"""Text functions: Python helpers for the driver and builders of Spark columns with the same meaning."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English words too frequent to tell records apart.
STOPWORDS = frozenset(
    "a an and are as at be been but by did do does for from had has have how i if in into is it its last me my of on or our "
    "so that the their then there this time to was we were what when where which who why will with you".split()
)
#: Most positive and excluded terms of a query that count.
MAX_TERMS, MAX_EXCLUDED = 64, 32

_WORD = re.compile(r"[^\W_](?:[\w.-])*")
_TOKEN = re.compile(r"[^\W_]+")


def squeeze(text: str) -> str:
    """White space collapsed to single spaces."""
    return " ".join(text.split())


def normalize_name(text: str) -> str:
    return squeeze(text).lower()


def words_in(text: str) -> list[str]:
    """Words with inner dots, dashes and underscores, in lower case."""
    return [w for m in _WORD.finditer(text) if (w := m.group().rstrip(".-_").lower())]


def query_words(text: str) -> list[str]:
    return [w for w in words_in(text) if w not in STOPWORDS]


def tokens(text: str) -> list[str]:
    """Index tokens: runs of letters and digits, in lower case."""
    return [m.group().lower() for m in _TOKEN.finditer(text)]


def truncate(text: str, limit: int) -> str:
    """Cut to ``limit`` characters, the last of them an ellipsis."""
    text = text.strip()
    return text if len(text) <= limit else text[: max(limit - 1, 0)].rstrip() + "…"


def sentences(text: str) -> list[str]:
    """Parts that end in one of .!?; followed by white space."""
    return [p for s in re.split(r"(?<=[.!?;])(?=\s)", text) if (p := s.strip())]


def word_set(text: str) -> set[str]:
    """Query words, a plural s taken off."""
    return {w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in query_words(text)}


def jaccard(a: set[str], b: set[str]) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def dice(a: str, b: str) -> float:
    """Sørensen-Dice over the multiset of character pairs, white space disregarded."""
    a, b = "".join(a.split()), "".join(b.split())
    if a == b:
        return 1.0
    if len(a) < 2 or len(b) < 2:
        return 0.0
    left: dict[str, int] = {}
    for i in range(len(a) - 1):
        left[a[i : i + 2]] = left.get(a[i : i + 2], 0) + 1
    common = 0
    for i in range(len(b) - 1):
        if left.get(b[i : i + 2], 0):
            left[b[i : i + 2]] -= 1
            common += 1
    return 2 * common / (len(a) + len(b) - 2)


@dataclass
class Query:
    """Parsed free text: any word or phrase matches, none of the excluded ones may."""

    words: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)

    @classmethod
    def parse(cls, text: str) -> Query:
        q = cls()
        for minus, quoted, bare in re.findall(r'(-(?=\S))?(?:"([^"]*)(?:"|$)|(\S+))', text or ""):
            found = words_in(quoted) if quoted else query_words(bare)
            if not found:
                continue
            if minus:
                q.excluded.append(" ".join(found))
            elif quoted and len(found) > 1:
                q.phrases.append(" ".join(found))
            else:
                q.words += [w for w in dict.fromkeys(found) if w not in q.words]
        return q

    @property
    def empty(self) -> bool:
        return not (self.words or self.phrases)

    def positive(self) -> list[list[str]]:
        """Token sequences, at most MAX_TERMS; a word with punctuation in it is a phrase of its parts."""
        return [tokens(t) for t in [*self.words, *self.phrases][:MAX_TERMS]]

    def negative(self) -> list[list[str]]:
        return [tokens(t) for t in self.excluded[:MAX_EXCLUDED]]

    def highlight(self) -> list[str]:
        return [*self.words, *(w for p in self.phrases for w in p.split(" "))]


# columns


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def name_key(c: Column) -> Column:
    return F.lower(squeezed(c))


def token_array(c: Column) -> Column:
    """Index tokens of a text column, empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def truncated(c: Column, limit: int) -> Column:
    t = F.trim(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, max(limit - 1, 0))), F.lit("…")))


def placeholder_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(c), r"[.!]+$", "")))


def present(c: Column, empty_values: Sequence[str] = ()) -> Column:
    """The trimmed text, null where it is missing, blank or a placeholder."""
    empty = [re.sub(r"[.!]+$", "", v.strip()).strip().lower() for v in empty_values]
    key = placeholder_key(c)
    return F.when(~key.isin("", *empty), F.trim(c))


def number_of(c: Column) -> Column:
    """A number, or a text that is one once its commas are taken out; null for the rest."""
    t = F.regexp_replace(F.trim(c), ",", "")
    return F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))


def without(c: Column, name: Column) -> Column:
    """A text without a name of three letters or more; ASCII names go in any case."""
    quoted = F.concat(F.lit(r"\Q"), F.regexp_replace(name, r"\\E", r"\\E\\\\E\\Q"), F.lit(r"\E"))
    both_ascii = ~c.rlike(r"[^\x00-\x7f]") & ~name.rlike(r"[^\x00-\x7f]")
    cut = F.when(both_ascii, F.regexp_replace(c, F.concat(F.lit("(?i)"), quoted), F.lit(" "))).otherwise(F.replace(c, name, F.lit(" ")))
    return F.when(F.length(name) >= 3, cut).otherwise(c)


def bigrams(c: Column) -> Column:
    """Pairs of characters, each with its running number among equal ones, so that sets act as multisets."""
    t = F.regexp_replace(c, r"(?U)\s+", "")
    pairs = F.when(F.length(t) >= 2, F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda p, i: F.concat(p, F.lit("#"), F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda x: x == p)).cast("string")))


def dice_with(c: Column, text: str) -> Column:
    """Sørensen-Dice of a column with a text of the query."""
    t = "".join(text.split())
    seen: dict[str, int] = {}
    own = []
    for i in range(len(t) - 1):
        seen[t[i : i + 2]] = seen.get(t[i : i + 2], 0) + 1
        own.append(f"{t[i : i + 2]}#{seen[t[i : i + 2]]}")
    plain = F.regexp_replace(c, r"(?U)\s+", "")
    lit = F.array(*[F.lit(x) for x in own]) if own else F.array().cast("array<string>")
    share = 2.0 * F.size(F.array_intersect(bigrams(c), lit)) / (F.length(plain) + len(t) - 2)
    return F.when(plain == t, 1.0).when((F.length(plain) < 2) | F.lit(len(t) < 2), 0.0).otherwise(share)


def jaccard_of(a: Column, b: Column) -> Column:
    """Overlap of two arrays as sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def word_set_array(c: Column) -> Column:
    """``word_set`` as a column."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}_.-]*)"), F.lit(1))
    bare = F.filter(F.transform(found, lambda w: F.regexp_replace(w, r"[._-]+$", "")), lambda w: (w != "") & ~w.isin(*STOPWORDS))
    single = F.transform(bare, lambda w: F.when((F.octet_length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1)).otherwise(w))
    return F.array_distinct(single)
