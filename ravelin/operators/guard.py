"""Checks on what is written to the memory: one bounded claim, well-formed names, no credentials."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.functions.dates import format_unix, normalize_date


class Refused(ValueError):
    """A write that isn't taken."""


KINDS = ("fact", "preference", "decision", "lesson", "event", "task", "note")

#: Patterns of credentials, by what they are.
SECRETS = {
    "private key": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY",
    "AWS access key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "GitHub token": r"\b(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})",
    "API key": r"\bsk-(?:ant-|proj-|live-)?[A-Za-z0-9_-]{20,}",
    "Slack token": r"\bxox[abposr]-[A-Za-z0-9-]{10,}",
    "Google API key": r"\bAIza[0-9A-Za-z_-]{35}",
    "Stripe key": r"\b[rsp]k_(?:live|test)_[0-9A-Za-z]{16,}",
    "npm token": r"\bnpm_[A-Za-z0-9]{36}\b",
    "crates.io token": r"\bcio[A-Za-z0-9]{32}\b",
    "JWT": r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "credentials in a URL": r"(?i)\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]{3,}@",
    "password or key assignment": r"""(?i)\b(?:password|passwd|pwd|passphrase|secret|api[_-]?key|access[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|private[_-]?key|bearer)\b["']?\s*(?:[:=]|\bis\b)\s*["']?[^\s"']{6,}""",
}
#: Forms that are accepted, or taken for random.
RANDOM_TOKEN, RANDOM_BITS = r"[A-Za-z0-9+/_=-]{32,}", 4.2
#: Forms that are accepted, or taken for random.
NAMESPACE = re.compile(r"[a-z0-9][a-z0-9:_./@-]{0,63}")
KEY = re.compile(r"[^\W_][\w.:/@-]{0,79}")
TAG = re.compile(r"[^\W_][\w.:/-]{0,39}")
MAX_SUBJECT, MAX_SOURCE, MAX_ALIAS, MAX_REF, MAX_TAGS, MAX_REFS = 120, 120, 120, 200, 12, 20


def entropy(token: str) -> float:
    """Bits for each character."""
    return -sum((n := token.count(c) / len(token)) * math.log2(n) for c in set(token)) if token else 0.0


def secret_kind(text: str) -> str | None:
    for name, pattern in SECRETS.items():
        if re.search(pattern, text):
            return name
    for m in re.finditer(RANDOM_TOKEN, text):
        t = m.group()
        if re.search("[a-z]", t) and re.search("[A-Z]", t) and re.search("[0-9]", t) and entropy(t) > RANDOM_BITS:
            return "high-entropy token"
    return None


def entropy_column(token: Column) -> Column:
    letters = F.filter(F.split(token, ""), lambda c: c != "")
    n = F.size(letters)
    share = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def secret_column(text: Column) -> Column:
    """``secret_kind`` as a column."""
    out = F.lit(None).cast("string")
    tokens = F.regexp_extract_all(text, F.lit(f"({RANDOM_TOKEN})"), F.lit(1))
    out = F.when(F.exists(tokens, lambda t: t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]") & (entropy_column(t) > RANDOM_BITS)), "high-entropy token").otherwise(out)
    for name, pattern in reversed(SECRETS.items()):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


@dataclass
class Remember:
    text: str
    ns: str | None = None
    kind: str | None = None
    subject: str | None = None
    key: str | None = None
    tags: list[str] = field(default_factory=list)
    importance: int | None = None
    confidence: float | None = None
    source: str | None = None
    refs: list[str] = field(default_factory=list)
    pinned: bool = False
    expires: str | None = None
    aliases: list[str] = field(default_factory=list)


def parse_kind(raw: str | None) -> str | None:
    if raw is None:
        return None
    k = raw.strip().lower()
    found = next((x for x in KINDS if k in (x, x + "s")), None)
    if found is None:
        raise Refused(f"unknown kind {raw!r}; one of {', '.join(KINDS)}")
    return found


def namespace(raw: str) -> str:
    ns = raw.strip().lower()
    if not NAMESPACE.fullmatch(ns):
        raise Refused(f"namespace {raw!r}: 1 to 64 of a-z 0-9 : _ . / @ -")
    return ns


def slot_key(raw: str) -> str:
    k = "_".join(raw.split()).lower()
    if not KEY.fullmatch(k):
        raise Refused(f"key {raw!r}: a short name such as editor or deploy.target")
    return k


def expiry(raw: str, now: int) -> str:
    """A date (its end), a time, or hours, days or weeks from now."""
    if m := re.fullmatch(r"(\d+)\s*([hdw])", raw):
        return format_unix(now + min(int(m[1]), 100_000) * {"h": 3600, "d": 86_400, "w": 604_800}[m[2]])
    d = normalize_date(raw)
    if d is None:
        raise Refused(f"expires {raw!r}: a date, or a time such as 12h, 30d, 6w")
    return f"{d}T23:59:59Z" if len(d) == 10 else f"{d}Z"


def _short(name: str, value: str | None, limit: int) -> str | None:
    text = tx.squeeze(value or "")
    if len(text) > limit:
        raise Refused(f"the {name} is over {limit} characters")
    no_secret(name, text)
    return text or None


def no_secret(name: str, value: str) -> None:
    if kind := secret_kind(value):
        raise Refused(f"the {name} looks like a credential ({kind}); remember where it is kept instead")


def _list(name: str, values: list[str], limit: int, most: int) -> list[str]:
    out = list(dict.fromkeys(v for x in values if (v := _short(name, x, limit))))
    if len(out) > most:
        raise Refused(f"at most {most} {name}s")
    return out


def check(req: Remember, default_ns: str, max_chars: int, now: int) -> Remember:
    """The request in normal form, or a refusal."""
    text = _short("text", req.text, max_chars)
    if text is None:
        raise Refused("the text is empty")
    subject = _short("subject", req.subject, MAX_SUBJECT)
    key = slot_key(req.key) if req.key and req.key.strip() else None
    if key:
        no_secret("key", key)
    tags = _list("tag", ["-".join(t.split()).lower() for t in req.tags], 1000, MAX_TAGS)
    if bad := next((t for t in tags if not TAG.fullmatch(t)), None):
        raise Refused(f"tag {bad!r}: short words such as infra")
    importance = 3 if req.importance is None else req.importance
    confidence = 1.0 if req.confidence is None else req.confidence
    if not 1 <= importance <= 5:
        raise Refused("importance is 1 to 5")
    if not (math.isfinite(confidence) and 0 <= confidence <= 1):
        raise Refused("confidence is 0 to 1")
    aliases = _list("alias", req.aliases, MAX_ALIAS, 1000)
    if aliases and not subject:
        raise Refused("aliases need a subject")
    return Remember(
        text, namespace(req.ns or default_ns), parse_kind(req.kind) or ("fact" if key else "note"), subject, key, tags, importance, confidence,
        _short("source", req.source, MAX_SOURCE), _list("ref", req.refs, MAX_REF, MAX_REFS), bool(req.pinned),
        expiry(req.expires.strip(), now) if req.expires and req.expires.strip() else None, aliases,
    )
