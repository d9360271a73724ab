"""Field paths into JSON records, and the mapping that turns a record into a row of the index.

Two forms with the same meaning: Python over parsed JSON, run once for each record at ingest in the task that reads
it, and Column expressions over the raw JSON for fields that a query asks for later.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.config import Config, Fields, Rank
from ravelin.functions import text as tx
from ravelin.functions.dates import normalize_date

KIND_FILTER = "_kind"
VALUE_CHARS = 200


class FieldPath:
    """``a.b[].c``: arrays anywhere are flattened, so ``[]`` may be left out; a key that itself has dots wins."""

    def __init__(self, raw: str):
        self.raw = raw.strip()
        self.parts = [p for s in raw.split(".") if (p := s.strip().removesuffix("[]"))]

    def values(self, record: Any) -> list[Any]:
        out: list[Any] = []
        todo = [(record, 0)]
        while todo:
            value, i = todo.pop()
            if isinstance(value, list):
                todo.extend((x, i) for x in reversed(value))
            elif i == len(self.parts):
                out.append(value)
            elif isinstance(value, dict):
                whole = ".".join(self.parts[i:])
                if len(self.parts) - i > 1 and whole in value:
                    todo.append((value[whole], len(self.parts)))
                elif self.parts[i] in value:
                    todo.append((value[self.parts[i]], i + 1))
        return out


def number_text(v: Any) -> str:
    return json.dumps(v)


def texts(value: Any) -> list[str]:
    """Scalars as text; inside of objects only strings count."""
    out: list[str] = []
    todo = [(value, True)]
    while todo:
        v, top = todo.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, (bool, int, float)) and top:
            out.append(number_text(v))
        elif isinstance(v, list):
            todo.extend((x, top) for x in reversed(v))
        elif isinstance(v, dict):
            todo.extend((x, False) for x in reversed(list(v.values())))
    return out


def placeholder_key(s: str) -> str:
    return s.strip().rstrip(".!").strip().lower()


def without_names(text: str, names: Sequence[str]) -> str:
    """The record's own group key and name say nothing in its title and body."""
    import re

    for n in names:
        if len(n) < 3:
            continue
        if text.isascii() and n.isascii():
            text = re.sub(re.escape(n), " ", text, flags=re.IGNORECASE)
        else:
            text = text.replace(n, " ")
    return text


@dataclass
class Prepared:
    id: str | None
    title: str | None
    body: str
    names: str
    grp: str | None
    grp_name: str | None
    date: str | None
    boost: float
    facets: list[tuple[str, str]]


class Mapping:
    """A mapping with its paths parsed once."""

    def __init__(self, fields: Fields, rank: Rank, kind: str | None = None):
        self.fields, self.kind = fields, kind
        many = lambda ps: [FieldPath(p) for p in ps]
        self.id, self.group, self.group_name = ([FieldPath(p)] if p else [] for p in (fields.id, fields.group, fields.group_name))
        self.title, self.text, self.date, self.filters, self.display = (many(p) for p in (fields.title, fields.text, fields.date, fields.filters, fields.display))
        self.empty = {placeholder_key(v) for v in fields.empty_values} | {""}
        self.boosts = [(many(b.field), b.equals.strip().lower() if b.equals is not None else None, b.weight) for b in rank.boost]

    def strings(self, path: FieldPath, record: Any) -> list[str]:
        return [s for v in path.values(record) for s in texts(v) if placeholder_key(s) not in self.empty]

    def first(self, paths: Sequence[FieldPath], record: Any) -> str | None:
        return next((s.strip() for p in paths for s in self.strings(p, record)), None)

    def date_of(self, record: Any) -> str | None:
        raw = self.first(self.date, record)
        return raw and (normalize_date(raw) or raw)

    def group_of(self, record: Any) -> tuple[str | None, str | None]:
        group = self.first(self.group, record)
        return group, self.first(self.group_name, record) if group else None

    def id_of(self, record: Any) -> str | None:
        return self.first(self.id, record)

    def body_texts(self, record: Any) -> list[str]:
        if not self.text:
            return [s for s in texts(record) if placeholder_key(s) not in self.empty]
        return [s for p in self.text for s in self.strings(p, record)]

    def prepare(self, record: Any) -> Prepared:
        grp, grp_name = self.group_of(record)
        own = [n for n in (grp, grp_name) if n]
        title = self.first(self.title, record)
        facets: dict[tuple[str, str], str] = {}
        if self.kind:
            facets[(KIND_FILTER, self.kind.lower())] = self.kind
        for p in self.filters:
            for v in self.strings(p, record):
                v = v.strip()[:VALUE_CHARS]
                facets.setdefault((p.raw, v.lower()), v)
        boost = 1.0
        for paths, equals, weight in self.boosts:
            found = [s for p in paths for s in self.strings(p, record)]
            if any(s.strip().lower() == equals for s in found) if equals is not None else found:
                boost += weight
        key = self.id_of(record)
        return Prepared(
            f"{self.kind}:{key}" if self.kind and key else key,
            None if title is None else without_names(title, own),
            "\n".join(without_names(s, own) for s in self.body_texts(record)),
            "\n".join(own), grp, grp_name, self.date_of(record), boost,
            [(f, v) for (f, _), v in facets.items()],
        )


_FACET = T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])
ROW = T.StructType([
    T.StructField("src", T.StringType()), T.StructField("src_no", T.IntegerType()), T.StructField("line", T.LongType()),
    T.StructField("kind", T.StringType()), T.StructField("id", T.StringType()), T.StructField("grp", T.StringType()), T.StructField("grp_name", T.StringType()),
    T.StructField("date", T.StringType()), T.StructField("boost", T.DoubleType()), T.StructField("facets", T.ArrayType(_FACET)),
    T.StructField("title", T.StringType()), T.StructField("body", T.StringType()), T.StructField("names", T.StringType()),
    T.StructField("doc", T.StringType()), T.StructField("error", T.StringType()),
])


def prepare_rows(lines: DataFrame, config: Config) -> DataFrame:
    """Rows of the index from (src, src_no, line, kind, doc, error); what can't be used keeps only its ``error``.

    A record without an id field in its mapping gets ``<src>:<line>``; one whose id is missing is an error.
    """
    shared = lines.sparkSession.sparkContext.broadcast(config)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cfg = shared.value
        by_kind = {k: Mapping(f, cfg.rank, k) for k, f in cfg.mappings()}
        for pdf in batches:
            out = []
            for src, no, line, kind, doc, error in pdf[["src", "src_no", "line", "kind", "doc", "error"]].itertuples(index=False):
                head = (src, no, line)
                if error is not None:
                    out.append((*head, kind, *[None] * 10, error))
                    continue
                m = by_kind[kind]
                r = m.prepare(json.loads(doc))
                key = r.id if m.id else ":".join(x for x in (kind, src, str(line)) if x)
                if key is None:
                    out.append((*head, kind, *[None] * 10, f"no id at {m.fields.id}"))
                else:
                    out.append((*head, kind, key, r.grp, r.grp_name, r.date, r.boost, [{"field": f, "value": v} for f, v in r.facets], r.title, r.body, r.names, doc, None))
            yield pd.DataFrame(out, columns=ROW.names)

    return lines.mapInPandas(run, ROW)


# columns over raw JSON


def _as_array(v: Column) -> Column:
    """JSON text of a value -> its elements as JSON text or bare scalars; null gives none."""
    none = F.array().cast("array<string>")
    return F.when(v.isNull(), none).when(v.startswith("["), F.coalesce(F.from_json(v, "array<string>"), F.array(v))).otherwise(F.array(v))


def _step(values: Column, key: str) -> Column:
    quoted = key.replace("\\", "\\\\").replace("'", "\\'")
    return F.flatten(F.transform(values, lambda x: _as_array(F.get_json_object(x, f"$['{quoted}']"))))


def path_values(doc: Column, path: str) -> Column:
    """Values at a path of raw JSON: scalars as bare text, objects as JSON text. All JVM-side.

    A text that itself begins with a bracket counts as an array; nulls are left out.
    """
    parts = FieldPath(path).parts
    if not parts:
        return F.array(doc)
    plain = F.array(doc)
    for key in parts:
        plain = F.flatten(F.transform(_step(plain, key), _as_array))
    if len(parts) > 1:
        literal = F.flatten(F.transform(_step(F.array(doc), ".".join(parts)), _as_array))
        plain = F.when(F.size(literal) > 0, literal).otherwise(plain)
    return F.filter(plain, lambda x: x.isNotNull())


def numbers_at(doc: Column, path: str) -> Column:
    """The numbers at a path, as an array."""
    return F.filter(F.transform(path_values(doc, path), tx.number_of), lambda x: x.isNotNull())


def scalars_at(doc: Column, path: str) -> Column:
    """The scalars at a path as text of at most VALUE_CHARS, blanks and objects left out."""
    cut = F.transform(path_values(doc, path), lambda x: F.substring(F.trim(x), 1, VALUE_CHARS))
    return F.filter(cut, lambda x: (x != "") & ~x.startswith("{"))
