"""Readers of messy exports: JSON Lines, JSON documents, delimited text, SQLite tables, any of them gzipped.

``discover`` lists the sources on the driver; ``read`` gives one DataFrame of (src, src_no, line, doc, error), a row for
each record or unreadable line. JSON Lines files are split like any text; documents and delimited files, whose
records need the whole file, are parsed one file to a task.
"""

from __future__ import annotations

import codecs
import csv
import gzip
import io
import json
import os
import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.operators import files
from ravelin.session import small_side

EXTENSIONS = {".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".csv": "csv", ".tsv": "tsv", ".tab": "tsv", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite"}
MAGIC = b"SQLite format 3\0"
SCHEMA = "src string, src_no int, line bigint, doc string, error string"
#: Bytes looked at to tell a format.
HEAD = 65_536
#: Splits of all files whose first line numbers are broadcast; more of them are joined by a shuffle.
MAX_SPLITS = 200_000


class NoSource(ValueError):
    pass


@dataclass(frozen=True)
class Source:
    path: str
    format: str
    table: str | None = None
    sql: str | None = None
    kind: str | None = None

    @property
    def label(self) -> str:
        name = os.path.basename(self.path)
        return f"{name}#{self.table}" if self.table else name

    @property
    def gz(self) -> bool:
        return self.path.lower().endswith(".gz")


def format_of(path: str) -> str | None:
    low = path.lower().removesuffix(".gz")
    return EXTENSIONS.get(os.path.splitext(low)[1])


def _head(path: str) -> bytes:
    with (gzip.open if path.lower().endswith(".gz") else open)(path, "rb") as f:
        return f.read(HEAD)


def is_sqlite(path: str) -> bool:
    try:
        return _head(path)[:16] == MAGIC
    except (OSError, EOFError):
        return False


def sniff(path: str) -> str:
    """Format by the first byte after a byte order mark and white space."""
    start = _head(path).removeprefix(codecs.BOM_UTF8).lstrip()[:1]
    return "json" if start == b"[" else "jsonl" if start == b"{" else "csv"


def walk(folder: str) -> list[str]:
    """Files below a folder with a known extension, in sorted order; no links and no names with a leading dot."""
    out = []
    for base, dirs, files in os.walk(folder):
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(base, d)))
        for f in files:
            p = os.path.join(base, f)
            if not f.startswith(".") and not os.path.islink(p) and (kind := format_of(p)) and (kind != "sqlite" or is_sqlite(p)):
                out.append(p)
    return sorted(out)


def tables_of(path: str) -> list[str]:
    """Tables and views; none of SQLite's own, and no virtual tables with what belongs to them."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT name, sql FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite\\_%' ESCAPE '\\' ORDER BY name").fetchall()
    virtual = [n for n, s in rows if s and s.lstrip().upper().startswith("CREATE VIRTUAL")]
    return [n for n, _ in rows if n not in virtual and not any(n.startswith(f"{v}_") for v in virtual)]


def discover(paths: list[str], fmt: str = "auto", sql: str | None = None) -> list[Source]:
    """Sources of files, folders, ``-`` and ``file.db#table``. Something named that can't be read is an error."""
    out: list[Source] = []
    for raw in paths:
        if raw == "-":
            out.append(Source("-", "jsonl" if fmt == "auto" else fmt))
            continue
        path, _, table = raw.partition("#") if "#" in raw and not os.path.exists(raw) else (raw, "", "")
        if not os.path.exists(path):
            raise NoSource(f"{path} doesn't exist")
        inside = os.path.isdir(path)
        for p in walk(path) if inside else [path]:
            kind = fmt if fmt != "auto" else format_of(p) or ("sqlite" if is_sqlite(p) else sniff(p))
            if kind == "sqlite" and not is_sqlite(p):
                raise NoSource(f"{p} is no SQLite file")
            try:
                if kind != "sqlite":
                    with open(p, "rb"):
                        pass
                    out.append(Source(p, kind))
                elif sql or table:
                    out.append(Source(p, kind, table or None, sql))
                else:
                    out += [Source(p, kind, t) for t in tables_of(p)]
            except (OSError, sqlite3.Error) as e:
                if not inside:
                    raise NoSource(f"{p}: {e}") from None
    if not out:
        raise NoSource("no source found")
    return out


def manifest(sources: list[Source], config: dict) -> str:
    """What a build depends on; empty where it can't be known."""
    if any(s.path == "-" for s in sources):
        return ""
    stat = [(s.path, s.table, s.sql, s.kind, os.stat(s.path).st_size, os.stat(s.path).st_mtime_ns) for s in sources]
    return json.dumps({"sources": stat, "config": config}, sort_keys=True)


def assign_kinds(sources: list[Source], kinds: list, forced: str | None = None) -> list[Source]:
    """Give each source the kind whose paths name it, its folder, or its table."""
    out = []
    for s in sources:
        for k in kinds:
            if forced == k.name or any(os.path.abspath(s.path) == (a := os.path.abspath(p.partition("#")[0])) and (not p.partition("#")[2] or p.partition("#")[2] == s.table) or os.path.abspath(s.path).startswith(a + os.sep) for p in k.paths):
                out.append(replace(s, kind=k.name))
                break
        else:
            if kinds:
                raise NoSource(f"{s.label} belongs to no kind; name one")
            out.append(s)
    return out


def decode(raw: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def record_set(value: object, depth: int = 3) -> list[object]:
    """The records of a JSON document: an array, the largest array of mostly objects inside, a map of objects, or itself."""

    def objects(xs: list) -> bool:
        return 2 * sum(isinstance(x, dict) for x in xs) > len(xs)

    if isinstance(value, list):
        return header_rows(value) or value
    if not isinstance(value, dict):
        return [value]
    best: list | None = None
    level = [value]
    for _ in range(depth):
        inner = []
        for obj in level:
            for v in obj.values():
                if isinstance(v, list):
                    rows = v if v and objects(v) else header_rows(v)
                    if rows and (best is None or len(rows) > len(best)):
                        best = rows
                elif isinstance(v, dict):
                    inner.append(v)
        level = inner
    if best is not None:
        return best
    if len(value) >= 2 and all(isinstance(v, dict) for v in value.values()):
        return [v if "_key" in v else {"_key": k, **v} for k, v in value.items()]
    return [value]


def header_rows(rows: list) -> list[dict] | None:
    """Rows of cells under a row of names."""
    if len(rows) < 2 or not all(isinstance(r, list) for r in rows) or not rows[0] or not all(isinstance(c, str) for c in rows[0]):
        return None
    names = header(rows[0])
    return [{(names[i] if i < len(names) else f"column_{i + 1}"): c for i, c in enumerate(r) if c is not None} for r in rows[1:]]


def header(cells: list[str]) -> list[str]:
    """Names of columns: trimmed, blank ones numbered, repeated ones (in any case) told apart by a number."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for i, c in enumerate(cells):
        name = c.strip().lstrip("﻿").strip() or f"column_{i + 1}"
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        out.append(name if n == 1 else f"{name}_{n}")
    return out


def delimiter_of(line: str) -> str:
    """The most frequent of the usual delimiters outside of quotes; of equals the earlier."""
    counts, quoted = dict.fromkeys(",;\t|", 0), False
    for c in line:
        if c == '"':
            quoted = not quoted
        elif c in counts and not quoted:
            counts[c] += 1
    return max(counts, key=counts.get)


def parse_delimited(raw: bytes, tab: bool) -> Iterator[tuple[int, dict | None, str | None]]:
    """(line, record, error); cells are text, blank ones absent, blank rows skipped."""
    lines = [decode(x) for x in raw.removeprefix(codecs.BOM_UTF8).splitlines(keepends=True)]
    if not lines:
        return
    csv.field_size_limit(1 << 30)
    reader = csv.reader(lines, delimiter="\t" if tab else delimiter_of(lines[0]))
    names, at = None, 1
    for cells in reader:
        if names is None:
            names = header(cells)
        elif row := {(names[i] if i < len(names) else f"column_{i + 1}"): c for i, c in enumerate(cells) if c.strip()}:
            yield at, row, None
        at = reader.line_num + 1


def parse_document(raw: bytes) -> Iterator[tuple[int, object, str | None]]:
    try:
        value = json.loads(decode(raw.removeprefix(codecs.BOM_UTF8)))
    except (ValueError, RecursionError):
        yield from parse_lines(raw)
        return
    for i, r in enumerate(record_set(value)):
        yield (i + 1, r, None) if isinstance(r, dict) and r else (i + 1, None, "not an object")


def parse_lines(raw: bytes) -> Iterator[tuple[int, object, str | None]]:
    for i, line in enumerate(raw.removeprefix(codecs.BOM_UTF8).split(b"\n")):
        if line.strip():
            yield (i + 1, *check_line(decode(line)))


def check_line(text: str) -> tuple[object, str | None]:
    try:
        v = json.loads(text)
    except (ValueError, RecursionError) as e:
        return None, f"not JSON: {e}"[:200]
    return (v, None) if isinstance(v, dict) and v else (None, "not an object")


def is_document(path: str) -> bool:
    """A .jsonl file whose first line is only the start of a value is a document."""
    first = _head(path).removeprefix(codecs.BOM_UTF8).lstrip().split(b"\n")[0]
    if len(first) >= HEAD - 16:
        return False
    try:
        json.loads(decode(first))
    except json.JSONDecodeError as e:
        return e.pos >= len(first.rstrip()) - 1 or decode(first).strip() in ("{", "[")
    return False


def _whole_files(spark: SparkSession, sources: list[tuple[int, Source]]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for no, label, path, kind in pdf[["no", "label", "path", "format"]].itertuples(index=False):
                with (gzip.open if path.lower().endswith(".gz") else open)(path, "rb") as f:
                    raw = f.read()
                rows = parse_delimited(raw, kind == "tsv") if kind in ("csv", "tsv") else parse_document(raw)
                out = []
                for line, record, error in rows:
                    out.append((label, no, line, None if record is None else json.dumps(record, ensure_ascii=False), error))
                    if len(out) == 20_000:
                        yield pd.DataFrame(out, columns=["src", "src_no", "line", "doc", "error"])
                        out = []
                yield pd.DataFrame(out, columns=["src", "src_no", "line", "doc", "error"])

    listed = spark.createDataFrame([(no, s.label, s.path, s.format) for no, s in sources], "no int, label string, path string, format string")
    return listed.repartition(max(1, len(sources)), "no").mapInPandas(run, SCHEMA)


def _json_lines(spark: SparkSession, sources: list[tuple[int, Source]]) -> DataFrame:
    """Lines numbered without sorting them: each split's lines are counted first, and its first number follows from that."""
    text = spark.read.text([s.path for _, s in sources])
    at = F.monotonically_increasing_id()
    lines = text.select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), at.alias("m"))
    blocks = lines.groupBy("f", "b").agg(F.min("m").alias("m0"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("f").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.withColumn("n0", before).select(F.col("f").alias("f_"), F.col("b").alias("b_"), "m0", "n0")
    names = spark.createDataFrame([(files.qualified(spark, s.path), no, s.label) for no, s in sources], "u string, src_no int, src string")
    numbered = lines.join(small_side(starts, MAX_SPLITS), (F.col("f") == F.col("f_")) & (F.col("b") == F.col("b_")))
    numbered = numbered.join(F.broadcast(names), F.regexp_replace(F.url_decode("f"), "^(\\w+):/+", "$1:/") == F.col("u"), "left")
    numbered = numbered.withColumn("src_no", F.coalesce("src_no", F.raise_error(F.concat(F.lit("no source is at "), "f")).cast("int")))
    raw = F.regexp_replace(F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")), "^﻿", "")
    rows = numbered.select("src", "src_no", (F.col("m") - F.col("m0") + F.col("n0") + 1).alias("line"), raw.alias("v")).where(F.trim("v") != "")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            checked = [check_line(v) for v in pdf["v"]]
            yield pd.DataFrame({"src": pdf["src"], "src_no": pdf["src_no"], "line": pdf["line"], "doc": [v if e is None else None for v, (_, e) in zip(pdf["v"], checked, strict=True)], "error": [e for _, e in checked]})

    return rows.mapInPandas(run, SCHEMA)


def read(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """(src, src_no, line, doc, error, kind) of all sources; ``doc`` is JSON text, ``error`` says why there is none."""
    numbered = list(enumerate(sources))
    parts: list[DataFrame] = []
    lines = [(n, s) for n, s in numbered if s.format == "jsonl" and s.path != "-" and not is_document(s.path)]
    if lines:
        parts.append(_json_lines(spark, lines))
    whole = [(n, s) for n, s in numbered if s.format in ("json", "csv", "tsv") or (s.format == "jsonl" and s.path != "-" and (n, s) not in lines)]
    if whole:
        parts.append(_whole_files(spark, whole))
    for n, s in numbered:
        if s.format == "sqlite":
            from ravelin.sources.sqlite import SqliteSource

            spark.dataSource.register(SqliteSource)
            if s.table is None and s.sql is None:
                raise NoSource(f"{s.label}: name a table or a query")
            reader = spark.read.format("ravelin_sqlite").option("path", s.path)
            rows = (reader.option("query", s.sql) if s.sql else reader.option("table", s.table)).load()
            parts.append(rows.select(F.lit(s.label).alias("src"), F.lit(n).alias("src_no"), "line", "doc", F.lit(None).cast("string").alias("error")))
        elif s.path == "-":
            import sys

            rows = [("-", n, i, None if v is None else json.dumps(v, ensure_ascii=False), e) for i, v, e in (parse_document if s.format == "json" else parse_lines)(sys.stdin.buffer.read())]
            parts.append(spark.createDataFrame(rows, SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    kinds = {n: s.kind for n, s in numbered if s.kind}
    kind = F.lit(None).cast("string")
    for n, k in kinds.items():
        kind = F.when(F.col("src_no") == n, k).otherwise(kind)
    return out.withColumn("kind", kind)
