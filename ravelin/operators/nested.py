"""Deeply nested records -> related flat tables that keep their parent-child links.

Method: shared inlining. The schema graph has an element for each key that holds objects, and an edge for each
key seen inside an element. An element gets a table of its own where it is repeated, shared by several
parents, or recursive; any other descendant is inlined into the table above it, its columns named by the path.
Each row of a table carries the key of its record, its number in it, and the number of the row it belongs to.

Two front ends share the graph:
* typed columns: the graph is the DataFrame's schema, and the tables are built-in generators, all JVM-side;
* JSON text: the graph is gathered in a first pass (a bounded set of edges with mergeable counts), and a
  second pass shreds each record in the task that reads it. Neither needs a shuffle of records.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ravelin.session import spread

#: A schema graph with more edges than this isn't a schema; the gathering pass refuses it instead of collecting it.
MAX_EDGES = 20_000
#: A child whose keys are this much like its parent's is the same element under another name.
ALIKE = 0.5
#: Levels of nesting that column names tell; values at any depth are followed, deeper ones named as if at this level.
MAX_DEPTH = 400
ROOT = ""


@dataclass
class SchemaGraph:
    """``edges``: (parent, key) -> (objects seen under it, most in one parent, scalars seen under it)."""

    edges: dict[tuple[str, str], tuple[int, int, int]]
    kind: dict[str, str] = field(default_factory=dict)
    tables: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        objects = {k for (_, k), (n, _, _) in self.edges.items() if n}
        keys = {e: {k for p, k in self.edges if p == e} for e in objects}
        self.kind = {e: e for e in objects}

        def root(e: str) -> str:
            while self.kind.get(e, e) != e:
                e = self.kind[e]
            return e

        merged = True
        while merged:  # recursion under other names: replies in comments, m1 in a keyed map of comments
            merged = False
            for (p, k), (n, _, _) in sorted(self.edges.items()):
                if n and p in objects and root(p) != root(k):
                    a, b = keys[p] - {k}, keys[k]
                    small = a & b
                    if small and (b <= a or len(small) >= 2 and len(small) / min(len(a - objects | small), len(b)) >= ALIKE):
                        self.kind[root(k)] = root(p)
                        merged = True
        self.kind = {e: root(e) for e in objects}
        into: dict[str, set[str]] = {}
        most: dict[str, int] = {}
        self.up: dict[str, set[str]] = {}
        for (p, k), (n, many, _) in self.edges.items():
            if n:
                e, q = self.kind[k], self.kind.get(p, p)
                into.setdefault(e, set()).add(q)
                most[e] = max(most.get(e, 0), many)
        self.tables = {e for e in into if len(into[e]) > 1 or most[e] > 1 or e in self._reach(e, into)}

    @staticmethod
    def _reach(e: str, into: dict[str, set[str]]) -> set[str]:
        seen: set[str] = set()
        todo = list(into.get(e, ()))
        while todo:
            p = todo.pop()
            if p not in seen:
                seen.add(p)
                todo += into.get(p, ())
        return seen

    def element(self, key: str) -> str | None:
        return self.kind.get(pattern(key))


def pattern(key: str) -> str:
    """Keys that differ only in a number are one key of the graph, so keyed maps stay bounded."""
    return re.sub(r"\d+", "#", key)


def loads(text: object) -> object:
    """The JSON value, or None for anything that isn't JSON."""
    try:
        return json.loads(text)
    except RecursionError:
        try:
            return _loads_deep(text)
        except (ValueError, IndexError, StopIteration):
            return None
    except (ValueError, TypeError):
        return None


_SPACE = re.compile(r"[ \t\n\r]*")


def _loads_deep(s: str) -> object:
    """``json.loads`` without recursion."""
    scalar = json.JSONDecoder().scan_once
    skip = lambda i: _SPACE.match(s, i).end()
    held: list[list] = []  # open containers with the key that the next value gets

    def key_at(i: int) -> int:
        if s[i] != '"':
            raise ValueError("no key")
        held[-1][1], i = scanstring(s, i + 1)
        i = skip(i)
        if s[i] != ":":
            raise ValueError("no colon")
        return skip(i + 1)

    i = skip(0)
    while True:
        if s[i] in "{[":
            v, end = ({}, "}") if s[i] == "{" else ([], "]")
            i = skip(i + 1)
            if s[i] != end:
                held.append([v, None])
                i = key_at(i) if end == "}" else i
                continue
            i += 1
        else:
            v, i = scalar(s, i)
        while True:  # v is whole
            i = skip(i)
            if not held:
                if i != len(s):
                    raise ValueError("more than one value")
                return v
            inside, key = held[-1]
            if isinstance(inside, dict):
                inside[key] = v
            else:
                inside.append(v)
            if s[i] == ",":
                i = skip(i + 1)
                i = key_at(i) if isinstance(inside, dict) else i
                break
            if s[i] != ("}" if isinstance(inside, dict) else "]"):
                raise ValueError("not closed")
            v = held.pop()[0]
            i += 1


def opened(v: object) -> object:
    """A value given as JSON text is taken as the value itself."""
    if isinstance(v, str) and (s := v.strip())[:1] in ("[", "{") and isinstance(w := loads(s), (list, dict)):
        return w
    return v


def nest_dotted(record: dict) -> dict:
    """``{"a.b": 1}`` -> ``{"a": {"b": 1}}``, unless ``a`` holds something else already."""
    if not any("." in k for k in record):
        return record
    out = {k: v for k, v in record.items() if "." not in k}
    for k, v in record.items():
        if "." in k:
            head, _, rest = k.partition(".")
            inner = out.setdefault(head, {})
            if isinstance(inner, dict):
                inner.setdefault(rest, v)
            else:
                out[k] = v
    return out


def items(v: object) -> list:
    """The members of arrays within arrays (and of JSON text), in the order written."""
    out, todo = [], [v]
    while todo:
        x = opened(todo.pop())
        if isinstance(x, list):
            todo.extend(reversed(x))
        else:
            out.append(x)
    return out


def _edges_of(record: dict, edges: dict) -> None:
    todo = [(ROOT, nest_dotted(record))]
    while todo:
        element, obj = todo.pop()
        for k, v in obj.items():
            parts = items(v)
            inner = [x for x in parts if isinstance(x, dict)]
            e = edges.setdefault((element, pattern(k)), [0, 0, 0])
            e[0] += len(inner)
            e[1] = max(e[1], len(inner))
            e[2] += sum(not isinstance(x, dict) and x is not None for x in parts)
            todo += [(pattern(k), x) for x in inner]


def json_graph(df: DataFrame, doc: str) -> SchemaGraph:
    """Gather the graph of a column of JSON text; lines that are no JSON object add nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges: dict = {}
        for pdf in batches:
            for text in pdf["d"]:
                if isinstance(r := loads(text), dict):
                    _edges_of(r, edges)
            if len(edges) > MAX_EDGES:
                break
        yield pd.DataFrame([(p, k, *e) for (p, k), e in edges.items()], columns=["p", "k", "o", "m", "s"])

    found = df.select(F.col(doc).alias("d")).mapInPandas(run, "p string, k string, o long, m long, s long")
    rows = found.groupBy("p", "k").agg(F.sum("o"), F.max("m"), F.sum("s")).limit(MAX_EDGES + 1).collect()
    if len(rows) > MAX_EDGES:
        raise ValueError(f"more than {MAX_EDGES} edges: not a schema")
    return SchemaGraph({(r[0], r[1]): (r[2], r[3], r[4]) for r in rows})


def type_graph(schema: T.StructType) -> SchemaGraph:
    """The graph of a typed schema: an array may repeat, a struct may not."""
    edges: dict[tuple[str, str], tuple[int, int, int]] = {}

    def walk(element: str, st: T.StructType) -> None:
        for f in st.fields:
            kind, many = f.dataType, 1
            while isinstance(kind, T.ArrayType):
                kind, many = kind.elementType, 2
            inner = isinstance(kind, T.StructType)
            n, m, s = edges.get((element, f.name), (0, 0, 0))
            edges[(element, f.name)] = (n + inner, max(m, many * inner), s + (not inner))
            if inner:
                walk(f.name, kind)

    walk(ROOT, schema)
    return SchemaGraph(edges)


def text_of(v: object) -> str | None:
    """A scalar as text, several joined by a line break; None if nothing readable is there."""
    if v is None or isinstance(v, dict):
        return None
    if isinstance(v, list):
        return "\n".join(t for x in items(v) if (t := text_of(x)) is not None) or None
    return v if isinstance(v, str) else json.dumps(v)


@dataclass
class Shredder:
    """Shreds one record into rows (table, node, parent, columns) by the plan the graph gives.

    ``singletons``: element -> column that a bare scalar in its place stands for; such elements are inlined, of several
    the first one with a value, and all of these get rows of their own besides, so that none is lost. ``bare``: column that a bare string in place of a repeated
    element stands for. ``content``: columns of which one must be non-blank for a row of a table to exist.
    """

    graph: SchemaGraph
    singletons: dict[str, str]
    bare: dict[str, str]
    content: dict[str, tuple[str, ...]]

    def table(self, key: str) -> str | None:
        e = self.graph.element(key)
        return e if e in self.graph.tables and e not in self.singletons else None

    def columns(self, obj: dict) -> dict[str, str]:
        out: dict[str, str] = {}
        # todo holds objects to read (object, prefix, depth) and columns to set (None, column, depth, text, first)
        todo: list[tuple] = [(obj, "", 0)]
        while todo:
            x, name, depth, *rest = todo.pop()
            if x is None:
                t, first = rest
                if depth or not first:
                    if (t.strip() or not depth) and not out.get(name, "").strip():
                        out[name] = t
                else:
                    out.setdefault(name, t)
                continue
            steps: list[tuple] = []
            for k, v in x.items():
                if self.table(k) is not None:
                    continue
                parts = items(v)
                for y in parts:
                    if isinstance(y, dict):
                        steps.append((y, f"{name}{k}." if depth < MAX_DEPTH else name, depth + 1))
                    elif k in self.singletons and y is not None:
                        steps.append((None, f"{name}{k}.{self.singletons[k]}", depth, text_of(y), False))
                plain = [y for y in parts if not isinstance(y, dict)]
                if k not in self.singletons and (t := text_of(plain)) is not None:
                    steps.append((None, f"{name}{k}", depth, t, True))
            todo.extend(reversed(steps))
        return out

    def shred(self, record: dict) -> list[tuple[str, int, int, dict[str, str]]]:
        record = nest_dotted(record)
        rows = [(ROOT, 0, 0, self.columns(record))]
        count: dict[str, int] = {}
        # todo holds (value, table, parent number in the table, parents), the next one to write last
        todo: list[tuple[object, str | None, int, dict[str, int]]] = []

        def push(obj: dict, parents: dict[str, int]) -> None:
            held = [(x, t, parents.get(t, 0)) for k, v in obj.items() if (t := self.table(k)) for x in items(v)]
            for k, v in obj.items():
                if self.table(k) is None:
                    inner = [x for x in items(v) if isinstance(x, dict)]
                    own = self.graph.element(k) if k in self.singletons and len(inner) > 1 else None
                    held += [(x, own, 0) for x in inner]
            todo.extend(reversed([(*h, parents) for h in held]))

        push(record, {})
        while todo:
            x, table, parent, parents = todo.pop()
            if table is None:
                push(x, parents)
                continue
            cols = {}
            if isinstance(x, dict):
                cols = self.columns(x)
            elif x is not None and (t := text_of(x)) is not None:
                cols = {self.bare.get(table, "value"): t}
            wanted = self.content.get(table)
            if any(t.strip() for c, t in cols.items() if wanted is None or c.split(".")[0] in wanted):
                count[table] = node = count.get(table, 0) + 1
                rows.append((table, node, parent, cols))
                parents = {**parents, table: node}
            if isinstance(x, dict):
                push(x, parents)
        return rows


def shred_json(df: DataFrame, key: str, doc: str, graph: SchemaGraph, *, singletons: dict[str, str] | None = None, bare: dict[str, str] | None = None, content: dict[str, tuple[str, ...]] | None = None, carry: dict[str, str] | None = None) -> DataFrame:
    """(key, tbl, node, parent, cols, + carried): the rows of all tables of a column of JSON text.

    ``carry``: name -> column of the record's own row that each row of the other tables gets as foreign key, trimmed,
    ``''`` if the record has none. Lines that are no JSON object give no rows. One pass, no shuffle.
    """
    shredder = Shredder(graph, singletons or {}, bare or {}, content or {})
    carry = carry or {}
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf["k"], pdf["d"], strict=True):
                if isinstance(r := loads(text), dict):
                    rows = shredder.shred(r)
                    own = [(rows[0][3].get(c) or "").strip() for c in carry.values()]
                    out += [(k, *row, *own) for row in rows]
            yield pd.DataFrame(out, columns=["row_key", "tbl", "node", "parent", "cols", *carry])

    schema = f"row_key {kind}, tbl string, node int, parent int, cols map<string,string>" + "".join(f", `{c}` string" for c in carry)
    return df.select(F.col(key).alias("k"), F.col(doc).alias("d")).mapInPandas(run, schema)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def typed_table(df: DataFrame, path: str, graph: SchemaGraph, key: str, content: tuple[str, ...], carry: dict[str, str]) -> DataFrame:
    """(row_key, node, parent, <scalar columns>, + carried) of a repeated element of a typed column.

    Rows whose ``content`` columns are all null or blank take no number. Generators only, no shuffle.
    """
    if graph.element(path) not in graph.tables:
        raise ValueError(f"{path} is inlined, it has no table")
    fields = [f.name for f in df.schema[path].dataType.elementType.fields]
    has = lambda x: F.exists(F.array(*[x[c] for c in content]), lambda t: F.coalesce(t.rlike(r"(?U)\S"), F.lit(False)))
    kept = F.filter(F.col(path), lambda x: x.isNotNull() & has(x))
    keep = [F.coalesce(stripped(F.col(c)), F.lit("")).alias(n) for n, c in carry.items()]
    rows = df.select(F.col(key).alias("row_key"), *keep, F.posexplode(kept).alias("_i", "_x"))
    taken = {"row_key", "node", "parent", *carry}  # a field of such a name gets an underscore
    return rows.select("row_key", (F.col("_i") + 1).alias("node"), F.lit(0).alias("parent"), *[F.col(f"_x.`{f}`").alias(f + "_" * (f in taken)) for f in fields], *carry)


def typed_rows(df: DataFrame, path: str, key: str) -> DataFrame:
    """(row_key, at, <scalar columns>) of a repeated element at any depth of a typed schema, such as ``orders.lines.parts``.

    ``at`` has the place (from 1) in each array passed on the way, so a row's parent is the row of the table above with
    the same key and ``at`` without its last place. Null elements keep their place and give no row. Generators only.
    """
    first, *rest = path.split(".")
    kind = df.schema[first].dataType
    cur = df.select(F.col(f"`{key}`").alias("row_key"), F.array().cast("array<int>").alias("at"), F.col(f"`{first}`").alias("_x"))
    while True:
        while isinstance(kind, T.ArrayType):
            cur = cur.select("row_key", "at", F.posexplode("_x").alias("_i", "_x")).select("row_key", F.concat("at", F.array(F.col("_i") + 1)).alias("at"), "_x").where(F.col("_x").isNotNull())
            kind = kind.elementType
        if not rest:
            break
        name, *rest = rest
        kind = kind[name].dataType
        cur = cur.select("row_key", "at", F.col(f"_x.`{name}`").alias("_x"))
    plain = [f.name for f in kind.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))] if isinstance(kind, T.StructType) else []
    taken = {"row_key", "at"}
    return cur.select("row_key", "at", *[F.col(f"_x.`{f}`").alias(f + "_" * (f in taken)) for f in plain] or [F.col("_x").alias("value")])


#: Declared for the ticket data: what a bare scalar means, and what makes a comment a comment.
TICKET_SINGLETONS = {"customer": "id", "author": "name"}
TICKET_BARE = {"comments": "text"}
TICKET_CONTENT = {"comments": ("author", "text")}


def ticket_tables(tickets: DataFrame, raw_tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(comments of the typed tickets, all rows of all tables of the raw ones)."""
    graph = type_graph(T.StructType([tickets.schema["customer"], tickets.schema["comments"]]))
    typed = typed_table(tickets, "comments", graph, "seq", ("author", "text"), {"customer_id": "customer.id"})
    raw_tickets = spread(raw_tickets.select("raw_id", "doc"), "raw_id")
    gathered = json_graph(raw_tickets, "doc")
    # comments are a table even where no record of this load repeats them
    gathered.kind.setdefault("comments", "comments")
    gathered.tables.add(gathered.kind["comments"])
    raw = shred_json(raw_tickets, "raw_id", "doc", gathered, singletons=TICKET_SINGLETONS, bare={gathered.kind["comments"]: "text"}, content={gathered.kind["comments"]: ("author", "text")}, carry={"customer_id": "customer.id"})
    return typed, raw.withColumn("tbl", F.when(F.col("tbl") == gathered.kind["comments"], "comments").otherwise(F.col("tbl")))


def comment_rows(tickets: DataFrame, raw_tickets: DataFrame) -> DataFrame:
    """(tbl, row_no, node, parent, customer_id): the comment table's keys, of both kinds of tickets."""
    typed, raw = ticket_tables(tickets, raw_tickets)
    a = typed.select(F.lit("tickets").alias("tbl"), F.col("row_key").alias("row_no"), "node", "parent", "customer_id")
    b = raw.where("tbl = 'comments'").select(F.lit("raw_tickets").alias("tbl"), F.col("row_key").alias("row_no"), "node", "parent", "customer_id")
    return a.unionByName(b)
