"""The comment table against a recursive walk, and the graph's decisions."""

import json
import random

from pyspark.sql import types as T

from ravelin.operators import nested

TICKETS = "seq long, customer struct<id:string,name:string>, comments array<struct<author:string,text:string,node:string>>, row_key string"


def brute(doc):
    """Parents of the comments of one JSON text, in the order written, and the customer."""
    try:
        j = json.loads(doc)
    except (TypeError, ValueError):
        return [], ""
    if not isinstance(j, dict):
        return [], ""

    def said(v):
        return bool(v.strip()) if isinstance(v, str) else any(map(said, v)) if isinstance(v, list) else any(map(said, v.values())) if isinstance(v, dict) else False

    def customer(c):
        if isinstance(c, list):
            return next((x for x in map(customer, c) if x), "")
        return c.strip() if isinstance(c, str) else (c.get("id") or "").strip() if isinstance(c, dict) else ""

    out = []

    def walk(v, parent):
        if isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                w = None
            if isinstance(w, (dict, list)):
                walk(w, parent)
            elif v.strip():
                out.append(parent)
        elif isinstance(v, list):
            for x in v:
                walk(x, parent)
        elif isinstance(v, dict):
            if {"author", "text", "replies"} & set(v):
                own = parent
                if said(v.get("author")) or said(v.get("text")):
                    out.append(parent)
                    own = len(out)
                walk(v.get("replies"), own)
            else:
                for x in v.values():
                    walk(x, parent)

    walk(j.get("comments"), 0)
    return out, customer(j.get("customer", j.get("customer.id")))


def comment(rnd, depth):
    c = {"author": rnd.choice(["a", "", None, {"id": "u1", "name": "b"}]), "text": rnd.choice(["t", " ", None, ["x", "y"]])}
    if depth and rnd.random() < 0.6:
        inner = [rnd.choice(["plain", None, "", comment(rnd, depth - 1), comment(rnd, depth - 1)]) for _ in range(rnd.randint(0, 3))]
        c["replies"] = rnd.choice([inner, inner, None, inner[0] if inner else []])
    return c


def ticket(rnd):
    many = [rnd.choice([comment(rnd, 3), comment(rnd, 3), "plain", None, {}]) for _ in range(rnd.randint(0, 4))]
    shapes = [many, [many, [comment(rnd, 2)]], {f"m{i + 1}": c for i, c in enumerate(many)}, json.dumps(many), comment(rnd, 3), None, "plain"]
    who = rnd.choice([{"id": " C-1 ", "name": "n"}, "C-2", [{"id": None}, {"id": "C-3"}], None, {}, []])
    return {"ticket_id": "T", "customer": who, "comments": rnd.choice(shapes), "sla": {"steps": [{"n": 1}, {"n": 2}]}}


def test_against_a_walk(spark):
    rnd = random.Random(11)
    docs = [json.dumps(ticket(rnd)) for _ in range(400)] + ["[]", "null", "", "not json", '{"ticket_id": "T", "comm', json.dumps({"customer.id": "C-4 ", "comments": ["x"]}), None]
    raw = spark.createDataFrame(list(enumerate(docs)), "raw_id long, doc string")
    got = sorted(tuple(r) for r in nested.comment_rows(spark.createDataFrame([], TICKETS), raw).collect())
    want = sorted(("raw_tickets", i, n + 1, p, c) for i, d in enumerate(docs) for out, c in [brute(d)] for n, p in enumerate(out))
    assert got == want


def test_typed_rows_and_odd_cases(spark):
    rows = [(1, ("  C-9", "n"), [("a", None, "q"), None, (" ", ""), (None, "t")], "k"), (2, None, None, None), (3, (None, None), [], None), (None, ("C", None), [("x", "y")], None), (1, ("C-9 ", "n"), [("a", "b")], "k")]
    df = spark.createDataFrame([(a, b, [c and (*c, "z")[:3] for c in cs] if cs is not None else None, k) for a, b, cs, k in rows], TICKETS)
    got = sorted(map(str, nested.comment_rows(df, spark.createDataFrame([], "raw_id long, doc string")).collect()))
    want = [("tickets", 1, 1, 0, "C-9"), ("tickets", 1, 2, 0, "C-9"), ("tickets", None, 1, 0, "C"), ("tickets", 1, 1, 0, "C-9")]
    assert len(got) == len(want)
    assert sorted(tuple(eval(x.replace("Row", "dict")).values()) for x in got if "None" not in x) == sorted(w for w in want if w[1])


def test_graph_decides_tables(spark):
    docs = [json.dumps({"a": {"b": {"c": 1}}, "items": [{"n": 1}, {"n": 2}], "tree": {"v": 1, "w": 2, "kids": [{"v": 2, "w": 3, "kids": []}]}})]
    g = nested.json_graph(spark.createDataFrame([(docs[0],)], "d string"), "d")
    assert g.tables == {"items", "tree"}  # repeated; recursive through another name
    assert g.kind["kids"] == "tree"
    rows = nested.shred_json(spark.createDataFrame([(1, docs[0])], "k int, d string"), "k", "d", g, carry={"top": "a.b.c"}).collect()
    assert {(r["tbl"], r["node"], r["parent"], r["top"]) for r in rows} == {("", 0, 0, "1"), ("items", 1, 0, "1"), ("items", 2, 0, "1"), ("tree", 1, 0, "1"), ("tree", 2, 1, "1")}
    root = next(r for r in rows if r["tbl"] == "")
    assert root["cols"] == {"a.b.c": "1"}


def test_type_graph():
    st = T.StructType.fromDDL("customer struct<id:string>, comments array<struct<author:string>>")
    assert nested.type_graph(st).tables == {"comments"}


def test_very_deep_and_long_values(spark):
    deep = '{"comments": ' + '[' * 5000 + ']' * 5000 + "}"
    chain = {"author": "a", "text": "t"}
    for _ in range(300):
        chain = {"author": "a", "text": "t" * 1000, "replies": [chain]}
    raw = spark.createDataFrame([(1, deep), (2, json.dumps({"comments": [chain]}))], "raw_id long, doc string")
    got = nested.comment_rows(spark.createDataFrame([], TICKETS), raw).collect()
    assert sorted(r["node"] for r in got if r["row_no"] == 2) == list(range(1, 302))
    assert all(r["parent"] == r["node"] - 1 for r in got if r["row_no"] == 2)


def test_any_depth():
    wrapped = '{"w":' * 3_000 + '{"comments":[{"author":"a","text":"deep"}]}' + "}" * 3_000
    replies = '{"text":"r","comments":[' * 50_000 + '{"text":"last"}' + "]}" * 50_000
    doc = '{"comments":[' + replies + '],"x":' + wrapped + "}"
    record = nested.loads(doc)
    edges: dict = {}
    nested._edges_of(record, edges)
    graph = nested.SchemaGraph({e: tuple(x) for e, x in edges.items()})
    rows = [r for r in nested.Shredder(graph, {}, {}, {"comments": ("author", "text")}).shred(record) if r[0] == graph.element("comments")]
    assert len(rows) == 50_002 and [r[2] for r in rows[:50_001]] == list(range(50_001)) and rows[-1][2] == 0
    for text in ('{"a":[1,{"b":"x\\n"},[],{}, null ,-1.5e3,true]} ', "[1,2", '{"a" 1}', "[1] 2", '{"a":1,}', "[1,]", ""):
        try:
            want = json.loads(text)
        except ValueError:
            want = None
        try:
            got = nested._loads_deep(text)
        except (ValueError, IndexError, StopIteration):
            got = None
        assert got == want


def test_several_singletons_are_kept():
    graph = nested.SchemaGraph({("", "customer"): (2, 2, 0), ("customer", "id"): (0, 0, 2)})
    rows = nested.Shredder(graph, {"customer": "id"}, {}, {}).shred({"customer": [{"id": "a"}, {"id": "b"}]})
    assert rows[0][3] == {"customer.id": "a"}
    assert [(t, n, c) for t, n, _, c in rows[1:]] == [("customer", 1, {"id": "a"}), ("customer", 2, {"id": "b"})]


def test_typed_rows_at_any_depth(spark):
    schema = "k int, o struct<lines:array<struct<sku:string,parts:array<array<struct<n:int,at:string>>>>>>"
    rows = [(1, ([("x", [[(1, "p"), None], [(2, "q")]]), ("y", None)],)), (2, (None,)), (3, None)]
    df = spark.createDataFrame(rows, schema)
    assert [tuple(r) for r in nested.typed_rows(df, "o.lines", "k").orderBy("at").collect()] == [(1, [1], "x"), (1, [2], "y")]
    assert [tuple(r) for r in nested.typed_rows(df, "o.lines.parts", "k").orderBy("at").collect()] == [(1, [1, 1, 1], 1, "p"), (1, [1, 2, 1], 2, "q")]
