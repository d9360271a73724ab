"""A small corpus through the whole engine: build, search, aggregate, change, infer; files of every kind."""

import gzip
import json
import random
import sqlite3

import pytest

from ravelin import config as cf
from ravelin.functions import text as tx
from ravelin.operators import aggregate as ag
from ravelin.operators import infer, postings
from ravelin.operators.index import Index, Refused
from ravelin.operators.store import SearchRequest, Store, page_of, scope_filter
from ravelin.sources import readers

TICKETS = [
    ("K-1", "Login loops after password reset", "C-NORTH", "Northwind Mills", "closed", "high", ["auth", "sso"], "2024-01-08T09:12:00Z", "The old cookie survives a reset of the password.", "Cleared the cookie. North gate."),
    ("K-2", "Export stops at row 10,000", "C-NORTH", "Northwind Mills", "closed", "normal", ["export"], "2024-02-15T13:02:00Z", "Rows are missing from the file.", "n/a"),
    ("K-3", "Webhook fails with 401", "C-EAST", "Easterly Foods", "open", "high", ["SSO"], "2024-03-02T08:30:00Z", "Every call fails since the reset.", ""),
    ("K-4", "Leading zeros vanish", "C-EAST", "Easterly Foods", "closed", "low", [], "3/11/2024 2:15 PM", "The leading zeros of part numbers are cut.", "Fixed"),
    ("K-5", "Slow report for app-01", "C-WEST", "Westerly Rail", "open", "normal", ["report"], "2024-10-01", "The report of app-01 takes an hour.", "see notes"),
]


def write_tickets(path, rows=TICKETS):
    keys = ("ticket_id", "subject", "cid", "cname", "status", "priority", "tags", "created_at", "body", "resolution")
    lines = []
    for r in rows:
        d = dict(zip(keys, r, strict=True))
        d["customer"] = {"id": d.pop("cid"), "name": d.pop("cname")}
        lines.append(json.dumps(d))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


CONFIG = {
    "fields": {"id": "ticket_id", "title": "subject", "text": ["body", "resolution"], "group": "customer.id", "group_name": "customer.name", "date": "created_at", "filters": ["status", "priority", "tags[]"], "display": ["status", "resolution"], "empty_values": ["n/a", "see notes"]},
    "rank": {"boost": [{"field": "resolution", "weight": 0.15}, {"field": "status", "equals": "closed", "weight": 0.03}]},
}


@pytest.fixture(scope="module", params=["plain", "porter"])
def built(spark, tmp_path_factory, request):
    folder = tmp_path_factory.mktemp("idx")
    src = write_tickets(folder / "tickets.jsonl")
    index = Index(spark, str(folder / "index"))
    sources = readers.discover([src])
    report = index.build(sources, cf.from_dict(CONFIG), analyzer=request.param)
    assert (report.built, report.records, report.groups, report.skipped) == (True, 5, 3, 0)
    assert not index.build(sources, cf.from_dict(CONFIG), analyzer=request.param).built  # nothing changed
    return index


def test_search(built):
    store = Store(built)
    out = store.search(SearchRequest("login after password reset", group="Northwind Mills"))
    assert (out.status, out.group.key, out.group.match_type, out.results[0].id) == ("ok", "C-NORTH", "name", "K-1")
    assert out.results[0].fields["status"] == "closed" and out.results[0].rank == 1
    assert [c.id for c in store.search(SearchRequest('"leading zeros"')).results] == ["K-4"]
    assert "K-1" not in [c.id for c in store.search(SearchRequest("reset -password")).results]
    assert [c.id for c in store.search(SearchRequest("app-01")).results] == ["K-5"]
    out = store.search(SearchRequest("", filters=[("tags[]", "sso")], since="2024-01", until="2024-03"))
    assert ({c.id for c in out.results}, out.total_matches) == ({"K-1", "K-3"}, 2)
    out = store.recent(group="C-east", limit=1)
    assert [c.id for c in out.results] == ["K-4"] and out.total_matches == 2 and out.results[0].date == "2024-03-11 14:15"
    out = store.search(SearchRequest("webhook", group="C-NORTH"))
    assert (out.total_matches, [c.id for c in out.other_groups], out.other_groups[0].other_group) == (0, ["K-3"], True)
    assert not store.search(SearchRequest("webhook", group="C-NORTH", fallback=False)).other_groups
    assert store.search(SearchRequest("x", group="C-")).status == "ambiguous_group"
    assert store.search(SearchRequest("x", group="Nobody Ltd")).status == "unknown_group"
    assert store.search(SearchRequest("x", filters=[("nope", "1")])).status == "bad_request"
    assert store.search(SearchRequest("x", since="soon")).status == "bad_request"
    assert "no searchable words" in store.search(SearchRequest("the and")).notes[0]
    assert json.loads(store.get("K-2"))["subject"].startswith("Export")
    assert store.get("K-99") is None
    assert "resolution" not in store.card_by_id("K-2").fields
    if built.meta["analyzer"] == "porter":
        assert [c.id for c in store.search(SearchRequest("failing webhooks")).results][:1] == ["K-3"]


def test_postings_rank_as_the_scan(built):
    store = Store(built)
    asked = [("reset report rows", None, "all"), ('"leading zeros" reset -password', None, "all"), ("reset", "C-NORTH", "group"), ("reset", "C-NORTH", "others"), ('"reset of the password"', None, "all"), ("nothing here", None, "all")]
    questions = [postings.Question(tx.Query.parse(t), k, s) for t, k, s in asked]
    fast = [[(r["seq"], round(r["relevance"], 6)) for r in postings.pages(store.hits(questions), 5).orderBy("q", "rank").collect() if r["q"] == i] for i in range(len(asked))]
    for (text, key, scope), rows in zip(asked, fast, strict=True):
        _, page = page_of(store.records, tx.Query.parse(text), where=scope_filter(scope, key), scoped=scope == "group", forms=store.forms)
        assert rows == [(r["seq"], round(r["relevance"], 6)) for r in page.collect()], text
    assert fast[0] and fast[2] and not fast[5]
    batch = store.search_all(["reset", "webhook", "the"], ["C-NORTH", "C-NORTH", None]).orderBy("q", "rank").collect()
    assert [(r["q"], r["rank"], r["other_group"]) for r in batch] == [(0, 1, False), (1, 1, True)]


def test_describe_and_aggregate(built):
    store = Store(built)
    d = store.describe(2)
    assert (d.records, d.groups, d.date_min[:7], d.example_id) == (5, 3, "2024-01", "K-5")
    assert next(f for f in d.facets if f.field == "status").top == [("closed", 3), ("open", 2)]
    out = store.aggregate(ag.AggregateRequest(by="group"))
    assert [(r.key, r.name, r.records) for r in out.rows] == [("C-EAST", "Easterly Foods", 2), ("C-NORTH", "Northwind Mills", 2), ("C-WEST", "Westerly Rail", 1)]
    assert store.aggregate(ag.AggregateRequest(by="month", limit=2)).buckets == 4
    assert store.aggregate(ag.AggregateRequest(group_contains="Foods", by="group")).records == 2
    assert store.aggregate(ag.AggregateRequest(metric="distinct", field="priority")).value == 3.0
    for bad in (ag.AggregateRequest(by="a,b,c"), ag.AggregateRequest(numeric=["hours>>4"]), ag.AggregateRequest(metric="sum"), ag.AggregateRequest(metric="what")):
        assert store.aggregate(bad).status == "bad_request"


def test_upsert_and_delete(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.build(readers.discover([write_tickets(tmp_path / "a.jsonl")]), cf.from_dict(CONFIG))
    new = [("K-1", "Login works", "C-NORTH", "Northwind Mills Ltd", "open", "high", [], "2024-12-01", "b", ""), ("K-9", "New", "C-SOUTH", "Southern", "open", "low", [], "2024-12-02", "b", "")]
    report = index.upsert(readers.discover([write_tickets(tmp_path / "b.jsonl", new)]))
    assert (report.inserted, report.updated, report.records, report.groups) == (1, 1, 6, 4)
    assert Store(index).aggregate(ag.AggregateRequest(filters=[("status", "open")])).records == 4
    assert index.table("groups").where("key = 'C-NORTH'").first()["name"] == "Northwind Mills Ltd"
    assert index.delete(["K-9", "missing"]).deleted == 1
    assert Store(index).describe().records == 5
    before = index.version
    (tmp_path / "bad.jsonl").write_text('{"ticket_id": "K-1"}\nnot json\n{"x": 1}\n')
    with pytest.raises(Refused):
        index.build(readers.discover([str(tmp_path / "bad.jsonl")]), cf.from_dict(CONFIG), strict=True)
    assert index.version == before
    report = index.build(readers.discover([str(tmp_path / "bad.jsonl")]), cf.from_dict(CONFIG))
    assert (report.records, report.skipped, len(report.examples)) == (1, 2, 2)


def test_aggregates_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        hours = rnd.choice([None, "n/a", "1,234.50", rnd.randint(0, 4000) / 4, [1.5, 2]])
        r = {"id": f"r{i}", "summary": " ".join(rnd.choices(["pump", "valve", "seal", "belt"], k=2)), "tags": rnd.choices(["a", "B", "c"], k=rnd.randint(0, 3)), "site": rnd.choice([None, "n", "s", "e"]), "opened": rnd.choice([None, f"20{rnd.randint(20, 25)}-0{rnd.randint(1, 9)}-11"]), "kind": rnd.choice([None, "x", "y"])}
        rows.append(r if hours is None and rnd.random() < 0.5 else r | {"hours": hours})
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, rows)))
    config = cf.from_dict({"fields": {"id": "id", "title": ["summary"], "text": ["summary"], "group": "site", "date": ["opened"], "filters": ["kind", "tags[]"]}})
    index = Index(spark, str(tmp_path / "i"))
    index.build(readers.discover([str(tmp_path / "r.jsonl")]), config)
    store = Store(index)

    def numbers(r):
        out = []
        for h in r["hours"] if isinstance(r.get("hours"), list) else [r.get("hours")]:
            if isinstance(h, (int, float)):
                out.append(float(h))
            elif isinstance(h, str) and h != "n/a":
                out.append(float(h.replace(",", "")))
        return out

    def keys(r, d):
        found = {"group": [r["site"]], "year": [(r["opened"] or "")[:4]], "kind": [r["kind"]], "tags[]": sorted(set(r["tags"])), "site": [r["site"]]}[d]
        return [k for k in found if k] or [""]

    for _ in range(25):
        by = rnd.choice(["", "group", "year", "kind", "tags[]", "group,year", "kind,tags[]"])
        metric = rnd.choice(["count", "sum", "avg", "min", "max", "distinct"])
        field = "tags" if metric == "distinct" else None if metric == "count" else "hours"
        word, above, since = rnd.choice(["", "pump", "pump -seal"]), rnd.choice([None, 300]), rnd.choice([None, "2022"])
        kept = [r for r in rows if (not word or "pump" in r["summary"].split() and not ("-seal" in word and "seal" in r["summary"].split())) and (above is None or any(n > above for n in numbers(r))) and (since is None or (r["opened"] or "") >= since)]

        def value(rs, metric=metric):
            ns = [n for r in rs for n in numbers(r)]
            if metric == "count":
                return float(len(rs))
            if metric == "distinct":
                return float(len({t for r in rs for t in r["tags"]}))
            if not ns:
                return 0.0
            return {"sum": sum(ns), "avg": sum(ns) / len(ns), "min": min(ns), "max": max(ns)}[metric]

        out = store.aggregate(ag.AggregateRequest(query=word, by=by, metric=metric, field=field, numeric=[f"hours>{above}"] if above else [], since=since, limit=200))
        assert (out.status, out.records) == ("ok", len(kept))
        assert out.value == pytest.approx(value(kept), abs=2e-6)
        if by:
            groups = {}
            for r in kept:
                combos = [""]
                for n, d in enumerate(by.split(",")):
                    combos = [f"{c} · {k}" if n else k for c in combos for k in keys(r, d)]
                for c in combos:
                    groups.setdefault(c, []).append(r)
            assert {r.key: (r.records, pytest.approx(r.value, abs=2e-6)) for r in out.rows} == {k: (len(v), value(v)) for k, v in groups.items()}


def test_formats(spark, tmp_path):
    def docs(path, **kw):
        return [json.loads(r["doc"]) for r in readers.read(spark, readers.discover([str(path)], **kw)).where("doc is not null").orderBy("src_no", "line").collect()]

    (tmp_path / "a.csv").write_bytes("﻿Id;Name;name;\nA;caf".encode() + b"\xe9;x;y;more\n;;;\n  ;B;;\n")
    assert docs(tmp_path / "a.csv") == [{"Id": "A", "Name": "café", "name_2": "x", "column_4": "y", "column_5": "more"}, {"Name": "B"}]
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": 1}\n\n[]\n{"id": 2}\n')
    assert docs(tmp_path / "b.jsonl.gz") == [{"id": 1}, {"id": 2}]
    (tmp_path / "c.json").write_text('{"meta": 1, "data": {"rows": [{"id": 1}, {"id": 2}, {"id": 3}]}}')
    assert len(docs(tmp_path / "c.json")) == 3
    (tmp_path / "d.json").write_text('{"u1": {"n": 1}, "u2": {"n": 2}}')
    assert docs(tmp_path / "d.json") == [{"_key": "u1", "n": 1}, {"_key": "u2", "n": 2}]
    (tmp_path / "e.json").write_text('[["a", "b"], [1, null], [2, 3, 4]]')
    assert docs(tmp_path / "e.json") == [{"a": 1}, {"a": 2, "b": 3, "column_3": 4}]
    (tmp_path / "f.jsonl").write_text('{\n  "id": 7\n}\n')
    assert docs(tmp_path / "f.jsonl") == [{"id": 7}]
    with sqlite3.connect(tmp_path / "g.sqlite") as db:
        db.execute("CREATE TABLE t (id INTEGER, ctx TEXT, x REAL, b BLOB)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", [(1, '{"m": "/var"}', 1.5, b"z"), (2, "{broken", None, None)])
        db.execute("CREATE VIEW v AS SELECT id FROM t")
    assert [s.table for s in readers.discover([str(tmp_path / "g.sqlite")])] == ["t", "v"]
    assert docs(str(tmp_path / "g.sqlite") + "#t") == [{"id": 1, "ctx": {"m": "/var"}, "x": 1.5}, {"id": 2, "ctx": "{broken"}]
    assert docs(tmp_path / "g.sqlite", sql="SELECT id FROM t WHERE id > 1") == [{"id": 2}]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / ".hidden.csv").write_text("a\n1\n")
    (tmp_path / "sub" / "x.csv").write_text("a|b\n1|2\n")
    assert docs(tmp_path / "sub") == [{"a": "1", "b": "2"}]
    with pytest.raises(readers.NoSource):
        readers.discover([str(tmp_path / "none")])
    assert readers.delimiter_of('"a,b";c,d;e') == ";"


def test_lines_are_numbered_across_splits(spark, tmp_path):
    (tmp_path / "long.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(20_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = readers.read(spark, readers.discover([str(tmp_path / "long.jsonl")])).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["line"], json.loads(r["doc"])["n"]) for r in rows) == [(i + 1, i) for i in range(20_000)]


def test_inference(spark, tmp_path):
    rnd = random.Random(1)
    rows = [{"id": f"W{i}", "asset": {"id": f"A{i % 40}", "name": f"Machine {i % 40}"}, "status": rnd.choice(["open", "closed"]), "opened": f"2024-0{1 + i % 9}-11", "summary": f"Replaced the seal number {i} on the line", "plan": {"id": f"P{i % 5}", "name": f"Plan {i % 5}"}, "parts": [{"sku": f"S{i % 9}", "name": f"Part {i % 9}"}]} for i in range(200)]
    (tmp_path / "work_orders.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "assets.json").write_text(json.dumps([{"id": f"A{i}", "name": f"Machine {i}", "hall": str(i % 3)} for i in range(40)]))
    kinds = {p.name: p for p in infer.propose_kinds(spark, readers.discover([str(tmp_path)]))}
    w = kinds["work_orders"].fields
    assert (w.id, w.group, w.group_name, w.date, w.title) == ("id", "asset.id", "asset.name", ["opened"], ["summary"])
    assert {"status", "plan.name", "parts[].name"} <= set(w.filters) and not {"plan.id", "parts[].sku"} & set(w.filters)
    a = kinds["assets"].fields
    assert (a.id, a.group, a.group_name) == ("id", "id", "name")
    config = infer.config_of(list(kinds.values()))
    assert {k.name for k in config.kinds} == {"work_orders", "assets"}
    index = Index(spark, str(tmp_path / "index"))
    report = index.build(readers.discover([str(tmp_path / "work_orders.jsonl"), str(tmp_path / "assets.json")]), config)
    assert report.kinds == {"work_orders": 200, "assets": 40}
    out = Store(index).aggregate(ag.AggregateRequest(filters=[("_kind", "assets")], by="group", limit=3))
    assert out.records == 40 and out.rows[0].name.startswith("Machine")
    assert "[[kinds]]" in infer.to_toml(config, list(kinds.values()))


def test_config_is_checked(tmp_path):
    for bad in ({"fields": {"group_name": "x"}}, {"fields": {"nope": 1}}, {"rank": {"title_weight": -1}}, {"memory": {"budget": 1}}, {"kinds": [{"name": "A b"}, {"name": "a_B"}]}, {"rank": {"boost": [{"field": "x", "weight": -2}]}}):
        with pytest.raises(cf.BadConfig):
            cf.from_dict(bad)
    (tmp_path / "c.toml").write_text('[source]\npaths = ["a.csv"]\n[fields]\ntitle = "t"\n')
    c = cf.load(str(tmp_path / "c.toml"))
    assert c.fields.title == ["t"] and c.source.paths == [str(tmp_path / "a.csv")]


def test_text_helpers():
    q = tx.Query.parse('login -sso "leading zeros" -"two words" "open')
    assert (q.words, q.phrases, q.excluded) == (["login", "open"], ["leading zeros"], ["sso", "two words"])
    assert tx.dice("umbrela", "umbrella inc") == pytest.approx(0.75)
    assert tx.truncate("abcdef", 4) == "abc…" and tx.sentences("One. Two v1.2! x") == ["One.", "Two v1.2!", "x"]
    assert ag.where_pairs({"a": ["x", 1]}) == [("a", "x"), ("a", "1")] and ag.where_pairs(["a=x"]) == [("a", "x")]
    assert ag.comma_list("a, b,") == ["a", "b"] and ag.as_bool("True") and not ag.as_bool("0")
