"""Slots, near-duplicates, time travel, ranking, packing, exchange; and the streaming forms."""

import json

import pytest
from pyspark.sql import functions as F

from ravelin.config import MemoryConfig
from ravelin.operators import guard, memory
from ravelin.operators.guard import Refused, Remember
from ravelin.operators.memory import Memory, RecallRequest
from ravelin.streaming import maintain


class Clock:
    def __init__(self, now="2026-01-10T00:00:00Z"):
        self.now = now

    def __call__(self):
        return self.now


@pytest.fixture
def store(spark, tmp_path):
    return Memory(spark, str(tmp_path / "m"), MemoryConfig(), Clock())


def test_slots_supersede(store):
    assert store.remember(Remember("Sam uses vim", subject="Sam", key="Editor")).status == "created"
    store.clock.now = "2026-06-01T00:00:00Z"
    out = store.remember(Remember("Sam uses helix", subject="sam", key="editor"))
    assert (out.status, out.memory["subject"], out.replaced["superseded_by"]) == ("replaced", "Sam", out.memory["id"])
    assert store.remember(Remember("helix uses Sam", subject="Sam", key="editor")).status == "duplicate"
    assert len(store.list()) == 1 and [m["text"] for m in store.history("editor", "Sam")] == ["Sam uses vim", "Sam uses helix"]
    seen = lambda at: [m["text"] for m in store.recall(RecallRequest(as_of=at)).results]
    assert seen("2026-03") == ["Sam uses vim"] and seen("2026-06-01") == ["Sam uses helix"] and seen("2025") == []
    s = store.stats()
    assert (s["current"], s["superseded"], s["total"]) == (1, 1, 2)
    assert store.forget(subject="Sam", key="editor")["deleted_at"] and store.list() == []
    with pytest.raises(Refused):
        store.forget(subject="Sam", key="editor")


def test_restated_notes_merge(store):
    first = store.remember(Remember("The loader reads from the north gate every night", importance=3))
    again = store.remember(Remember("the loader reads every night from the north gates"))
    assert (again.status, again.memory["importance"], again.memory["id"]) == ("duplicate", 4, first.memory["id"])
    near = store.remember(Remember("The loader writes to the south gate every night"))
    assert near.status == "created" and [m["id"] for m in near.related] == [first.memory["id"]]


def test_refusals(store):
    for bad in (Remember(""), Remember("x" * 500), Remember("ok", importance=9), Remember("ok", ns="No Spaces!"), Remember("my password is hunter22x"), Remember("ok", aliases=["a"]), Remember("AKIA" + "A" * 16), Remember("ok", expires="soon")):
        with pytest.raises(Refused):
            store.remember(bad)
    assert store.stats()["total"] == 0
    assert guard.secret_kind("deadbeef" * 8) is None and guard.secret_kind("aB3" + "xYz9Qw7LmN2pRt5vKc8d" * 2) == "high-entropy token"


def test_recall_ranks_and_packs(store):
    for i in range(12):
        store.remember(Remember(f"note number {i} about pumps and valves of line {i}", subject=f"S{i % 4}", key=f"k{i}", importance=1 + i % 5))
    store.remember(Remember("the pump of the harbour is blue", subject="Harbour", pinned=True))
    out = store.recall(RecallRequest(query="harbour pump"))
    assert out.results[0]["subject"] == "Harbour" and out.results[0]["state"] == "current"
    out = store.briefing(budget=100)
    assert out.results[0]["pinned"] and out.tokens <= 100 and "did not fit" in out.notes[-1]
    assert store.get(out.results[0]["id"])["recall_count"] == 2
    assert store.recall(RecallRequest(subject="harbor")).subject == "Harbour"
    assert store.recall(RecallRequest(subject="zzz")).status == "unknown_subject"
    assert store.recall(RecallRequest(subject="s")).status == "ambiguous_subject"
    store.remember(Remember("it is painted", subject="Harbour", aliases=["Dock 9"]))
    assert store.recall(RecallRequest(subject="dock 9")).subject == "Harbour"
    store.compact()
    assert store.stats()["current"] == 14


def test_exchange_and_prune(store, spark, tmp_path):
    store.remember(Remember("alpha is one", subject="A", key="v"))
    store.remember(Remember("temporary thing", expires="12h"))
    assert store.export(str(tmp_path / "out")) == 2
    other = Memory(spark, str(tmp_path / "o"), MemoryConfig(), Clock())
    assert other.import_jsonl(str(tmp_path / "out")) == {"created": 2, "skipped": 0}
    assert other.import_jsonl(str(tmp_path / "out")) == {"created": 0, "skipped": 2}
    text = "---\nx: 1\n---\n# Tools\n- [x] use the blue wrench\n1. keep the belt dry\n```\n- no item\n```\n- use the blue wrench\n"
    assert other.import_markdown(text) == {"read": 3, "created": 2, "merged": 1, "skipped": 0}
    store.clock.now = "2026-02-10T00:00:00Z"
    assert len(store.list()) == 1 and store.stats()["expired"] == 1
    assert store.prune(dry_run=True)["expired"] == 1 and store.stats()["total"] == 2
    store.prune()
    assert store.stats()["total"] == 1


def test_batch_versions_match_single_writes(spark, store):
    said = [("a b", 3), ("b a", 2), ("a c", 1), ("a c", 5), ("c a", 1), ("a b", 4)]
    rows = [("default", "s", "k", "fact", t, imp, f"2026-01-{10 + i:02}T00:00:00Z", i) for i, (t, imp) in enumerate(said)]
    for _, _, _, _, t, imp, at, _ in rows:
        store.clock.now = at
        store.remember(Remember(t, subject="S", key="k", importance=imp))
    want = [(m["text"], m["importance"], m["valid_from"], m["valid_to"]) for m in store.history("k", "S")]
    got = memory.slot_versions(spark.createDataFrame(rows, "ns string, subject_norm string, key string, kind string, text string, importance int, at string, seq long")).orderBy("version").collect()
    assert [(r["text"], r["importance"], r["valid_from"], r["valid_to"]) for r in got] == want


def test_pack(spark):
    df = spark.createDataFrame([([9, 3, 4, 2],), ([50, 1],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(memory.pack(F.col("c"), 10)).collect()] == [[0], [0], []]
    assert spark.createDataFrame([([4, 9, 3, 2],)], "c array<int>").select(memory.pack(F.col("c"), 10)).first()[0] == [0, 2, 3]


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("a", "x", "2026-01-01 00:00:00"), ("a", "x", "2026-01-01 00:01:00"), ("a", "y", "2026-01-01 00:02:00"), ("b", "x", "2026-01-01 01:02:00")]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps({"k": k, "v": v, "at": at}) for k, v, at in rows))
    stream = spark.readStream.schema("k string, v string, at timestamp").json(str(tmp_path / "in"))
    batches = []
    maintain.upsert_files(stream, lambda df, epoch: batches.append((epoch, df.count())), str(tmp_path / "c1")).awaitTermination()
    assert batches == [(0, 4)]
    q = maintain.first_of_each(stream, "k", "at").writeStream.format("memory").queryName("firsts").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2
    q = maintain.windowed_counts(stream, "at", "k").writeStream.outputMode("complete").format("memory").queryName("wins").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["k"], r["n"]) for r in spark.table("wins").collect()} == {("a", 3), ("b", 1)}
    q = maintain.slot_stream(stream, "k", "v", "at", 60_000).writeStream.outputMode("append").format("memory").queryName("slots").option("checkpointLocation", str(tmp_path / "c4")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert ("a", "x", "superseded") in {(r["slot"], r["text"], r["reason"]) for r in spark.table("slots").collect()}
