"""A keyed, versioned store of short claims.

A claim may name a slot (namespace, subject, key): another claim for the slot supersedes it, and the old one stays as
history. Without a key, a near-duplicate is merged into the claim it repeats. Rows are never changed in place: each
write appends a new state of its row, and a read takes the last state of each id, so writers need no lock on readers;
``compact`` folds the states. Batches of keyed writes become versions by windows over their slots, without a loop.
"""

from __future__ import annotations

import json
import re
import secrets
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.config import MemoryConfig
from ravelin.functions import text as tx
from ravelin.functions.dates import format_unix, normalize_bound, parse_unix
from ravelin.operators import files, rank
from ravelin.operators.guard import KINDS, Refused, Remember, check, namespace, parse_kind, secret_column, slot_key
from ravelin.operators.index import qualified
from ravelin.session import cut

SCHEMA = (
    "id string, ns string, kind string, subject string, subject_norm string, key string, text string, tags array<string>, importance int, confidence double, "
    "source string, refs array<string>, pinned boolean, created_at string, updated_at string, valid_from string, valid_to string, superseded_by string, "
    "expires_at string, deleted_at string, recall_count bigint, last_recalled_at string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
HALF_LIFE = {"event": 30.0, "task": 7.0, "note": 90.0}
DUPLICATE, RELATED, SIMILAR = 0.8, 0.3, 20
QUERY_CANDIDATES, BROWSE_CANDIDATES, FLOOR, DAMPED = 400, 2000, 0.5, 0.5
PER_SUBJECT = 3
WEIGHTS = {"text": 1.0, "subject": 2.0, "key": 2.0, "tags": 1.0}
ALPHABET = "0123456789abcdefghjkmnpqrstvwxyz"


@dataclass
class WriteOutcome:
    status: str
    memory: dict
    replaced: dict | None = None
    related: list[dict] = field(default_factory=list)


@dataclass
class RecallRequest:
    query: str = ""
    ns: str | None = None
    subject: str | None = None
    kinds: list[str] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    as_of: str | None = None
    history: bool = False
    budget: int | None = None
    limit: int | None = None
    briefing: bool = False
    with_records: bool = False


@dataclass
class RecallOutcome:
    status: str = "ok"
    subject: str | None = None
    candidates: list[str] = field(default_factory=list)
    total_matches: int = 0
    budget: int = 0
    tokens: int = 0
    results: list[dict] = field(default_factory=list)
    records: list = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def new_id(ms: int | None = None) -> str:
    """Sorts by time: 48 bits of milliseconds, 30 random ones."""
    v = ((int(time.time() * 1000) if ms is None else ms) & (1 << 48) - 1) << 30 | secrets.randbits(30)
    return "m" + "".join(ALPHABET[v >> 5 * i & 31] for i in reversed(range(16)))


def cost_of(line: str) -> int:
    """Tokens of a line, at three bytes each."""
    return -(-len(line.encode()) // 3)


def state_of(m: dict, now: str) -> str:
    return "forgotten" if m["deleted_at"] else "superseded" if m["valid_to"] else "expired" if m["expires_at"] and m["expires_at"] <= now else "current"


def line_of(m: dict, now: str, show_ns: bool = False) -> str:
    """A claim on one line, as readers get it."""
    state = state_of(m, now)
    when = {"superseded": m["valid_to"], "forgotten": m["deleted_at"]}.get(state)
    head = m["kind"] + ("" if state == "current" else f" · {state.upper()}" + (f" {when[:10]}" if when else ""))
    name = " · ".join(x for x in (m["subject"], m["key"]) if x)
    tail = [m["valid_from"][:10], m["source"], "pinned" if m["pinned"] else None, "refs " + ", ".join(m["refs"]) if m["refs"] else None, m["id"]]
    return f"[{head}]{f' {m["ns"]}:' if show_ns else ''}{f' {name}:' if name else ''} {m['text']} ({' · '.join(x for x in tail if x)})"


# operators on DataFrames


def latest(states: DataFrame) -> DataFrame:
    """The last state of each id."""
    return states.groupBy("id").agg(F.max_by(F.struct(*[c for c in COLUMNS if c != "id"]), "wseq").alias("s")).select(*[F.col("id") if c == "id" else F.col(f"s.{c}").alias(c) for c in COLUMNS])


def slot_versions(writes: DataFrame) -> DataFrame:
    """Versions of slots from keyed writes (ns, subject_norm, key, kind, text, importance, at, seq).

    A write that says the same words in the same kind as the one before it only reaffirms it. Gives (ns, subject_norm,
    key, version, kind, text, importance, valid_from, updated_at, valid_to); importance rises by one with each restatement,
    up to 5, and never below a restatement's own.
    """
    slot = ["ns", "subject_norm", "key"]
    w = Window.partitionBy(*slot).orderBy("at", "seq")
    said = writes.withColumn("_words", F.concat_ws(" ", F.array_sort(tx.word_set_array(F.col("text")))))
    change = F.coalesce((F.lag("_words").over(w) != F.col("_words")) | (F.lag("kind").over(w) != F.col("kind")), F.lit(True))
    runs = said.withColumn("version", F.sum(change.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.withColumn("_i", F.row_number().over(Window.partitionBy(*slot, "version").orderBy("at", "seq")))
    order = F.struct("at", "seq")
    each = runs.groupBy(*slot, "version").agg(
        F.min_by("kind", order).alias("kind"), F.min_by("text", order).alias("text"),
        F.least(F.lit(5), F.max(F.col("importance") - F.col("_i")) + F.count(F.lit(1))).cast("int").alias("importance"),
        F.min("at").alias("valid_from"), F.max("at").alias("updated_at"),
    )
    return each.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*slot).orderBy("version")))


def visible(now: str, *, as_of: str | None = None, history: bool = False, since: str | None = None, until: str | None = None) -> Column:
    """Which versions are seen: the current ones, all, or those that held at a point in time (expiry doesn't matter then)."""
    ok = F.lit(True)
    for bound, test in ((since, lambda c, b: c >= b), (until, lambda c, b: c <= b)):
        if bound is not None:
            ok = ok & test(F.substring("valid_from", 1, len(bound)), bound)
    if as_of is not None:
        n = len(as_of)
        cut = lambda c: F.substring(c, 1, n)
        return ok & (cut("valid_from") <= as_of) & (F.col("valid_to").isNull() | (cut("valid_to") > as_of)) & (F.col("deleted_at").isNull() | (cut("deleted_at") > as_of))
    if history:
        return ok
    return ok & F.col("valid_to").isNull() & F.col("deleted_at").isNull() & (F.col("expires_at").isNull() | (F.col("expires_at") > now))


def counts(rows: DataFrame, now: str) -> DataFrame:
    """One row: how many versions there are, and in which state."""
    held, kept = F.col("valid_to").isNull(), F.col("deleted_at").isNull()
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(visible(now)).alias("current"), F.count_if(~kept).alias("forgotten"), F.count_if(~held & kept).alias("superseded"),
        F.count_if(held & kept & (F.col("expires_at") <= now)).alias("expired"), F.max("updated_at").alias("newest"),
    )


def newest(rows: DataFrame, limit: int) -> DataFrame:
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def prunable(now: str, *, forgotten: bool = False, superseded: bool = False) -> Column:
    """Expired versions, and those asked for."""
    out = F.coalesce(F.col("expires_at") <= now, F.lit(False))
    if forgotten:
        out = out | F.col("deleted_at").isNotNull()
    return out | F.col("valid_to").isNotNull() if superseded else out


def cost(line: Column) -> Column:
    """``cost_of`` of a column."""
    return F.ceil(F.octet_length(line) / 3)


def linked(refs: DataFrame, records: DataFrame) -> DataFrame:
    """(refs + the records' columns): references (column ``ref``) to the records they name, whole or by their only bare id."""
    meant = qualified(records, refs.select(F.col("ref").alias("want")))
    return refs.join(meant.withColumnRenamed("id", "_id"), refs["ref"] == meant["want"]).drop("want").join(records, F.col("_id") == records["id"]).drop("_id")


def subjects_of(asked: DataFrame, subjects: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query, norm, how): names asked for (column ``query``) to the subject of that name, else to the one they are an alias of."""
    q = asked.where(F.col("query").isNotNull()).distinct().withColumn("_q", tx.name_key(F.col("query")))
    own = subjects.select(F.col("norm").alias("_own")).where(F.col("_own").isNotNull()).distinct()
    other = aliases.groupBy(F.col("alias").alias("_a")).agg(F.min("norm").alias("_other"))
    out = q.join(own, F.col("_q") == F.col("_own"), "left").join(other, F.col("_q") == F.col("_a"), "left")
    out = out.select("query", F.coalesce("_own", "_other").alias("norm"), F.when(F.col("_own").isNotNull(), "subject").otherwise("alias").alias("how"))
    return out.where(F.col("norm").isNotNull())


def claims_of(text: DataFrame, known: DataFrame, now: str) -> DataFrame:
    """The claims of JSON lines (column ``value``), complete, without known ids, lines that are no claims, and lines with credentials."""
    rows = text.select(F.from_json("value", SCHEMA).alias("m")).select("m.*").where(F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("ns").isNotNull())
    rows = rows.join(known.select("id"), "id", "left_anti").dropDuplicates(["id"]).where(secret_column(F.col("text")).isNull())
    none = F.array().cast("array<string>")
    given = {"kind": F.lit("note"), "tags": none, "refs": none, "importance": F.lit(3), "confidence": F.lit(1.0), "pinned": F.lit(False), "recall_count": F.lit(0).cast("bigint"), "created_at": F.lit(now), "updated_at": F.lit(now), "valid_from": F.lit(now)}
    rows = rows.withColumns({c: F.coalesce(c, v) for c, v in given.items()})
    norm = F.when(F.coalesce("subject_norm", F.lit("")) != "", F.col("subject_norm")).otherwise(F.coalesce(tx.name_key(F.col("subject")), F.lit("")))
    return rows.withColumn("subject_norm", norm).select(*COLUMNS)


def superseded_by(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """The current holders of slots that fresh keyed claims take, closed by them."""
    new = fresh.where(F.col("key").isNotNull() & F.col("valid_to").isNull() & F.col("deleted_at").isNull()).groupBy("ns", "subject_norm", "key").agg(F.max(F.struct("valid_from", "id")).alias("_n"))
    old = current.where(F.col("valid_to").isNull() & F.col("deleted_at").isNull()).join(new, ["ns", "subject_norm", "key"])
    return old.withColumns({"valid_to": F.col("_n.valid_from"), "superseded_by": F.col("_n.id")}).select(*COLUMNS)


def recency(now: str, half_life: dict[str, float]) -> Column:
    """Halves with each half-life of its kind; 1 for kinds without one."""
    age = F.greatest(F.lit(0.0), (F.lit(parse_unix(now)) - F.unix_timestamp(F.replace(F.substring("updated_at", 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp"))) / 86_400.0)
    out = F.lit(1.0)
    for kind, days in half_life.items():
        if days > 0:
            out = F.when(F.col("kind") == kind, F.pow(F.lit(0.5), age / days)).otherwise(out)
    return F.coalesce(out, F.lit(1.0))


def score(now: str, half_life: dict[str, float], pin: list[str], relevance: Column | None) -> Column:
    importance = (F.col("importance") - 1) / 4.0
    pinned = (F.coalesce("pinned", F.lit(False)) | F.col("subject_norm").isin([tx.normalize_name(p) for p in pin])).cast("double")
    used = F.least(F.coalesce("recall_count", F.lit(0)), F.lit(10)) / 10.0
    fresh = recency(now, half_life)
    raw = 0.4 * importance + 0.3 * fresh + 0.25 * pinned + 0.05 * used if relevance is None else 0.6 * relevance + 0.15 * fresh + 0.15 * importance + 0.07 * pinned + 0.03 * used
    return F.floor(raw * F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("confidence"))) * 1000 + 0.5) / 1000


def spread_order(rows: DataFrame, per_subject: int = PER_SUBJECT) -> DataFrame:
    """Adds ``turn``: rows in briefing order, at most a few of a subject before every subject has had its turn."""
    rn = F.row_number().over(Window.partitionBy("subject_norm").orderBy(F.desc("score"), F.desc("updated_at"), F.asc("id")))
    return rows.withColumn("turn", (rn > per_subject).cast("int"))


def pack(costs: Column, budget: int) -> Column:
    """Indices (from 0) of an ordered array of costs that fit: what doesn't is passed over, the first is always taken."""
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<int>").alias("taken"), F.lit(0).alias("i"))
    fits = lambda a, c: (a["used"] + c <= budget) | (F.size(a["taken"]) == 0)
    step = lambda a, c: F.struct(F.when(fits(a, c), a["used"] + c).otherwise(a["used"]).cast("bigint").alias("used"), F.when(fits(a, c), F.concat(a["taken"], F.array(a["i"]))).otherwise(a["taken"]).alias("taken"), (a["i"] + 1).alias("i"))
    return F.aggregate(costs, start, step, lambda a: a["taken"])


def relevance_of(rows: DataFrame, q: tx.Query, corpus_rows: DataFrame) -> DataFrame:
    """(rows + rel): BM25 against the best row, over text, subject, key and tags. Statistics come from all rows."""
    toks = lambda df: df.withColumns({"text_toks": tx.token_array(F.col("text")), "subject_toks": tx.token_array(F.col("subject")), "key_toks": tx.token_array(F.col("key")), "tags_toks": tx.token_array(F.concat_ws(" ", "tags"))})
    length = F.size("text_toks") + F.size("subject_toks") + F.size("key_toks") + F.size("tags_toks")
    terms, barred = [t for t in q.positive() if t], [t for t in q.negative() if t]
    columns = list(WEIGHTS)
    stats = rank.corpus(toks(corpus_rows).withColumn("n_toks", length), terms, columns)
    hits = toks(rows).withColumn("n_toks", length).where(rank.matches(terms, columns))
    if barred:
        hits = hits.where(~rank.matches(barred, columns))
    hits = hits.withColumn("bm", rank.bm25(terms, stats, WEIGHTS)).orderBy(F.desc("bm"), F.asc("id")).limit(QUERY_CANDIDATES)
    best = F.max("bm").over(Window.partitionBy(F.lit(1)))  # at most QUERY_CANDIDATES rows
    return hits.withColumn("rel", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("bm") / best))).drop(*[f"{c}_toks" for c in columns], "n_toks", "bm")


class Memory:
    """The store at a path, for interactive use: each call is a few small jobs."""

    def __init__(self, spark: SparkSession, path: str, config: MemoryConfig | None = None, clock: Callable[[], str] | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or MemoryConfig()
        self.clock = clock or (lambda: format_unix(int(time.time())))
        self.half_life = HALF_LIFE | {parse_kind(k): v for k, v in self.config.half_life.items()}
        self._n = int(time.time() * 1e6)

    # storage

    def _append(self, rows: list[dict], op: str) -> None:
        if rows:
            self._write(self.spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], SCHEMA).coalesce(1), op)

    def _write(self, rows: DataFrame, op: str) -> None:
        """Append a state of each row, in one write whatever their number."""
        self._n += 1
        rows.withColumn("wseq", F.lit(self._n)).withColumn("gone", F.lit(op == "prune")).withColumn("op", F.lit(op)).write.mode("append").parquet(f"{self.path}/{self._states_at()}")

    def states(self) -> DataFrame:
        if not files.exists(self.spark, f"{self.path}/{self._states_at()}"):
            return self.spark.createDataFrame([], SCHEMA + ", wseq bigint, gone boolean, op string")
        return self.spark.read.parquet(f"{self.path}/{self._states_at()}")

    def rows(self) -> DataFrame:
        s = self.states()
        dead = s.where("gone").select("id")
        return latest(s.where("NOT gone").join(dead, "id", "left_anti"))

    def log(self) -> DataFrame:
        """(wseq, op, id): every write in order."""
        return self.states().select("wseq", "op", "id")

    def compact(self) -> None:
        """Fold the states of each id into one."""
        rows = self.rows().withColumn("wseq", F.lit(self._n)).withColumn("gone", F.lit(False)).withColumn("op", F.lit("compact"))
        folded, former = f"states-{self._n}", self._states_at()
        rows.write.parquet(f"{self.path}/{folded}")
        files.write_text(self.spark, f"{self.path}/STATES", folded)  # readers change over at once, and never see an empty store
        files.remove(self.spark, f"{self.path}/{former}")

    def _states_at(self) -> str:
        return files.read_text(self.spark, f"{self.path}/STATES") or "states"

    def _aliases(self) -> DataFrame:
        at = f"{self.path}/aliases"
        schema = "ns string, alias string, norm string, wseq bigint"
        return self.spark.read.parquet(at) if files.exists(self.spark, at) else self.spark.createDataFrame([], schema)

    def _alias(self, ns: str, norm: str) -> str:
        r = self._aliases().where((F.col("ns") == ns) & (F.col("alias") == norm)).orderBy(F.desc("wseq")).select("norm").first()
        return r["norm"] if r else norm

    def subjects(self, namespaces: list[str]) -> dict[str, str]:
        """norm -> first spelling."""
        rows = self.rows().where(F.col("ns").isin(namespaces) & (F.col("subject_norm") != "")).groupBy("subject_norm").agg(F.min_by("subject", F.struct("created_at", "id")).alias("name"))
        return {r["subject_norm"]: r["name"] for r in rows.orderBy("subject_norm").collect()}

    # writes

    def _current(self, ns: str) -> DataFrame:
        return self.rows().where((F.col("ns") == ns) & F.col("valid_to").isNull() & F.col("deleted_at").isNull())

    def _merged(self, old: dict, c: Remember, asked: int | None, now: str) -> dict:
        union = lambda a, b: list(dict.fromkeys([*a, *b]))
        return old | {"importance": max(min(old["importance"] + 1, 5), asked or 0), "pinned": old["pinned"] or c.pinned, "tags": union(old["tags"], c.tags), "refs": union(old["refs"], c.refs), "updated_at": now, "confidence": max(old["confidence"], c.confidence), "expires_at": c.expires or old["expires_at"]}

    def remember(self, req: Remember) -> WriteOutcome:
        now = self.clock()
        c = check(req, self.config.namespace, self.config.max_chars, parse_unix(now) or 0)
        norm = self._alias(c.ns, tx.normalize_name(c.subject)) if c.subject else ""
        current = self._current(c.ns)
        if c.subject:
            c = replace(c, subject=self.subjects([c.ns]).get(norm, c.subject))
        if wanted := [a for x in c.aliases if (a := tx.normalize_name(x)) != norm]:
            self._n += 1
            self.spark.createDataFrame([(c.ns, a, norm, self._n) for a in wanted], "ns string, alias string, norm string, wseq bigint").write.mode("append").parquet(f"{self.path}/aliases")
        fresh = {"id": new_id(), "ns": c.ns, "kind": c.kind, "subject": c.subject, "subject_norm": norm, "key": c.key, "text": c.text, "tags": c.tags, "importance": c.importance, "confidence": float(c.confidence), "source": c.source, "refs": c.refs, "pinned": c.pinned, "created_at": now, "updated_at": now, "valid_from": now, "valid_to": None, "superseded_by": None, "expires_at": c.expires, "deleted_at": None, "recall_count": 0, "last_recalled_at": None}
        words = tx.word_set(c.text)
        if c.key:
            held = current.where((F.col("subject_norm") == norm) & (F.col("key") == c.key)).first()
            if held is None:
                self._append([fresh], "remember")
                return WriteOutcome("created", fresh)
            old = held.asDict()
            if tx.word_set(old["text"]) == words and old["kind"] == c.kind:
                merged = self._merged(old, c, req.importance, now)
                self._append([merged], "merge")
                return WriteOutcome("duplicate", merged)
            old |= {"valid_to": now, "superseded_by": fresh["id"]}
            self._append([old, fresh], "supersede")
            return WriteOutcome("replaced", fresh, old)
        pool = current.where(F.col("subject_norm") == norm) if c.subject else current
        q = tx.Query(words=list(dict.fromkeys(tx.query_words(c.text))))
        near = [] if q.empty else relevance_of(pool, q, self.rows()).orderBy(F.desc("rel")).limit(SIMILAR).collect()
        ranked = sorted(((tx.jaccard(tx.word_set(r["text"]), words), r.asDict()) for r in near), key=lambda x: -x[0])
        if ranked and ranked[0][0] >= DUPLICATE and ranked[0][1]["key"] is None:
            merged = self._merged({k: ranked[0][1][k] for k in COLUMNS}, c, req.importance, now)
            self._append([merged], "merge")
            return WriteOutcome("duplicate", merged)
        self._append([fresh], "remember")
        return WriteOutcome("created", fresh, related=[r for s, r in ranked if s >= RELATED][:3])

    def forget(self, id: str | None = None, *, subject: str | None = None, key: str | None = None, ns: str | None = None) -> dict:
        """Mark as forgotten; the row stays until it is pruned."""
        now, ns = self.clock(), namespace(ns or self.config.namespace)
        if id is not None:
            m = self.get(id)
        elif key is not None:
            norm = self._alias(ns, tx.normalize_name(subject)) if subject else ""
            r = self._current(ns).where((F.col("subject_norm") == norm) & (F.col("key") == slot_key(key))).first()
            m = r and r.asDict()
        else:
            raise Refused("give an id, or a key with its subject")
        if m is None:
            raise Refused("there is no such memory")
        if m["deleted_at"]:
            raise Refused("it is forgotten already")
        m |= {"deleted_at": now, "updated_at": now}
        self._append([m], "forget")
        return m

    # reads

    def get(self, id: str) -> dict | None:
        r = self.rows().where(F.col("id") == id).first()
        return r and r.asDict()

    def history(self, key: str, subject: str | None = None, ns: str | None = None) -> list[dict]:
        norm = tx.normalize_name(subject) if subject else ""
        rows = self.rows().where((F.col("ns") == namespace(ns or self.config.namespace)) & (F.col("subject_norm") == norm) & (F.col("key") == slot_key(key)))
        return [r.asDict() for r in rows.orderBy("valid_from", "id").collect()]

    def list(self, *, ns: str | None = None, kinds: tuple[str, ...] = (), history: bool = False, limit: int = 50) -> list[dict]:
        rows = self.rows().where(visible(self.clock(), history=history) & F.col("ns").isin(self._namespaces(ns)))
        if kinds:
            rows = rows.where(F.col("kind").isin([parse_kind(k) for k in kinds]))
        return [r.asDict() for r in newest(rows, min(limit, 10_000)).collect()]

    def stats(self) -> dict:
        now = self.clock()
        current = visible(now)
        rows = self.rows()
        r = counts(rows, now).first().asDict()
        for name, c in (("kinds", "kind"), ("namespaces", "ns")):
            r[name] = {x[c]: x["count"] for x in rows.where(current).groupBy(c).count().collect()}
        r["subjects"] = [(x["subject"], x["n"]) for x in rows.where(current & F.col("subject").isNotNull()).groupBy("subject").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subject").limit(10).collect()]
        return r

    def _namespaces(self, ns: str | None) -> list[str]:
        if ns == "*":
            return [r["ns"] for r in self.rows().select("ns").distinct().collect()]
        return [namespace(n) for n in (ns.split(",") if ns else self.config.read or [self.config.namespace])]

    def _subject(self, namespaces: list[str], raw: str) -> tuple[str, list[str], str | None]:
        """(norm or '', candidates, note)."""
        norm = tx.normalize_name(raw)
        known = self.subjects(namespaces)
        if norm in known:
            return norm, [], None
        for ns in namespaces:
            if (a := self._alias(ns, norm)) != norm and a in known:
                return a, [], None
        near = [n for n in known if n in norm or norm in n] or [n for n in known if tx.dice(n, norm) >= 0.6]
        if len(near) == 1:
            return near[0], [], f"subject {raw!r} matched {known[near[0]]!r}"
        return "", [known[n] for n in near] if near else [known[n] for n in list(known)[:12]], None if near else "unknown"

    def recall(self, req: RecallRequest, store=None) -> RecallOutcome:
        now, names = self.clock(), self._namespaces(req.ns)
        budget = max(50, min(20_000, req.budget or (self.config.briefing_budget if req.briefing else self.config.budget)))
        out = RecallOutcome(budget=budget)
        where = F.col("ns").isin(names)
        if req.subject and req.subject.strip():
            norm, others, note = self._subject(names, req.subject)
            if not norm:
                out.status, out.candidates = ("unknown_subject" if note == "unknown" else "ambiguous_subject"), others
                return out
            out.subject = self.subjects(names)[norm]
            out.notes += [note] if note else []
            where = where & (F.col("subject_norm") == norm)
        if req.kinds:
            where = where & F.col("kind").isin([parse_kind(k) for k in req.kinds])
        bounds = {}
        for name in ("since", "until", "as_of"):
            raw = getattr(req, name)
            if raw and raw.strip():
                bounds[name] = normalize_bound(raw)
                if bounds[name] is None:
                    raise Refused(f"date {raw!r}: YYYY, YYYY-MM or YYYY-MM-DD")
        every = self.rows()
        rows = every.where(where & visible(now, history=req.history, **bounds))
        q = tx.Query.parse(req.query)
        if q.empty:
            rows = rows.orderBy(F.desc("pinned"), F.desc("importance"), F.desc("updated_at")).limit(BROWSE_CANDIDATES)
            scored = rows.withColumn("score", score(now, self.half_life, self.config.pin, None))
        else:
            rows = relevance_of(rows, q, every)
            if out.subject is None:
                plain = F.concat(F.lit(" "), F.array_join(tx.token_array(F.col("subject")), " "), F.lit(" "))
                named = F.when(F.col("subject").isNotNull() & (F.size(tx.token_array(F.col("subject"))) > 0), F.lit(f" {' '.join(tx.tokens(req.query))} ").contains(plain)).otherwise(F.lit(False))
                some = F.max(named).over(Window.partitionBy(F.lit(1)))
                rows = rows.withColumn("_named", named).withColumn("rel", F.when(some & ~F.col("_named"), F.col("rel") * DAMPED).otherwise(F.col("rel"))).drop("_named")
            scored = rows.where(F.col("rel") >= FLOOR).withColumn("score", score(now, self.half_life, self.config.pin, F.col("rel")))
        order = [F.desc("score"), F.desc("updated_at"), F.asc("id")]
        if req.briefing:
            scored, order = spread_order(scored), [F.asc("turn"), *order]
        found = [r.asDict() for r in scored.orderBy(*order).collect()]  # bounded by the candidate caps
        out.total_matches = len(found)
        for m in found:
            if len(out.results) >= max(1, min(req.limit or 50, 200)):
                break
            cost = cost_of(line_of(m, now, len(names) > 1)) + 1
            if out.tokens + cost > budget and out.results:
                continue
            out.tokens += cost
            out.results.append(m | {"state": state_of(m, now)})
        if len(out.results) < len(found):
            out.notes.append(f"{len(found) - len(out.results)} more matched but did not fit")
        if req.with_records:
            if store is None:
                out.notes.append("with_records needs an index")
            else:
                for ref in dict.fromkeys(r for m in out.results for r in m["refs"]):
                    if (c := store.card_by_id(ref)) is not None:
                        cost = cost_of(json.dumps(asdict(c), ensure_ascii=False))
                        if out.tokens + cost > budget:
                            out.notes.append("linked records omitted: budget spent")
                            break
                        out.tokens += cost
                        out.records.append(c)
        if not req.history and not req.as_of and out.results:
            self._append([{k: m[k] for k in COLUMNS} | {"recall_count": m["recall_count"] + 1, "last_recalled_at": now} for m in out.results], "recall")
        return out

    def briefing(self, ns: str | None = None, budget: int | None = None) -> RecallOutcome:
        return self.recall(RecallRequest(ns=ns, budget=budget, briefing=True))

    # exchange

    def export(self, path: str) -> int:
        rows = self.rows()
        rows.write.mode("overwrite").json(path)
        return rows.count()

    def import_jsonl(self, path: str) -> dict[str, int]:
        """Known ids, lines with credentials and lines that aren't claims are skipped; a current value takes its slot."""
        text = self.spark.read.text(path)
        lines = text.where(F.trim("value") != "").count()
        fresh = cut(claims_of(text, self.rows(), self.clock()))  # what is appended below doesn't change it
        n = fresh.count()
        self._write(superseded_by(self.rows(), fresh).unionByName(fresh), "import")
        return {"created": n, "skipped": lines - n}

    def import_markdown(self, text: str, ns: str | None = None) -> dict[str, int]:
        """List items as notes about the heading they stand under; front matter and fenced blocks are left out."""
        counts = {"read": 0, "created": 0, "merged": 0, "skipped": 0}
        for subject, item in markdown_items(text):
            counts["read"] += 1
            try:
                done = self.remember(Remember(item, ns=ns, subject=subject))
                counts["created" if done.status == "created" else "merged"] += 1
            except Refused:
                counts["skipped"] += 1
        return counts

    def prune(self, *, forgotten: bool = False, superseded: bool = False, unused_days: int | None = None, dry_run: bool = False) -> dict[str, int]:
        """Drop expired rows, and those asked for; ``unused_days`` forgets what is minor and was never recalled."""
        now = self.clock()
        rows = cut(self.rows())
        drop = prunable(now, forgotten=forgotten, superseded=superseded)
        counts = {"expired": rows.where(prunable(now)).count(), "forgotten": rows.where(F.col("deleted_at").isNotNull()).count() if forgotten else 0, "superseded": rows.where(F.col("valid_to").isNotNull()).count() if superseded else 0, "unused": 0}
        idle = rows.limit(0)
        if unused_days is not None:
            before = format_unix((parse_unix(now) or 0) - unused_days * 86_400)
            idle = rows.where(visible(now) & ~F.col("pinned") & (F.col("importance") <= 2) & (F.col("recall_count") == 0) & (F.col("updated_at") < before))
            counts["unused"] = idle.count()
        if not dry_run:
            self._write(rows.where(drop), "prune")
            self._write(idle.withColumns({"deleted_at": F.lit(now), "updated_at": F.lit(now)}), "forget")
        return counts


def markdown_items(text: str) -> list[tuple[str | None, str]]:
    """(heading, item) of bullets, numbers and check boxes."""
    lines = text.splitlines()
    if lines and lines[0].strip() == "---":
        end = next((i for i, x in enumerate(lines[1:], 1) if x.strip() == "---"), 0)
        lines = lines[end + 1 :]
    out, heading, fenced = [], None, False
    for x in lines:
        if x.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif fenced:
            continue
        elif m := re.match(r"^#{1,6}\s+(.*?)\s*#*$", x):
            heading = m[1] or None
        elif (m := re.match(r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[[ xX]\]\s+)?(.*\S)\s*$", x)) and m[1]:
            out.append((heading, m[1]))
    return out


KINDS_WITH_DECAY = tuple(k for k in KINDS if k in HALF_LIFE)
