"""Reading an index: search, browse, resolve, get, describe, aggregate. Requests and outcomes are plain dataclasses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.config import Config
from ravelin.functions import text as tx
from ravelin.functions.dates import normalize_bound
from ravelin.functions.stem import index_form
from ravelin.operators import aggregate as ag
from ravelin.operators import postings, rank
from ravelin.operators.cards import Card, card
from ravelin.operators.index import Index, qualified
from ravelin.operators.mapping import Mapping
from ravelin.operators.resolve import resolve

MAX_LIMIT = 50
OK, AMBIGUOUS, UNKNOWN, BAD = "ok", "ambiguous_group", "unknown_group", "bad_request"


@dataclass
class SearchRequest:
    query: str = ""
    group: str | None = None
    scope: str | None = None
    filters: list[tuple[str, str]] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    sort: str = "relevance"
    limit: int = 5
    offset: int = 0
    fallback: bool = True
    max_chars: int = 300


@dataclass
class GroupMatch:
    key: str
    name: str | None
    records: int
    match_type: str
    similarity: float | None = None


@dataclass
class SearchOutcome:
    status: str = OK
    query: str = ""
    scope: str = "all"
    sort: str = "relevance"
    group: GroupMatch | None = None
    candidates: list[GroupMatch] = field(default_factory=list)
    filters: list[tuple[str, str]] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    total_matches: int = 0
    offset: int = 0
    results: list[Card] = field(default_factory=list)
    other_groups: list[Card] = field(default_factory=list)
    corpus_records: int = 0
    notes: list[str] = field(default_factory=list)


@dataclass
class AggregateRow:
    key: str
    keys: list[str]
    name: str | None
    records: int
    value: float


@dataclass
class AggregateOutcome:
    status: str = OK
    metric: str = "count"
    group: GroupMatch | None = None
    candidates: list[GroupMatch] = field(default_factory=list)
    since: str | None = None
    until: str | None = None
    records: int = 0
    value: float = 0.0
    buckets: int = 0
    rows: list[AggregateRow] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


@dataclass
class FacetSummary:
    field: str
    distinct: int
    top: list[tuple[str, int]]


@dataclass
class Description:
    records: int
    groups: int
    kinds: dict[str, int]
    facets: list[FacetSummary]
    largest_groups: list[GroupMatch]
    date_min: str | None
    date_max: str | None
    example_id: str | None


def scope_filter(scope: str, key: str | None) -> Column:
    if key is None or scope == "all":
        return F.lit(True)
    return F.coalesce(F.col("grp") == key, F.lit(False)) if scope == "group" else F.col("grp").isNull() | (F.col("grp") != key)


def page_of(records: DataFrame, q: tx.Query, *, where: Column, scoped: bool, title_weight: float = 2.0, forms=lambda t: t, newest: bool = False, limit: int = 5, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(matches with their score, the page). Statistics come from all records; inside a group names don't match or count."""
    columns = ["title", "body"] if scoped else ["title", "body", "names"]
    terms = [[forms(x) for x in t] for t in q.positive() if t]
    barred = [[forms(x) for x in t] for t in q.negative() if t]
    weights = {"title": title_weight, "body": rank.BODY_WEIGHT, "names": rank.NAMES_WEIGHT}
    weights = {c: weights[c] for c in columns}
    stats = rank.corpus(records, terms, columns)
    hits = records.where(where & rank.matches(terms, columns))
    if barred:
        hits = hits.where(~rank.matches(barred, ["title", "body", "names"]))
    hits = hits.withColumn("score", rank.bm25(terms, stats, weights))
    return hits, rank.two_stage(hits, limit, offset, newest)


class Store:
    def __init__(self, index: Index):
        self.index = index
        self.meta = index.meta
        self.config: Config = index.config
        self.records = index.table("records")
        self.groups = index.table("groups")
        self.mappings = {k: Mapping(f, self.config.rank, k) for k, f in self.config.mappings()}
        self.forms = index_form if self.meta["analyzer"] == "porter" else (lambda t: t)

    # groups

    def resolve(self, query: str, limit: int = 10) -> list[GroupMatch]:
        if not self.config.has("group"):
            return []
        return [GroupMatch(**r.asDict()) for r in resolve(self.groups, query, limit).collect()]

    def _pick(self, out, group: str) -> bool:
        found = self.resolve(group)
        if len(found) == 1:
            out.group = found[0]
            return True
        out.status, out.candidates = (AMBIGUOUS, found) if found else (UNKNOWN, [])
        out.notes.append(f"{len(found)} groups match {group!r}; ask which one" if found else f"no group matches {group!r}")
        return False

    def _check(self, out, filters, since, until, group) -> bool:
        known = self.config.filter_fields()
        bad = next((f for f, _ in filters if f not in known), None)
        if bad is not None:
            out.notes.append(f"{bad} is no filter field; filterable: {', '.join(known) or 'none'}")
        elif any(b and normalize_bound(b) is None for b in (since, until)):
            out.notes.append("a date must be YYYY, YYYY-MM or YYYY-MM-DD")
        elif (since or until) and not self.config.has("date"):
            out.notes.append("this index has no date field")
        elif group and not self.config.has("group"):
            out.notes.append("this index has no group field")
        else:
            out.since, out.until = (normalize_bound(b) if b else None for b in (since, until))
            return True
        out.status = BAD
        return False

    # search

    def search(self, req: SearchRequest) -> SearchOutcome:
        limit = max(1, min(req.limit, MAX_LIMIT))
        scope = (req.scope or "group") if req.group else "all"
        out = SearchOutcome(query=req.query, scope=scope, sort=req.sort, filters=req.filters, offset=req.offset, corpus_records=self.meta["record_count"])
        if not self._check(out, req.filters, req.since, req.until, req.group) or (req.group and not self._pick(out, req.group)):
            return out
        q = tx.Query.parse(req.query)
        key = out.group.key if out.group else None
        other = ag.facet_filter(req.filters) & ag.date_range(out.since, out.until)
        where = other & scope_filter(scope, key)
        if q.empty:
            if q.excluded:
                out.notes.append("exclusions need at least one positive word; they were ignored")
            elif req.query.strip():
                out.notes.append("the query has no searchable words; listing newest instead")
            hits = self.records.where(where)
            out.total_matches = hits.count()
            rows = hits.orderBy(F.desc_nulls_last("date"), F.desc("seq")).offset(req.offset).limit(limit)
            out.results = self._cards(rows.select("id", "kind", "doc").collect(), [], req)
            return out
        hits = self.hits([postings.Question(q, key, scope)], other)
        out.total_matches = hits.count()
        out.results = self._page(postings.pages(hits, limit, req.offset, req.sort == "newest"), q, req)
        if scope == "group" and not out.results and req.offset == 0 and req.fallback and key is not None:
            out.other_groups = self._page(postings.pages(self.hits([postings.Question(q, key, "others")], other), limit, 0, req.sort == "newest"), q, req)
            for c in out.other_groups:
                c.other_group = True
            if out.other_groups:
                out.notes.append("nothing matched in this group; other_groups come from other groups")
        return out

    def hits(self, questions: list[postings.Question], where: Column | None = None) -> DataFrame:
        """(q, seq, score, grp, date, boost) by the stored postings."""
        n = self.meta["record_count"]
        return postings.scored(self.index.table("postings"), self.records, questions, n, self.meta["tokens"] / n if n else 0.0, title_weight=self.config.rank.title_weight, forms=self.forms, where=where)

    def search_all(self, texts: list[str], keys: list[str | None] | None = None, limit: int = 5, fallback: bool = True) -> DataFrame:
        """(q, rank, seq, relevance, other_group) of many questions in one job, each in the group of its key or in all records.

        Questions that find nothing in their group are looked up in the others, in a second job, and marked.
        """
        keys = keys or [None] * len(texts)
        asked = [postings.Question(tx.Query.parse(t), k, "group" if k is not None else "all") for t, k in zip(texts, keys, strict=True)]
        if fallback:
            return postings.answered(self.hits, asked, limit)
        return postings.pages(self.hits(asked), limit).withColumn("other_group", F.lit(False))

    def _page(self, page: DataFrame, q: tx.Query, req: SearchRequest) -> list[Card]:
        """Documents are read for the page only: its narrow rows are found first, then joined by number."""
        rows = [(r["seq"], r["relevance"]) for r in page.orderBy("rank").select("seq", "relevance").collect()]
        if not rows:
            return []
        docs = {r["seq"]: r for r in self.records.where(F.col("seq").isin([s for s, _ in rows])).select("seq", "id", "kind", "doc").collect()}
        cards = self._cards([docs[s] for s, _ in rows], q.highlight(), req)
        for i, (c, (_, score)) in enumerate(zip(cards, rows, strict=True)):
            c.rank, c.relevance = req.offset + i + 1, round(score, 2)
        return cards

    def _cards(self, rows, highlight, req) -> list[Card]:
        return [card(r["id"], r["doc"], self.mappings[r["kind"] if r["kind"] in self.mappings else None], highlight, req.max_chars) for r in rows]

    def recent(self, **kw) -> SearchOutcome:
        return self.search(SearchRequest(query="", **kw))

    def get(self, key: str) -> str | None:
        """The record as it was read, by its id or its only ``<kind>:<id>``."""
        found = [r["id"] for r in qualified(self.records, [key]).limit(2).collect()]
        return self.records.where(F.col("id") == found[0]).select("doc").first()["doc"] if len(found) == 1 else None

    def card_by_id(self, key: str) -> Card | None:
        found = [r["id"] for r in qualified(self.records, [key]).limit(2).collect()]
        rows = self.records.where(F.col("id") == found[0]).select("id", "kind", "doc").collect() if len(found) == 1 else []
        return self._cards(rows, [], SearchRequest())[0] if rows else None

    # overview

    def describe(self, top: int = 5) -> Description:
        facets = self.index.table("facets")
        w = Window.partitionBy("field").orderBy(F.desc("count"), F.asc("value"))
        rows = facets.withColumn("rn", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("field"))).where(F.col("rn") <= top).orderBy("field", "rn").collect()
        found = {f: FacetSummary(f, 0, []) for f in self.config.filter_fields()}
        for r in rows:
            if r["field"] in found:
                found[r["field"]].distinct = r["n"]
                found[r["field"]].top.append((r["value"], r["count"]))
        largest = self.groups.orderBy(F.desc("record_count"), "key").limit(5).collect()
        newest = self.records.orderBy(F.desc_nulls_last("date"), F.desc("seq")).select("id").first()
        m = self.meta
        return Description(m["record_count"], m["group_count"], m["kinds"], list(found.values()), [GroupMatch(r["key"], r["name"], r["record_count"], "listing") for r in largest], m["date_min"], m["date_max"], newest and newest["id"])

    def aggregate(self, req: ag.AggregateRequest) -> AggregateOutcome:
        out = AggregateOutcome(metric=req.metric)
        try:
            out.metric = metric = ag.metric_of(req.metric, req.field)
            dims = ag.dimensions(req.by)
            conditions = [ag.Condition.parse(c) for c in req.numeric if c.strip()]
            if "group" in dims and not self.config.has("group"):
                raise ag.BadRequest("this index has no group field")
            if set(dims) & {"year", "month", "day"} and not self.config.has("date"):
                raise ag.BadRequest("this index has no date field")
        except ag.BadRequest as e:
            out.status = BAD
            out.notes.append(str(e))
            return out
        if not self._check(out, req.filters, req.since, req.until, req.group) or (req.group and not self._pick(out, req.group)):
            return out
        base = self.records.where(ag.facet_filter(req.filters) & ag.date_range(out.since, out.until))
        if out.group:
            base = base.where(F.col("grp") == out.group.key)
        if req.group_contains and req.group_contains.strip():
            base = base.join(ag.group_contains(self.groups, req.group_contains).withColumnRenamed("key", "grp"), "grp", "left_semi")
        q = tx.Query.parse(req.query)
        if not q.empty:
            columns = ["title", "body"] if out.group else ["title", "body", "names"]
            base = base.where(rank.matches([[self.forms(x) for x in t] for t in q.positive()], columns))
            if q.excluded:
                base = base.where(~rank.matches([[self.forms(x) for x in t] for t in q.negative()], ["title", "body", "names"]))
        for c in conditions:
            base = base.where(c.column(ag.numbers_of(c.field)))
        numbers = ag.numbers_of(req.field) if metric in ("sum", "avg", "min", "max") else None
        texts = ag.scalars_at(F.col("doc"), req.field) if metric == "distinct" else None
        base = ag.folded(base, metric, numbers, texts)
        total = ag.totals(base, metric).first()
        out.records, out.value = total["records"], total["value"] or 0.0
        if dims:
            facets = self.config.filter_fields()
            rows = ag.buckets(base, metric, [ag.dimension(d, facets) for d in dims])
            out.buckets = rows.limit(ag.MAX_BUCKETS + 1).count()
            if out.buckets > ag.MAX_BUCKETS:
                out.status = BAD
                out.notes.append(f"more than {ag.MAX_BUCKETS} buckets; narrow the request")
                return out
            at = dims.index("group") if "group" in dims else None
            page = ag.top(rows, len(dims), req.limit, self.groups, at).orderBy(F.desc("value"), F.asc("key")).collect()
            out.rows = [AggregateRow(r["key"], r["keys"], r["name"], r["records"], r["value"]) for r in page]
            if len(page) == 1 and page[0]["key"] == "":
                out.notes.append(f"no record has a value at {req.by}")
        if metric != "count" and out.records and not out.value and metric != "distinct":
            out.notes.append(f"no number at {req.field}, or they sum to 0")
        return out
