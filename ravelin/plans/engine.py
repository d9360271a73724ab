"""The registered queries of the engine's own operators, each with an independent SQL form of the same result.

All of them read whole tables. A limit stands only where it is the feature: a page, a top list, a candidate cap.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.functions.dates import date_column
from ravelin.operators import aggregate as ag
from ravelin.operators import guard, index, memory, postings, rank
from ravelin.operators import infer as inf
from ravelin.operators.mapping import VALUE_CHARS, numbers_at, scalars_at
from ravelin.operators.resolve import resolve, resolve_all
from ravelin.operators.store import page_of, scope_filter

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-02-01T00:00:00Z"
FACETS = ["_kind", "kind", "site", "status", "priority", "channel", "tags[]"]


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def records(spark: SparkSession, d: str) -> DataFrame:
    """The records with dates in sortable form where they are recognised."""
    return table(spark, d, "records").withColumn("date", F.coalesce(date_column(F.col("date")), "date"))


def indexed(spark: SparkSession, d: str) -> DataFrame:
    return index.tokenized(records(spark, d).withColumn("names", F.concat_ws("\n", "grp", "grp_name")))


# SQL fragments

_T = "trim(date)"
_PART = lambda p, i: f"try_cast(regexp_extract({_T}, '{p}', {i}) AS INT)"
_ISO = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2}))?(?:[.,]\d+)?\s*(?:Z|[+-]\d{2}:?\d{2}|UTC)?)?$"
_US = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})(?:[ T,]+(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([AaPp][Mm])?)?$"


def _form(y: str, mo: str, d: str, h: str, mi: str, s: str) -> str:
    return (
        f"CASE WHEN {mo} BETWEEN 1 AND 12 AND {d} BETWEEN 1 AND 31 AND {y} >= 1000 THEN printf('%04d-%02d-%02d', {y}, {mo}, {d}) || "
        f"CASE WHEN {h} < 24 AND {mi} < 60 THEN printf('T%02d:%02d:%02d', {h}, {mi}, least(coalesce({s}, 0), 59)) ELSE '' END END"
    )


_Y = f"CASE WHEN {_PART(_US, 3)} >= 100 THEN {_PART(_US, 3)} WHEN {_PART(_US, 3)} < 70 THEN {_PART(_US, 3)} + 2000 ELSE {_PART(_US, 3)} + 1900 END"
_HALF = f"lower(regexp_extract({_T}, '{_US}', 7))"
_H = f"CASE WHEN {_HALF} = '' THEN {_PART(_US, 4)} ELSE {_PART(_US, 4)} % 12 + CASE WHEN {_HALF} = 'pm' THEN 12 ELSE 0 END END"
_N = f"try_cast({_T} AS BIGINT)"
DATE_SQL = (
    f"CASE WHEN regexp_matches({_T}, '{_ISO}') THEN {_form(*(_PART(_ISO, i) for i in range(1, 7)))} "
    f"WHEN regexp_matches({_T}, '{_US}') THEN {_form(_Y, _PART(_US, 1), _PART(_US, 2), _H, _PART(_US, 5), _PART(_US, 6))} "
    f"WHEN regexp_matches({_T}, '^[0-9]{{9,13}}$') THEN strftime(make_timestamp(CASE WHEN length({_T}) = 13 THEN {_N} // 1000 ELSE {_N} END * 1000000), '%Y-%m-%dT%H:%M:%S') END"
)
R = f"r AS (SELECT * EXCLUDE (date), coalesce({DATE_SQL}, date) AS date, concat_ws(chr(10), grp, grp_name) AS names FROM records)"
_TOK = lambda c: f"coalesce(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}]+'), [])"
T_ = f"{R}, t0 AS (SELECT *, {_TOK('title')} AS tt, {_TOK('body')} AS bt, {_TOK('names')} AS nt FROM r), t AS (SELECT *, len(tt) + len(bt) + len(nt) + coalesce(len(facets), 0) + (CASE WHEN grp IS NULL THEN 0 ELSE 1 END) AS n_toks FROM t0)"
NUM = lambda x: f"CASE WHEN regexp_matches(replace(trim({x}), ',', ''), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$') THEN try_cast(replace(trim({x}), ',', '') AS DOUBLE) END"
HOURS = NUM("json_extract_string(doc, '$.hours')")
LABOR = f"list_filter(list_transform(coalesce(json_extract_string(doc, '$.labor[*].h'), []), lambda x: {NUM('x')}), lambda x: x IS NOT NULL)"
FACET = lambda f: f"list_transform(list_filter(coalesce(facets, []), lambda x: x.field = '{f}'), lambda x: x.value)"
HAS = lambda f, vs: f"coalesce(len(list_filter(facets, lambda x: x.field = '{f}' AND lower(trim(x.value)) IN ({', '.join(repr(v) for v in vs)}))) > 0, false)"
KEYS = lambda e: f"CASE WHEN len({e}) = 0 THEN [''] ELSE list_distinct({e}) END"
DAY = lambda n: f"substr(coalesce(date, ''), 1, {n})"


def bm25_sql(terms: list[str], weights: dict[str, float], where: str = "true", base: str = T_) -> str:
    """``scored`` with the BM25 score of the matching rows; counts are those of the whole table."""
    col = {"title": "tt", "body": "bt", "names": "nt"}
    hit = lambda t: "(" + " OR ".join(f"list_contains({col[c]}, '{t}')" for c in weights) + ")"
    df = ", ".join(f"sum(CASE WHEN {hit(t)} THEN 1 ELSE 0 END) AS d{i}" for i, t in enumerate(terms))
    parts = []
    for i, t in enumerate(terms):
        f = "(" + " + ".join(f"{w} * len(list_filter({col[c]}, lambda x: x = '{t}'))" for c, w in weights.items()) + ")"
        idf = f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6)"
        parts.append(f"{idf} * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * n_toks / len_))")
    match = " OR ".join(hit(t) for t in terms)
    return f"{base}, c AS (SELECT count(*) AS n, avg(n_toks) AS len_, {df} FROM t), scored AS (SELECT t.*, {' + '.join(parts)} AS score FROM t, c WHERE ({match}) AND ({where}))"


def page_sql(n: int, offset: int = 0) -> str:
    keep = max(10 * (n + offset), 100)
    return f", first AS (SELECT * FROM scored ORDER BY score DESC, seq LIMIT {keep}) SELECT id, seq, round(score * boost, 6) AS relevance FROM first ORDER BY score * boost DESC, date DESC NULLS LAST, seq LIMIT {n} OFFSET {offset}"


def _page(rows: DataFrame) -> DataFrame:
    return rows.select("id", "seq", F.round("relevance", 6).alias("relevance"))


W3 = {"title": 2.0, "body": 1.0, "names": 0.5}
W2 = {"title": 2.0, "body": 1.0}


# aggregation


def _agg(spark: SparkSession, d: str, metric: str, by: str, path: str | None = None, where=None, limit: int | None = None) -> DataFrame:
    base = records(spark, d)
    if where is not None:
        base = base.where(where)
    numbers = ag.numbers_of(path) if path and metric != "distinct" else None
    texts = None
    if metric == "distinct":
        texts = ag.facet_values(path) if path in FACETS else scalars_at(F.col("doc"), path)
    base = ag.folded(base, metric, numbers, texts)
    dims = ag.dimensions(by)
    if not dims:
        return ag.totals(base, metric)
    rows = ag.buckets(base, metric, [ag.dimension(x, FACETS) for x in dims])
    if limit is None:
        return rows
    at = dims.index("group") if "group" in dims else None
    groups = table(spark, d, "groups")
    return ag.top(rows, len(dims), limit, groups, at)


@register("SELECT count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM records")
def agg_count_total(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "")


@register(f"""WITH {R}, b AS (SELECT coalesce(grp, '') AS k1, {DAY(4)} AS k2, count(*) AS records FROM r GROUP BY 1, 2),
    p AS (SELECT k1 || ' · ' || k2 AS key, k1, records, CAST(records AS DOUBLE) AS value FROM b ORDER BY records DESC, key LIMIT 20)
    SELECT p.key, p.records, p.value, g.name FROM p LEFT JOIN groups g ON g.key = p.k1""")
def agg_by_group_year_count(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "group,year", limit=20).drop("keys")


@register(f"WITH {R}, e AS (SELECT {HOURS} AS h, unnest({KEYS(FACET('site'))}) AS k1 FROM r) SELECT k1, count(*) AS records, coalesce(round(sum(h), 6), 0) AS value FROM e GROUP BY k1")
def agg_sum_hours_by_site(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "sum", "site", "hours")


@register(f"WITH {R} SELECT {DAY(7)} AS k1, count(*) AS records, coalesce(round(avg({HOURS}), 6), 0) AS value FROM r GROUP BY 1")
def agg_avg_hours_by_month(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "avg", "month", "hours")


@register(f"WITH {R}, e AS (SELECT {HOURS} AS h, unnest({KEYS(FACET('kind'))}) AS k1 FROM r) SELECT k1, count(*) AS records, coalesce(min(h), 0) AS value FROM e GROUP BY k1")
def agg_min_hours_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "min", "kind", "hours")


@register(f"WITH {R}, e AS (SELECT list_max({LABOR}) AS h, unnest({KEYS(FACET('kind'))}) AS k1 FROM r) SELECT k1, count(*) AS records, coalesce(max(h), 0) AS value FROM e GROUP BY k1")
def agg_max_labor_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "max", "kind", "labor[].h")


@register(f"WITH {R}, e AS (SELECT list_reduce({LABOR}, lambda a, b: a + b, 0.0) AS h, unnest({KEYS(FACET('site'))}) AS k1 FROM r) SELECT k1, count(*) AS records, coalesce(round(sum(h), 6), 0) AS value FROM e GROUP BY k1")
def agg_array_numbers_sum(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "sum", "site", "labor[].h")


@register(f"WITH {R}, e AS (SELECT coalesce(grp, '') AS k1, {FACET('site')} AS s FROM r), x AS (SELECT k1, unnest(s) AS s FROM e) SELECT a.k1, a.records, coalesce(b.value, 0) AS value FROM (SELECT k1, count(*) AS records FROM e GROUP BY k1) a LEFT JOIN (SELECT k1, CAST(count(DISTINCT s) AS DOUBLE) AS value FROM x GROUP BY k1) b ON a.k1 = b.k1")
def agg_distinct_sites_by_group(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "distinct", "group", "site")


@register(f"WITH {R}, x AS (SELECT unnest({FACET('tags[]')}) AS s FROM r) SELECT (SELECT count(*) FROM r) AS records, CAST(count(DISTINCT s) AS DOUBLE) AS value FROM x")
def agg_distinct_tags_total(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "distinct", "", "tags[]")


@register(f"WITH {R}, e AS (SELECT unnest({KEYS(FACET('tags[]'))}) AS k1 FROM r) SELECT k1, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY k1")
def agg_multivalue_tags(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "tags[]")


@register(f"WITH {R}, a AS (SELECT {KEYS(FACET('status'))} AS x, {KEYS(FACET('tags[]'))} AS y FROM r), b AS (SELECT unnest(x) AS k1, y FROM a), e AS (SELECT k1, unnest(y) AS k2 FROM b) SELECT k1, k2, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY k1, k2")
def agg_two_dims_cross(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "status,tags[]")


@register(f"WITH {R}, e AS (SELECT unnest({KEYS(FACET('site'))}) AS k1 FROM r WHERE {HOURS} > 4) SELECT k1, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY k1")
def agg_numeric_condition(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "site", where=ag.Condition.parse("hours>4").column(ag.numbers_of("hours")))


@register(f"WITH {R} SELECT {DAY(4)} AS k1, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM r WHERE len(list_filter({LABOR}, lambda v: v >= 6)) > 0 GROUP BY 1")
def agg_numeric_any(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "year", where=ag.Condition.parse("labor[].h >= 6").column(ag.numbers_of("labor[].h")))


@register(f"WITH {R} SELECT coalesce(grp, '') AS k1, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM r WHERE grp IN (SELECT key FROM groups WHERE contains(' ' || coalesce(name_normalized, '') || ' ', ' rail ') OR starts_with(key_lower, 'rail')) GROUP BY 1")
def agg_group_contains(spark: SparkSession, d: str) -> DataFrame:
    keys = ag.group_contains(table(spark, d, "groups"), "Rail").withColumnRenamed("key", "grp")
    base = records(spark, d).join(keys, "grp", "left_semi")
    return ag.buckets(ag.folded(base, "count", None, None), "count", [ag.dimension("group", FACETS)])


@register(f"WITH {R}, b AS (SELECT site AS key, count(*) AS records FROM (SELECT unnest({KEYS(FACET('site'))}) AS site FROM r) GROUP BY 1) SELECT key, records, CAST(records AS DOUBLE) AS value FROM b ORDER BY records DESC, key LIMIT 3")
def agg_topn_tie_key(spark: SparkSession, d: str) -> DataFrame:
    return _agg(spark, d, "count", "site", limit=3).select("key", "records", "value")


@register(f"WITH {T_} SELECT {DAY(4)} AS k1, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM t WHERE (list_contains(tt, 'filter') OR list_contains(bt, 'filter') OR list_contains(nt, 'filter')) AND NOT (list_contains(tt, 'screen') OR list_contains(bt, 'screen') OR list_contains(nt, 'screen')) GROUP BY 1")
def agg_of_matching_words(spark: SparkSession, d: str) -> DataFrame:
    q = tx.Query.parse("filter -screen")
    cols = ["title", "body", "names"]
    base = indexed(spark, d).where(rank.matches(q.positive(), cols) & ~rank.matches(q.negative(), cols))
    return ag.buckets(ag.folded(base, "count", None, None), "count", [ag.dimension("year", FACETS)])


# filters and browsing


@register(f"WITH {R} SELECT id, seq FROM r WHERE {HAS('status', ['open', 'closed'])} AND {HAS('priority', ['high'])}")
def filter_or_within_and_across(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(ag.facet_filter([("status", "Open"), ("status", "closed "), ("priority", "HIGH")])).select("id", "seq")


@register(f"WITH {R} SELECT id, seq FROM r WHERE coalesce(date >= '2023-11' AND substr(date, 1, 7) <= '2024-03', false)")
def filter_until_precision(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(ag.date_range("2023-11", "2024-03")).select("id", "seq")


@register(f"WITH {R} SELECT id, seq, date FROM r WHERE kind = 'jobs' ORDER BY date DESC NULLS LAST, seq DESC LIMIT 25 OFFSET 10")
def browse_newest_page(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where("kind = 'jobs'").orderBy(F.desc_nulls_last("date"), F.desc("seq")).offset(10).limit(25).select("id", "seq", "date")


@register(f"WITH {R} SELECT id, seq, grp FROM r WHERE grp IS NULL OR grp <> 'C-HARROW'")
def browse_others_scope(spark: SparkSession, d: str) -> DataFrame:
    return records(spark, d).where(scope_filter("others", "C-HARROW")).select("id", "seq", "grp")


# search


_DOCS = f"t0 AS (SELECT doc_id AS seq, grp, CAST(doc_id AS VARCHAR) AS id, 1.0 AS boost, CAST(NULL AS VARCHAR) AS date, [] AS tt, {_TOK('text')} AS bt, [] AS nt FROM documents), t AS (SELECT *, len(bt) AS n_toks FROM t0)"


@register("WITH " + bm25_sql(["pump", "configuration", "hysteresis"], {"body": 1.0}, base=_DOCS) + " SELECT seq AS doc_id, round(score, 6) AS score FROM scored")
def search_documents_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every matching document with its score."""
    docs = table(spark, d, "documents").select("doc_id", tx.token_array(F.col("text")).alias("body_toks")).withColumn("n_toks", F.size("body_toks"))
    terms = [["pump"], ["configuration"], ["hysteresis"]]
    stats = rank.corpus(docs, terms, ["body"])
    return docs.where(rank.matches(terms, ["body"])).select("doc_id", F.round(rank.bm25(terms, stats, {"body": 1.0}), 6).alias("score"))


# groups


def _resolve_sql(tier: str, where: str, n: int = 10) -> str:
    return f"SELECT key, name, record_count AS records, '{tier}' AS match_type, CAST(NULL AS DOUBLE) AS similarity FROM groups WHERE {where} ORDER BY record_count DESC, key LIMIT {n}"


@register(_resolve_sql("case_insensitive", "key_lower = 'c-harrow'"))
def resolve_case_insensitive(spark: SparkSession, d: str) -> DataFrame:
    return resolve(table(spark, d, "groups"), "c-Harrow")


@register(_resolve_sql("name", "name_normalized = 'kelder foods'"))
def resolve_name(spark: SparkSession, d: str) -> DataFrame:
    return resolve(table(spark, d, "groups"), " Kelder   FOODS ")


@register(_resolve_sql("contains", "contains(name_normalized, 'rail') OR contains(key_lower, 'rail')"))
def resolve_contains(spark: SparkSession, d: str) -> DataFrame:
    return resolve(table(spark, d, "groups"), "Rail")


def _dice_sql(c: str, text: str) -> str:
    t = "".join(text.split())
    own = [t[i : i + 2] for i in range(len(t) - 1)]
    s = f"regexp_replace({c}, '\\s+', '', 'g')"
    pairs = f"list_transform(range(1, length({s})), lambda i: substr({s}, i, 2))"
    common = " + ".join(f"least(len(list_filter({pairs}, lambda p: p = '{g}')), {own.count(g)})" for g in dict.fromkeys(own))
    return f"CASE WHEN {s} = '{t}' THEN 1.0 WHEN length({s}) < 2 THEN 0.0 ELSE 2.0 * ({common}) / (length({s}) + {len(t) - 2}) END"


@register(f"WITH s AS (SELECT key, name, record_count AS records, round(greatest(coalesce({_dice_sql('key_lower', 'vantry rial')}, 0), coalesce({_dice_sql('name_normalized', 'vantry rial')}, 0)), 2) AS similarity FROM groups) SELECT key, name, records, 'fuzzy' AS match_type, similarity FROM s WHERE similarity >= 0.6 ORDER BY similarity DESC, records DESC, key LIMIT 10")
def resolve_fuzzy_dice(spark: SparkSession, d: str) -> DataFrame:
    return resolve(table(spark, d, "groups"), "vantry rial")


@register("""WITH q AS (SELECT DISTINCT grp_name AS query FROM records WHERE grp_name IS NOT NULL),
    m AS (SELECT q.query, g.key, 0 AS tier FROM q JOIN groups g ON trim(q.query) = g.key UNION ALL SELECT q.query, g.key, 1 FROM q JOIN groups g ON lower(trim(q.query)) = g.key_lower
          UNION ALL SELECT q.query, g.key, 2 FROM q JOIN groups g ON lower(trim(regexp_replace(q.query, '\\s+', ' ', 'g'))) = g.name_normalized),
    b AS (SELECT *, min(tier) OVER (PARTITION BY query) AS best FROM m)
    SELECT DISTINCT query, key, CASE tier WHEN 0 THEN 'exact' WHEN 1 THEN 'case_insensitive' ELSE 'name' END AS match_type FROM b WHERE tier = best""")
def resolve_batch(spark: SparkSession, d: str) -> DataFrame:
    """Each group name that records use, against the group table."""
    names = table(spark, d, "records").where("grp_name IS NOT NULL").select(F.col("grp_name").alias("query"))
    return resolve_all(table(spark, d, "groups"), names)


# the index's own tables


@register(f"""WITH {R}, w AS (SELECT grp, grp_name, row_number() OVER (PARTITION BY grp ORDER BY coalesce(date, '') DESC, seq DESC) AS i FROM r WHERE grp IS NOT NULL AND grp_name IS NOT NULL)
    SELECT c.grp AS key, w.grp_name AS name, c.n AS record_count FROM (SELECT grp, count(*) AS n FROM r WHERE grp IS NOT NULL GROUP BY grp) c LEFT JOIN w ON w.grp = c.grp AND w.i = 1""")
def group_summary_latest_name(spark: SparkSession, d: str) -> DataFrame:
    return index.group_table(records(spark, d)).select("key", "name", "record_count")


@register("""WITH e AS (SELECT seq, unnest(facets) AS f FROM records), k AS (SELECT f.field AS field, lower(f.value) AS key, f.value AS value, seq FROM e)
    SELECT field, key, count(*) AS count, arg_min(value, (seq, value)) AS value FROM k GROUP BY field, key""")
def facet_counts_ci(spark: SparkSession, d: str) -> DataFrame:
    return index.facet_table(records(spark, d))


@register("""WITH e AS (SELECT seq, unnest(facets) AS f FROM records), k AS (SELECT f.field AS field, lower(f.value) AS key, count(*) AS n FROM e GROUP BY 1, 2),
    w AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, key) AS rn, count(*) OVER (PARTITION BY field) AS n_values FROM k) SELECT field, key, n, rn, n_values FROM w WHERE rn <= 3""")
def describe_topn_per_field(spark: SparkSession, d: str) -> DataFrame:
    f = index.facet_table(records(spark, d)).select("field", "key", F.col("count").alias("n"))
    w = Window.partitionBy("field")
    return f.withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "key"))).withColumn("n_values", F.count(F.lit(1)).over(w)).where("rn <= 3")


@register("SELECT kind, count(*) AS n, count(DISTINCT id) AS n_ids, min(seq) AS first_seq, max(seq) AS last_seq FROM records GROUP BY kind")
def kind_report(spark: SparkSession, d: str) -> DataFrame:
    return index.kind_counts(table(spark, d, "records"))


_LAST = "SELECT *, row_number() OVER (PARTITION BY id ORDER BY {0} DESC) AS rn, min({0}) OVER (PARTITION BY id) AS first FROM {1}"


@register(f"WITH w AS ({_LAST.format('seq', 'records')}) SELECT id, first AS seq, title, src, line FROM w WHERE rn = 1")
def dedupe_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return index.last_wins(table(spark, d, "records"), F.col("seq")).select("id", "seq", "title", "src", "line")


@register("""WITH base AS (SELECT id, min(seq) AS seq, arg_max(title, seq) AS title FROM records WHERE kind = 'tickets' GROUP BY id),
    delta AS (SELECT 'tickets:' || ticket_id AS id, arg_max(coalesce(trim(subject), ''), seq) AS title, max(seq) + 1000000000 AS seq FROM tickets GROUP BY ticket_id),
    up AS (SELECT d.id, coalesce(b.seq, d.seq) AS seq, d.title FROM delta d LEFT JOIN base b ON b.id = d.id),
    all_ AS (SELECT * FROM base WHERE id NOT IN (SELECT id FROM delta) UNION ALL SELECT id, seq, title FROM up)
    SELECT id, seq, title FROM all_ WHERE id NOT IN (SELECT 'tickets:' || ticket_id FROM tickets WHERE lower(trim(status)) = 'closed')""")
def upsert_delete_state(spark: SparkSession, d: str) -> DataFrame:
    """Base, then newer rows that keep the number of the row they replace, then deletes: anti joins and one union."""
    base = index.last_wins(table(spark, d, "records").where("kind = 'tickets'").select("id", "seq", "title"), F.col("seq"))
    t = table(spark, d, "tickets").select(F.concat(F.lit("tickets:"), "ticket_id").alias("id"), "seq", F.coalesce(F.trim("subject"), F.lit("")).alias("title"), F.lower(F.trim("status")).alias("status"))
    newest = index.last_wins(t, F.col("seq")).select("id", "title").join(t.groupBy("id").agg((F.max("seq") + 1_000_000_000).alias("seq")), "id")
    return index.without_ids(index.merged(base, newest), t.where("status = 'closed'").select("id").distinct()).select("id", "seq", "title")


# scalars


@register(f"SELECT seq, {DATE_SQL} AS date FROM records")
def date_normalize_formats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").select("seq", date_column(F.col("date")).alias("date"))


@register("SELECT key, lower(trim(regexp_replace(name, '(\\s|\\p{Z}|\\x{85})+', ' ', 'g'))) AS norm FROM groups")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "groups").select("key", tx.name_key(F.col("name")).alias("norm"))


@register("SELECT seq, CASE WHEN lower(trim(regexp_replace(trim(resolution), '[.!]+$', ''))) NOT IN ('', 'n/a', 'see notes') THEN trim(resolution) END AS resolution FROM tickets")
def placeholder_null(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tickets").select("seq", tx.present(F.col("resolution"), ["n/a", "see notes"]).alias("resolution"))


@register("""SELECT seq, CASE WHEN grp_name IS NULL OR length(grp_name) < 3 THEN title
    WHEN regexp_matches(title, '[^\\x00-\\x7f]') OR regexp_matches(grp_name, '[^\\x00-\\x7f]') THEN replace(title, grp_name, ' ')
    ELSE regexp_replace(title, '(?i)' || regexp_escape(grp_name), ' ', 'g') END AS title FROM records""")
def own_name_removed(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "records")
    return r.select("seq", F.when(F.col("grp_name").isNull(), F.col("title")).otherwise(tx.without(F.col("title"), F.col("grp_name"))).alias("title"))


@register(f"SELECT seq, unnest({LABOR}) AS h FROM records WHERE doc IS NOT NULL")
def json_path_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").where("doc IS NOT NULL").select("seq", F.explode(numbers_at(F.col("doc"), "labor.h")).alias("h"))


@register(f"SELECT seq, substr(trim(json_extract_string(doc, '$.hours')), 1, {VALUE_CHARS}) AS hours FROM records WHERE doc IS NOT NULL AND json_extract_string(doc, '$.hours') IS NOT NULL AND trim(json_extract_string(doc, '$.hours')) <> ''")
def json_path_scalars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "records").where("doc IS NOT NULL").select("seq", F.explode(scalars_at(F.col("doc"), "hours")).alias("hours"))


_WORDSET = r"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}][\p{{L}}\p{{N}}_.-]*'), lambda w: regexp_replace(w, '[._-]+$', '')), lambda w: w <> '' AND w NOT IN ({1})), lambda w: CASE WHEN strlen(w) > 3 AND ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END))"
_STOP = ", ".join(repr(w) for w in sorted(tx.STOPWORDS))


@register(f"WITH w AS (SELECT seq, {_WORDSET.format('title', _STOP)} AS a, {_WORDSET.format('body', _STOP)} AS b FROM records) SELECT seq, round(CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE len(list_intersect(a, b)) / CAST(len(a) + len(b) - len(list_intersect(a, b)) AS DOUBLE) END, 6) AS overlap FROM w")
def jaccard_title_body(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "records").select("seq", tx.word_set_array(F.col("title")).alias("a"), tx.word_set_array(F.col("body")).alias("b"))
    return w.select("seq", F.round(tx.jaccard_of(F.col("a"), F.col("b")), 6).alias("overlap"))


@register("SELECT seq, CASE WHEN length(trim(body)) <= 40 THEN trim(body) ELSE rtrim(substr(trim(body), 1, 39)) || '…' END AS body, CAST(ceil(strlen(body) / 3.0) AS BIGINT) AS tokens FROM tickets WHERE body IS NOT NULL")
def truncate_and_cost(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tickets").where("body IS NOT NULL")
    return t.select("seq", tx.truncated(F.col("body"), 40).alias("body"), F.ceil(F.octet_length("body") / 3).alias("tokens"))


# inference


@register("""WITH k AS (SELECT seq, doc, unnest(json_keys(doc)) AS path FROM records WHERE doc IS NOT NULL),
    v AS (SELECT seq, path, json_type(doc, '$.' || path) AS type, trim(json_extract_string(doc, '$.' || path)) AS text FROM k),
    s AS (SELECT * FROM v WHERE type IN ('VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT', 'BOOLEAN') AND text <> '')
    SELECT path, count(DISTINCT seq) AS present, count(*) AS n_values, count(*) FILTER (type = 'VARCHAR') AS strings, count(DISTINCT text) AS n_distinct, max(length(text)) AS max_chars FROM s GROUP BY path""")
def profile_fields(spark: SparkSession, d: str) -> DataFrame:
    """The top-level scalar fields of the work orders."""
    docs = table(spark, d, "records").where("doc IS NOT NULL").select(F.col("seq").alias("no"), "doc")
    p = inf.profile_table(inf.leaf_rows(docs)).where(~F.col("path").contains("[]") & ~F.col("path").contains("."))
    return p.select("path", "present", F.col("values").alias("n_values"), "strings", F.col("distinct").alias("n_distinct"), "max_chars")


@register("""WITH i AS (SELECT DISTINCT 'customer' AS a, CAST(c_custkey AS VARCHAR) AS v FROM customer UNION ALL SELECT DISTINCT 'orders', CAST(o_orderkey AS VARCHAR) FROM orders),
    g AS (SELECT DISTINCT 'orders' AS b, CAST(o_custkey AS VARCHAR) AS v FROM orders UNION ALL SELECT DISTINCT 'lineitem', CAST(l_orderkey AS VARCHAR) FROM lineitem),
    s AS (SELECT a, b, count(*) AS shared FROM i JOIN g USING (v) WHERE a <> b GROUP BY a, b)
    SELECT s.a, s.b, s.shared, (SELECT count(*) FROM i WHERE i.a = s.a) AS n_ids, (SELECT count(*) FROM g WHERE g.b = s.b) AS n_values FROM s""")
def kind_link_overlap(spark: SparkSession, d: str) -> DataFrame:
    def values(name: str, role: str, c: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("kind"), F.lit(role).alias("role"), F.col(c).cast("string").alias("value")).distinct()

    v = values("customer", "id", "c_custkey").unionByName(values("orders", "id", "o_orderkey")).unionByName(values("orders", "group", "o_custkey")).unionByName(values("lineitem", "group", "l_orderkey"))
    return inf.overlaps(v)


@register("SELECT 'customer' AS kind, CAST(c_custkey AS VARCHAR) AS grp, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'orders', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY 2")
def kind_union_shared_group(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").cast("string").alias("grp"))
    b = table(spark, d, "orders").select(F.lit("orders").alias("kind"), F.col("o_custkey").cast("string").alias("grp"))
    return a.unionByName(b).groupBy("kind", "grp").agg(F.count(F.lit(1)).alias("n"))


# memory


def writes(spark: SparkSession, d: str) -> DataFrame:
    """The events as writes to slots: who, what, and the value's tens as the claim."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select(
        F.lit("default").alias("ns"), F.col("user_id").cast("string").alias("subject_norm"), F.col("event_type").alias("key"), F.lit("fact").alias("kind"),
        F.concat(F.lit("level "), F.floor(F.col("value") / 10).cast("string")).alias("text"), (F.pmod("event_id", F.lit(5)) + 1).cast("int").alias("importance"), at.alias("at"), F.col("event_id").alias("seq"),
    )


_WRITES = "w AS (SELECT CAST(user_id AS VARCHAR) AS subject_norm, event_type AS key, 'level ' || CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS text, CAST(event_id % 5 + 1 AS INT) AS importance, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at_, event_id AS seq FROM events)"
_SLOTS = f"""{_WRITES}, c AS (SELECT *, CASE WHEN lag(text) OVER s IS DISTINCT FROM text THEN 1 ELSE 0 END AS ch FROM w WINDOW s AS (PARTITION BY subject_norm, key ORDER BY at_, seq)),
    v AS (SELECT *, sum(ch) OVER (PARTITION BY subject_norm, key ORDER BY at_, seq ROWS UNBOUNDED PRECEDING) AS version FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY subject_norm, key, version ORDER BY at_, seq) AS i FROM v),
    a AS (SELECT subject_norm, key, CAST(version AS BIGINT) AS version, min(text) AS text, CAST(least(5, max(importance - i) + count(*)) AS INT) AS importance, min(at_) AS valid_from, max(at_) AS updated_at FROM n GROUP BY subject_norm, key, version),
    sv AS (SELECT *, lead(valid_from) OVER (PARTITION BY subject_norm, key ORDER BY version) AS valid_to FROM a)"""


@register(f"WITH {_SLOTS} SELECT * FROM sv")
def slot_supersession(spark: SparkSession, d: str) -> DataFrame:
    return memory.slot_versions(writes(spark, d)).drop("ns", "kind")


@register(f"WITH {_SLOTS} SELECT subject_norm, key, text FROM sv WHERE substr(valid_from, 1, 10) <= '2024-01-15' AND (valid_to IS NULL OR substr(valid_to, 1, 10) > '2024-01-15')")
def as_of_snapshot(spark: SparkSession, d: str) -> DataFrame:
    v = memory.slot_versions(writes(spark, d)).withColumn("deleted_at", F.lit(None).cast("string"))
    return v.where(memory.visible(NOW, as_of="2024-01-15")).select("subject_norm", "key", "text")


def memories(spark: SparkSession, d: str) -> DataFrame:
    """The events as claims of kinds that age differently."""
    kind = F.element_at(F.array(*[F.lit(k) for k in ("event", "task", "note", "fact")]), (F.pmod("event_id", F.lit(4)) + 1).cast("int"))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), kind.alias("kind"), F.col("user_id").cast("string").alias("subject_norm"), (F.pmod("event_id", F.lit(5)) + 1).cast("int").alias("importance"),
        (F.pmod("event_id", F.lit(7)) == 0).alias("pinned"), F.pmod("event_id", F.lit(13)).alias("recall_count"), (F.pmod("event_id", F.lit(11)) / 10.0).cast("double").alias("confidence"), at.alias("updated_at"),
    )


_AGE = "greatest(0, (epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts))) / 864e2)"
_MEM = f"""m AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS subject_norm, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS updated_at,
    floor((0.4e0 * (event_id % 5) / 4e0 + 0.3e0 * (CASE event_id % 4 WHEN 0 THEN pow(0.5e0, {_AGE} / 30) WHEN 1 THEN pow(0.5e0, {_AGE} / 7) WHEN 2 THEN pow(0.5e0, {_AGE} / 90) ELSE 1 END)
    + 0.25e0 * (CASE WHEN event_id % 7 = 0 OR user_id = 17 THEN 1 ELSE 0 END) + 0.05e0 * least(event_id % 13, 10) / 1e1) * greatest(0.1e0, least(1.0, (event_id % 11) / 1e1)) * 1e3 + 5e-1) / 1e3 AS score FROM events)"""


@register(f"WITH {_MEM} SELECT id, score FROM m")
def recency_decay_score(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("id", memory.score(NOW, memory.HALF_LIFE, ["17"], None).alias("score"))


@register(f"WITH {_MEM}, o AS (SELECT id, subject_norm, row_number() OVER (PARTITION BY subject_norm ORDER BY score DESC, updated_at DESC, id) AS rn FROM m) SELECT id, subject_norm, CAST(CASE WHEN rn > 3 THEN 1 ELSE 0 END AS INT) AS turn FROM o")
def briefing_spread(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d).withColumn("score", memory.score(NOW, memory.HALF_LIFE, ["17"], None))
    return memory.spread_order(m).select("id", "subject_norm", "turn")


@register("""WITH RECURSIVE c AS (SELECT key, CAST(ceil(strlen(coalesce(name, key)) / 3.0) AS BIGINT) + 1 AS cost, row_number() OVER (ORDER BY record_count DESC, key) AS i FROM (SELECT * FROM groups ORDER BY record_count DESC, key LIMIT 2000)),
    p AS (SELECT i, key, cost AS used, true AS taken FROM c WHERE i = 1 UNION ALL SELECT c.i, c.key, CASE WHEN p.used + c.cost <= 800 THEN p.used + c.cost ELSE p.used END, p.used + c.cost <= 800 FROM p JOIN c ON c.i = p.i + 1)
    SELECT key FROM p WHERE taken""")
def budget_pack(spark: SparkSession, d: str) -> DataFrame:
    """Names of the largest groups that fit a budget of 800 tokens; candidates are capped as in any recall."""
    top = table(spark, d, "groups").orderBy(F.desc("record_count"), "key").limit(memory.BROWSE_CANDIDATES)
    cost = (F.ceil(F.octet_length(F.coalesce("name", "key")) / 3) + 1).cast("bigint")
    listed = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("record_count")).alias("o"), "key", cost.alias("cost")))).alias("a"))
    taken = memory.pack(F.transform("a", lambda x: x["cost"]), 800)
    return listed.select(F.explode(F.transform(taken, lambda i: F.element_at("a", i + 1)["key"])).alias("key"))


_PORTABLE = ("private key", "AWS access key", "GitHub token", "API key", "Slack token", "Google API key", "Stripe key", "npm token", "crates.io token", "JWT", "credentials in a URL", "password or key assignment")
_SECRETS = " ".join(f"WHEN regexp_matches(text, '{guard.SECRETS[n].replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n in _PORTABLE)
_TOKENS = f"regexp_extract_all(text, '{guard.RANDOM_TOKEN}')"
_ENT = "-list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: (len(x) - len(replace(x, c, ''))) / CAST(len(x) AS DOUBLE) * log2((len(x) - len(replace(x, c, ''))) / CAST(len(x) AS DOUBLE))))"
_RANDOM = f"len(list_filter({_TOKENS}, lambda x: regexp_matches(x, '[a-z]') AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[0-9]') AND {_ENT} > {guard.RANDOM_BITS})) > 0"


@register(f"SELECT doc_id, CASE {_SECRETS} WHEN {_RANDOM} THEN 'high-entropy token' END AS secret FROM documents")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", guard.secret_column(F.col("text")).alias("secret"))


# the flagship: orders as records of their customers


@register("""WITH f AS (SELECT o_custkey, o_totalprice, strftime(o_orderdate, '%Y') AS y FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996' AND strftime(o_orderdate, '%Y-%m') <= '1997-06' AND o_orderpriority IN ('1-URGENT', '2-HIGH')),
    b AS (SELECT CAST(o_custkey AS VARCHAR) || ' · ' || y AS key, o_custkey, count(*) AS records, round(sum(o_totalprice), 2) AS value FROM f GROUP BY 1, 2)
    SELECT b.key, b.records, b.value, c.c_name AS name FROM (SELECT * FROM b ORDER BY value DESC, key LIMIT 20) b LEFT JOIN customer c ON c.c_custkey = b.o_custkey""")
def agg_orders_by_customer_year(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    rows = o.select(F.col("o_custkey").cast("string").alias("grp"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.array(F.col("o_totalprice")).alias("p"))
    base = ag.folded(rows.where(ag.date_range("1996", "1997-06")), "sum", F.col("p"), None)
    b = ag.buckets(base, "sum", [ag.dimension("group", []), ag.dimension("year", [])]).withColumn("value", F.round("value", 2))
    groups = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("name"))
    return ag.top(b, 2, 20, groups, 0).drop("keys")
