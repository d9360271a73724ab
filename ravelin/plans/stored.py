"""Queries answered by a stored index: its postings, groups and records are written once for each data folder and session.

The index lies in the shared folder that the session names for checkpoints. Every table it holds covers all records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.operators import postings, rank
from ravelin.plans import engine
from ravelin.plans.engine import T_, W2, W3, bm25_sql, page_sql
from ravelin.session import ensure_checkpoint_dir

QUERIES: dict = {}
SQL: dict[str, str] = {}
_BUILT: dict[tuple[str, str], str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def build(spark: SparkSession, d: str) -> str:
    """Write the tables of the index; returns their folder."""
    ensure_checkpoint_dir(spark)
    number = len(_BUILT)
    at = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{number}"
    rows = engine.indexed(spark, d)
    narrow = rows.select("seq", "id", "grp", "date", F.col("boost").cast("double").alias("boost"), "facets", "n_toks")
    narrow.write.mode("overwrite").parquet(f"{at}/records")
    postings.write(rows, f"{at}/postings")
    _BUILT[spark.sparkContext.applicationId, d] = at
    return at


def tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(records, postings)."""
    at = _BUILT.get((spark.sparkContext.applicationId, d)) or build(spark, d)
    return spark.read.parquet(f"{at}/records"), spark.read.parquet(f"{at}/postings")


@register(f"WITH {T_}, e AS (SELECT seq, unnest(list_concat(tt, bt, nt)) AS term FROM t) SELECT term, count(DISTINCT seq) AS df, count(*) AS cf FROM e GROUP BY term")
def index_postings_build(spark: SparkSession, d: str) -> DataFrame:
    """Builds the index anew, and tells of each term how many records have it and how often it stands in them."""
    at = build(spark, d)
    p = spark.read.parquet(f"{at}/postings")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.size("at_title") + F.size("at_body") + F.size("at_names")).alias("cf"))


def hits(spark: SparkSession, d: str, questions: list[postings.Question], **kw) -> tuple[DataFrame, DataFrame]:
    records, table = tables(spark, d)
    r = records.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n_toks"), F.lit(0.0)).alias("len")).first()
    return postings.scored(table, records, questions, r["n"], r["len"], **kw), records


_LINE = "' ' || array_to_string({0}, ' ') || ' '"
_PHRASE = lambda p: "(" + " OR ".join(f"contains({_LINE.format(c)}, ' {p} ')" for c in ("tt", "bt", "nt")) + ")"


def _ask(spark: SparkSession, d: str, text: str, key: str | None = None, scope: str = "all", *, limit: int, offset: int = 0, newest: bool = False, **kw) -> DataFrame:
    found, records = hits(spark, d, [postings.Question(tx.Query.parse(text), key, scope)], **kw)
    page = postings.pages(found, limit, offset, newest)
    return page.join(records.select("seq", "id"), "seq").select("id", "seq", F.round("relevance", 6).alias("relevance"))


@register("WITH " + bm25_sql(["export", "screen", "filter"], W3) + page_sql(20))
def search_bm25(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "the export screen filter", limit=20)


@register("WITH " + bm25_sql(["sensor", "pump", "harrow"], W2, "grp = 'C-HARROW'") + page_sql(10))
def search_scoped_group(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "sensor pump harrow", "C-HARROW", "group", limit=10)


@register(f"WITH {T_} SELECT id, seq FROM t WHERE {_PHRASE('missing licence')} AND NOT (list_contains(tt, 'belt') OR list_contains(bt, 'belt') OR list_contains(nt, 'belt'))")
def search_phrase_exclude(spark: SparkSession, d: str) -> DataFrame:
    found, records = hits(spark, d, [postings.Question(tx.Query.parse('"missing licence" -belt'))])
    return found.select("seq").join(records.select("seq", "id"), "seq").select("id", "seq")


@register("WITH " + bm25_sql(["valve", "seal"], W3, "grp IS NULL OR grp <> 'C-HARROW'") + page_sql(10))
def search_others_scope(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "valve seal", "C-HARROW", "others", limit=10)


@register("WITH " + bm25_sql(["report"], W3) + ", first AS (SELECT * FROM scored ORDER BY score DESC, seq LIMIT 100) SELECT id, seq, round(score, 6) AS score, boost FROM first")
def search_first_stage(spark: SparkSession, d: str) -> DataFrame:
    found, records = hits(spark, d, [postings.Question(tx.Query.parse("report"))])
    first = found.orderBy(F.desc("score"), F.asc("seq")).limit(max(rank.OVERFETCH * 10, rank.LEAST_FETCH))
    return first.join(records.select("seq", "id"), "seq").select("id", "seq", F.round("score", 6).alias("score"), "boost")


@register("WITH " + bm25_sql(["report", "closed"], W3) + page_sql(10))
def search_boost_rerank(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "report closed", limit=10)


@register("WITH " + bm25_sql(["calendar"], W3) + " SELECT id, seq, round(score * boost, 6) AS relevance FROM scored ORDER BY date DESC NULLS LAST, seq DESC LIMIT 10")
def search_newest_sort(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "calendar", limit=10, newest=True)


@register("WITH " + bm25_sql(["valve", "technician"], {"title": 6.0, "body": 1.0, "names": 0.5}) + page_sql(10, 5))
def search_title_weight(spark: SparkSession, d: str) -> DataFrame:
    return _ask(spark, d, "valve technician", limit=10, offset=5, title_weight=6.0)


@register("WITH " + bm25_sql(["filter", "pump"], W3, "coalesce(date >= '2023-11' AND substr(date, 1, 7) <= '2024-03', false)") + page_sql(15))
def search_within_dates(spark: SparkSession, d: str) -> DataFrame:
    """Words, and bounds of the date."""
    from ravelin.operators import aggregate as ag

    return _ask(spark, d, "filter pump", limit=15, where=ag.date_range("2023-11", "2024-03"))


@register(f"WITH {bm25_sql(['printer'], W3)} SELECT count(*) AS total FROM scored")
def search_total(spark: SparkSession, d: str) -> DataFrame:
    """The number of matches, given beside a page."""
    found, _ = hits(spark, d, [postings.Question(tx.Query.parse("printer"))])
    return found.agg(F.count(F.lit(1)).alias("total"))


@register("WITH " + bm25_sql(["übersicht"], W3, "(SELECT count(*) FROM t WHERE grp = 'C-NOBODY' AND (list_contains(tt, 'übersicht') OR list_contains(bt, 'übersicht'))) = 0 AND (grp IS NULL OR grp <> 'C-NOBODY')") + page_sql(5))
def search_fallback_other_groups(spark: SparkSession, d: str) -> DataFrame:
    """A group where nothing matches: the rows come from the others."""
    ask = lambda questions: hits(spark, d, questions)[0]
    page = postings.answered(ask, [postings.Question(tx.Query.parse("Übersicht"), "C-NOBODY", "group")], 5)
    return page.join(tables(spark, d)[0].select("seq", "id"), "seq").select("id", "seq", F.round("relevance", 6).alias("relevance"))


#: Pairs of words that make the questions of the batch.
BATCH_WORDS = ("printer belt valve seal filter pump sensor screen report calendar export technician licence motor cable").split()
BATCH = [f"{a} {b}" for i, a in enumerate(BATCH_WORDS) for b in BATCH_WORDS[i + 1 :]] + [f"{a} {b} {c}" for a, b, c in zip(BATCH_WORDS * 7, BATCH_WORDS[1:] * 7, BATCH_WORDS[2:] * 7, strict=False)]
BATCH = BATCH[:200]
_LIST = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(BATCH)) + ") AS v(q, text)"


@register(f"""WITH {T_}, qs AS (SELECT q, unnest(list_distinct(string_split(text, ' '))) AS term FROM {_LIST}), c AS (SELECT count(*) AS n, avg(n_toks) AS len_ FROM t),
    w AS (SELECT DISTINCT term FROM qs),
    h AS (SELECT w.term, t.seq, t.date, t.boost, t.n_toks, len(list_filter(tt, lambda x: x = w.term)) * 2.0 + len(list_filter(bt, lambda x: x = w.term)) + len(list_filter(nt, lambda x: x = w.term)) * 0.5 AS f
          FROM t JOIN w ON list_contains(tt, w.term) OR list_contains(bt, w.term) OR list_contains(nt, w.term)),
    df AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    s AS (SELECT qs.q, h.seq, h.date, h.boost, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n_toks / len_))) AS score
          FROM qs JOIN h USING (term) JOIN df USING (term), c GROUP BY qs.q, h.seq, h.date, h.boost),
    one AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, seq) AS i FROM s),
    two AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score * boost DESC, date DESC NULLS LAST, seq) AS rank FROM one WHERE i <= 100)
    SELECT q, CAST(rank AS INT) AS rank, seq, round(score * boost, 6) AS relevance FROM two WHERE rank <= 5""")
def search_batch(spark: SparkSession, d: str) -> DataFrame:
    """200 questions in one job, five rows each."""
    found, _ = hits(spark, d, [postings.Question(tx.Query.parse(t)) for t in BATCH])
    return postings.pages(found, 5).select("q", "rank", "seq", F.round("relevance", 6).alias("relevance"))
