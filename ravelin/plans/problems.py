"""Queries of the general data-preparation problems (p1, p2, p5); those on training text are in ravelin.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.operators import nested, skew, timestamps


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.time_faults(*(_table(spark, sf_dir, t) for t in ("tickets", "records", "sources")))


def p1_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.instants(*(_table(spark, sf_dir, t) for t in ("tickets", "records", "sources")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.comment_rows(_table(spark, sf_dir, "tickets"), _table(spark, sf_dir, "raw_tickets"))


def p2_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat comment table itself: keys, links and texts."""
    typed, raw = nested.ticket_tables(_table(spark, sf_dir, "tickets"), _table(spark, sf_dir, "raw_tickets"))
    a = typed.select(F.lit("tickets").alias("tbl"), F.col("row_key").alias("row_no"), "node", "parent", "customer_id", "author", "text")
    author = F.coalesce(F.col("cols")["author"], F.col("cols")["author.name"], F.col("cols")["author.id"])
    b = raw.where("tbl = 'comments'").select(F.lit("raw_tickets").alias("tbl"), F.col("row_key").alias("row_no"), "node", "parent", "customer_id", author.alias("author"), F.col("cols")["text"].alias("text"))
    return a.unionByName(b)


def _ticket_parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tickets, raw ones) as (tbl, row_no, ticket_id, customer_id, name): each ticket with its foreign key."""
    t = _table(spark, sf_dir, "tickets")
    blank = lambda c: F.coalesce(nested.stripped(c), F.lit(""))
    typed = t.select(F.lit("tickets").alias("tbl"), F.col("seq").alias("row_no"), "ticket_id", blank(F.col("customer.id")).alias("customer_id"), blank(F.col("customer.name")).alias("name"))
    _, raw = nested.ticket_tables(t, _table(spark, sf_dir, "raw_tickets"))
    cols = F.col("cols")
    own = raw.where("tbl = ''").select(F.lit("raw_tickets").alias("tbl"), F.col("row_key").alias("row_no"), F.coalesce(cols["ticket_id"], cols["id"]).alias("ticket_id"), blank(cols["customer.id"]).alias("customer_id"), blank(cols["customer.name"]).alias("name"))
    return typed, own


def p2_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat ticket table: a row for each ticket of both tables with the key of its customer."""
    typed, own = _ticket_parts(spark, sf_dir)
    return typed.unionByName(own).select("tbl", "row_no", "ticket_id", "customer_id")


def p2_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat customer table: a row for each customer key, the number of its tickets and the least of its names."""
    typed, own = _ticket_parts(spark, sf_dir)
    named = F.when(F.col("name") != "", F.col("name"))
    return typed.unionByName(own).where("customer_id <> ''").groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_tickets"), F.min(named).alias("name"))


def p2_typed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments of the typed tickets, with their links."""
    typed, _ = nested.ticket_tables(_table(spark, sf_dir, "tickets"), _table(spark, sf_dir, "raw_tickets"))
    return typed.select(F.col("row_key").alias("row_no"), "node", "parent", "customer_id", "author", "text")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.wrong_counts(_table(spark, sf_dir, "groups"), _table(spark, sf_dir, "records"))


def p5_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return skew.key_counts(_table(spark, sf_dir, "groups"), _table(spark, sf_dir, "records"))


def p5_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and 0.9-quantile of boost for each grp."""
    return skew.quantiles_per_key(_table(spark, sf_dir, "records").select("grp", "boost"), "grp", "boost", [0.5, 0.9]).select("grp", F.col("n").alias("n_values"), "prob", "value")


def p5_quantiles_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the histograms of values for every key of more than 20 rows, not for the hot ones only."""
    return skew.quantiles_per_key(_table(spark, sf_dir, "records").select("grp", "boost"), "grp", "boost", [0.5, 0.9], direct_rows=20).select("grp", F.col("n").alias("n_values"), "prob", "value")


def p5_hours_refined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the lines' numbers within each source, whose values are all different."""
    return skew.quantiles_per_key(_table(spark, sf_dir, "records").select("src", "line"), "src", "line", [0.1, 0.5, 0.99], direct_rows=0).select("src", F.col("n").alias("n_values"), "prob", "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_instants, p2_found, p2_comments, p2_tickets, p2_customers, p2_typed_comments, p5_found, p5_counts, p5_quantiles, p5_quantiles_refined, p5_hours_refined)}

_COUNTS = "SELECT grp, COUNT(*) AS n_rows, COUNT(DISTINCT id) AS n_ids FROM records WHERE grp IS NOT NULL AND id IS NOT NULL GROUP BY grp"
SQL: dict[str, str] = {
    "p5_found": f"WITH c AS ({_COUNTS}) SELECT DISTINCT g.key FROM groups g LEFT JOIN c ON g.key = c.grp WHERE g.key IS NOT NULL AND g.record_count IS DISTINCT FROM COALESCE(c.n_ids, 0)",
    "p5_counts": f"WITH c AS ({_COUNTS}), k AS (SELECT DISTINCT key FROM groups WHERE key IS NOT NULL) SELECT k.key, CAST(COALESCE(c.n_rows, 0) AS BIGINT) AS n_rows, CAST(COALESCE(c.n_ids, 0) AS BIGINT) AS n_ids FROM k LEFT JOIN c ON k.key = c.grp",
    "p5_quantiles": """
        WITH r AS (SELECT grp, boost, COUNT(*) OVER (PARTITION BY grp) AS n, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY boost) AS i
                   FROM records WHERE grp IS NOT NULL AND boost IS NOT NULL),
             p AS (SELECT CAST(0.5 AS DOUBLE) AS prob UNION ALL SELECT CAST(0.9 AS DOUBLE))
        SELECT r.grp, r.n AS n_values, p.prob, r.boost AS value FROM r JOIN p ON r.i = GREATEST(1, CAST(CEIL(p.prob * r.n) AS BIGINT))""",
}
SQL["p5_quantiles_refined"] = SQL["p5_quantiles"]
SQL["p5_hours_refined"] = """
    WITH r AS (SELECT src, line, COUNT(*) OVER (PARTITION BY src) AS n, ROW_NUMBER() OVER (PARTITION BY src ORDER BY line) AS i
               FROM records WHERE src IS NOT NULL AND line IS NOT NULL),
         p AS (SELECT CAST(0.1 AS DOUBLE) AS prob UNION ALL SELECT CAST(0.5 AS DOUBLE) UNION ALL SELECT CAST(0.99 AS DOUBLE))
    SELECT r.src, r.n AS n_values, p.prob, CAST(r.line AS DOUBLE) AS value FROM r JOIN p ON r.i = GREATEST(1, CAST(CEIL(p.prob * r.n) AS BIGINT))"""
_BLANK = r"regexp_matches(coalesce({0}, ''), '[^\s\p{{Z}}\x{{85}}]')"
SQL["p2_typed_comments"] = rf"""
    WITH c AS (SELECT seq AS row_no, regexp_replace(coalesce(customer.id, ''), '^(\s|\p{{Z}}|\x{{85}})+|(\s|\p{{Z}}|\x{{85}})+$', '', 'g') AS customer_id,
                      list_filter(coalesce(comments, []), lambda x: x IS NOT NULL AND ({_BLANK.format('x.author')} OR {_BLANK.format('x.text')})) AS cs FROM tickets),
         e AS (SELECT row_no, customer_id, unnest(cs) AS x, generate_subscripts(cs, 1) AS node FROM c)
    SELECT row_no, CAST(node AS INT) AS node, 0 AS parent, customer_id, x.author AS author, x.text AS text FROM e"""
