"""Queries of the mapping, the readers, the cards and the memory store, each through the operator's own code.

Tickets are turned into JSON records and mapped as an export of them would be; their SQL forms work on the columns.
"""

from __future__ import annotations

import os
import re
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin import config as cf
from ravelin.functions import text as tx
from ravelin.operators import aggregate as ag
from ravelin.operators import cards, index, memory
from ravelin.operators.mapping import prepare_rows
from ravelin.plans import engine
from ravelin.plans.engine import _SLOTS, DATE_SQL, NOW, R, table
from ravelin.session import ensure_checkpoint_dir
from ravelin.sources import readers

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


CONFIG = cf.from_dict({
    "fields": {"id": "ticket_id", "title": "subject", "text": ["body", "resolution"], "group": "customer.id", "group_name": "customer.name", "date": "created_at",
               "filters": ["status", "priority", "tags[]"], "display": ["status"], "empty_values": ["n/a", "see notes"]},
    "rank": {"boost": [{"field": "resolution", "weight": 0.15}, {"field": "status", "equals": "closed", "weight": 0.03}]},
})
_FIELDS = ("seq", "ticket_id", "subject", "customer", "status", "priority", "tags", "created_at", "body", "resolution")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The tickets as lines of an export."""
    none = F.lit(None).cast("string")
    return table(spark, d, "tickets").select("src", F.lit(0).alias("src_no"), "line", none.alias("kind"), F.to_json(F.struct(*_FIELDS)).alias("doc"), none.alias("error"))


def mapped(spark: SparkSession, d: str) -> DataFrame:
    return prepare_rows(lines(spark, d), CONFIG)


STRIP = lambda x: f"regexp_replace({x}, '^(\\s|\\p{{Z}}|\\x{{85}})+|(\\s|\\p{{Z}}|\\x{{85}})+$', '', 'g')"
KEY = lambda x: f"lower({STRIP(f'''regexp_replace({STRIP(x)}, '[.!]+$', '')''')})"
HELD = lambda x: f"coalesce({KEY(x)} NOT IN ('', 'n/a', 'see notes'), false)"
PRESENT = lambda x: f"CASE WHEN {HELD(x)} THEN {STRIP(x)} END"
_SUBJECT = PRESENT("subject")
_NAMED = f"n AS (SELECT *, {PRESENT('customer.id')} AS g, CASE WHEN {HELD('customer.id')} THEN {PRESENT('customer.name')} END AS gn FROM tickets)"


def _without(x: str, name: str) -> str:
    ascii_ = f"NOT regexp_matches({x}, '[^\\x00-\\x7f]') AND NOT regexp_matches({name}, '[^\\x00-\\x7f]')"
    return f"CASE WHEN {name} IS NULL OR length({name}) < 3 THEN {x} WHEN {ascii_} THEN regexp_replace({x}, '(?i)' || regexp_escape({name}), ' ', 'g') ELSE replace({x}, {name}, ' ') END"


@register(f"SELECT src, line, {PRESENT('ticket_id')} AS id, CASE WHEN NOT {HELD('ticket_id')} THEN 'no id at ticket_id' END AS error FROM tickets")
def map_ids(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).select("src", "line", "id", "error")


@register(f"WITH {_NAMED} SELECT src, line, g AS grp, gn AS grp_name FROM n WHERE {HELD('ticket_id')}")
def map_groups(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).where("error IS NULL").select("src", "line", "grp", "grp_name")


@register(f"WITH {_NAMED}, a AS (SELECT src, line, gn, {_without(f'({_SUBJECT})', 'g')} AS t FROM n WHERE {HELD('ticket_id')}) SELECT src, line, {_without('t', 'gn')} AS title FROM a")
def map_titles(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).where("error IS NULL").select("src", "line", "title")


@register(f"""WITH {_NAMED}, a AS (SELECT src, line, gn, {_without('body', 'g')} AS b, {_without('resolution', 'g')} AS r, {HELD('body')} AS hb, {HELD('resolution')} AS hr FROM n WHERE {HELD('ticket_id')}),
    c AS (SELECT src, line, hb, hr, {_without('b', 'gn')} AS b, {_without('r', 'gn')} AS r FROM a)
    SELECT src, line, CASE WHEN hb AND hr THEN b || chr(10) || r WHEN hb THEN b WHEN hr THEN r ELSE '' END AS body FROM c""")
def map_bodies(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).where("error IS NULL").select("src", "line", "body")


@register(f"SELECT src, line, coalesce({DATE_SQL.replace('trim(date)', STRIP('date'))}, {PRESENT('date')}) AS date FROM (SELECT src, line, ticket_id, CASE WHEN {HELD('created_at')} THEN created_at END AS date FROM tickets) WHERE {HELD('ticket_id')}")
def map_dates(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).where("error IS NULL").select("src", "line", "date")


@register(f"SELECT src, line, CAST(1.0 + CASE WHEN {HELD('resolution')} THEN 0.15 ELSE 0 END + CASE WHEN {HELD('status')} AND lower({STRIP('status')}) = 'closed' THEN 0.03 ELSE 0 END AS DOUBLE) AS boost FROM tickets WHERE {HELD('ticket_id')}")
def map_boosts(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).where("error IS NULL").select("src", "line", F.round("boost", 6).alias("boost"))


@register(f"""WITH e AS (SELECT src, line, 'status' AS field, status AS v, 1 AS i FROM tickets WHERE {HELD('ticket_id')} UNION ALL SELECT src, line, 'priority', priority, 1 FROM tickets WHERE {HELD('ticket_id')}
      UNION ALL SELECT src, line, 'tags[]', unnest(tags), generate_subscripts(tags, 1) FROM tickets WHERE {HELD('ticket_id')}),
    h AS (SELECT src, line, field, i, substr({STRIP('v')}, 1, 200) AS value FROM e WHERE {HELD('v')}),
    o AS (SELECT *, row_number() OVER (PARTITION BY src, line, field, lower(value) ORDER BY i) AS rn FROM h)
    SELECT src, line, field, value FROM o WHERE rn = 1""")
def map_facets(spark: SparkSession, d: str) -> DataFrame:
    return mapped(spark, d).where("error IS NULL").select("src", "line", F.inline("facets"))


@register(f"""WITH t AS (SELECT seq, {PRESENT('subject')} AS s, CASE WHEN {HELD('created_at')} THEN created_at END AS date FROM tickets WHERE {HELD('ticket_id')}),
    q AS (SELECT seq, trim(regexp_replace(s, '(\\s|\\p{{Z}}|\\x{{85}})+', ' ', 'g')) AS s, coalesce({DATE_SQL.replace('trim(date)', STRIP('date'))}, {PRESENT('date')}) AS d FROM t),
    m AS (SELECT seq, s, CASE WHEN length(d) = 19 THEN regexp_replace(d, ':00$', '') ELSE d END AS d FROM q)
    SELECT seq, CASE WHEN length(s) <= 60 THEN s ELSE rtrim(substr(s, 1, 59)) || '…' END AS title, regexp_replace(regexp_replace(d, 'T00:00$', ''), '^([^T]*)T', '\\1 ') AS shown FROM m""")
def card_projection(spark: SparkSession, d: str) -> DataFrame:
    """Cards of all tickets, of 60 characters a field."""
    rows = lines(spark, d).select(F.get_json_object("doc", "$.seq").cast("long").alias("seq"), F.get_json_object("doc", "$.ticket_id").alias("id"), "kind", "doc")
    held = rows.where(tx.present(F.col("id"), ["n/a", "see notes"]).isNotNull())
    return cards.card_table(held, CONFIG, max_chars=60).select("seq", "title", F.col("date").alias("shown"))


@register(f"WITH {R}, e AS (SELECT unnest(CASE WHEN len(coalesce(json_extract_string(doc, '$.labor[*].h'), [])) = 0 THEN [''] ELSE list_distinct(json_extract_string(doc, '$.labor[*].h')) END) AS k1 FROM r) SELECT k1, count(*) AS records, CAST(count(*) AS DOUBLE) AS value FROM e GROUP BY k1")
def agg_by_any_path(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "records")
    return ag.buckets(ag.folded(base, "count", None, None), "count", [ag.dimension("labor[].h", engine.FACETS)])


# ids, references, subjects


@register("""WITH f AS (SELECT DISTINCT ticket_id AS want FROM tickets UNION SELECT DISTINCT id FROM records WHERE kind = 'jobs'), k AS (SELECT DISTINCT id, CASE WHEN starts_with(id, kind || ':') THEN substr(id, length(kind) + 2) END AS bare FROM records),
    x AS (SELECT want, id FROM f JOIN k ON id = want), b AS (SELECT want, count(*) AS n, min(id) AS id FROM f JOIN k ON bare = want WHERE want NOT IN (SELECT want FROM x) GROUP BY want)
    SELECT want, id FROM x UNION ALL SELECT want, id FROM b WHERE n = 1""")
def ids_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Whole ids, and bare ones where only one kind has them."""
    wanted = table(spark, d, "tickets").select(F.col("ticket_id").alias("want")).unionByName(table(spark, d, "records").where("kind = 'jobs'").select(F.col("id").alias("want")))
    return index.qualified(index.last_wins(table(spark, d, "records").select("id", "kind", "seq"), F.col("seq")), wanted)


@register("WITH f AS (SELECT seq, ticket_id AS ref FROM tickets), l AS (SELECT id, min(seq) AS seq FROM records GROUP BY id) SELECT f.seq AS memory, f.ref, l.seq AS record FROM f JOIN l ON l.id = 'tickets:' || f.ref")
def refs_link_join(spark: SparkSession, d: str) -> DataFrame:
    """References of claims to the records they name."""
    refs = table(spark, d, "tickets").select(F.col("seq").alias("memory"), F.col("ticket_id").alias("ref"))
    kept = index.last_wins(table(spark, d, "records").select("id", "kind", "seq"), F.col("seq"))
    return memory.linked(refs, kept).select("memory", "ref", F.col("seq").alias("record"))


_NORM = lambda x: f"lower(trim(regexp_replace({x}, '(\\s|\\p{{Z}}|\\x{{85}})+', ' ', 'g')))"


@register(f"""WITH s AS (SELECT DISTINCT name_normalized AS norm FROM groups WHERE name_normalized IS NOT NULL), a AS (SELECT key_lower AS alias, min(name_normalized) AS norm FROM groups WHERE name_normalized IS NOT NULL GROUP BY key_lower),
    q AS (SELECT DISTINCT grp AS query FROM records WHERE grp IS NOT NULL UNION SELECT DISTINCT grp_name FROM records WHERE grp_name IS NOT NULL)
    SELECT query, coalesce(s.norm, a.norm) AS norm, CASE WHEN s.norm IS NOT NULL THEN 'subject' ELSE 'alias' END AS how FROM q LEFT JOIN s ON s.norm = {_NORM('query')} LEFT JOIN a ON a.alias = {_NORM('query')} WHERE s.norm IS NOT NULL OR a.norm IS NOT NULL""")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Names and aliases to the subject they stand for."""
    g = table(spark, d, "groups").where("name_normalized IS NOT NULL")
    r = table(spark, d, "records")
    asked = r.select(F.col("grp").alias("query")).unionByName(r.select(F.col("grp_name").alias("query")))
    return memory.subjects_of(asked, g.select(F.col("name_normalized").alias("norm")), g.select(F.col("key_lower").alias("alias"), F.col("name_normalized").alias("norm")))


# memory


def versions(spark: SparkSession, d: str) -> DataFrame:
    none = F.lit(None).cast("string")
    v = memory.slot_versions(engine.writes(spark, d))
    return v.withColumns({"id": F.concat_ws("/", "subject_norm", "key", "version"), "deleted_at": none, "expires_at": none})


@register(f"WITH {_SLOTS} SELECT count(*) AS total, count(*) FILTER (valid_to IS NULL) AS current, count(*) FILTER (valid_to IS NOT NULL) AS superseded, CAST(0 AS BIGINT) AS forgotten, CAST(0 AS BIGINT) AS expired, max(updated_at) AS newest FROM sv")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.counts(versions(spark, d), NOW)


@register(f"WITH {_SLOTS} SELECT subject_norm || '/' || key || '/' || version AS id, updated_at, text FROM sv WHERE valid_to IS NULL ORDER BY updated_at DESC, id DESC LIMIT 50")
def memory_newest(spark: SparkSession, d: str) -> DataFrame:
    return memory.newest(versions(spark, d).where(memory.visible(NOW)), 50).select("id", "updated_at", "text")


@register(f"WITH {_SLOTS} SELECT subject_norm, key, CAST(version AS BIGINT) AS version, text, valid_from, valid_to FROM sv WHERE key = 'click'")
def memory_history(spark: SparkSession, d: str) -> DataFrame:
    """Every version of one slot of each subject."""
    return versions(spark, d).where((F.col("key") == "click") & memory.visible(NOW, history=True)).select("subject_norm", "key", "version", "text", "valid_from", "valid_to")


@register(f"WITH {_SLOTS} SELECT subject_norm || '/' || key || '/' || version AS id FROM sv WHERE valid_to IS NOT NULL")
def memory_prunable(spark: SparkSession, d: str) -> DataFrame:
    """What pruning superseded versions would drop."""
    return versions(spark, d).where(memory.prunable(NOW, superseded=True)).select("id")


@register("SELECT 'e' || event_id AS id, event_type AS kind, CAST(user_id AS VARCHAR) AS subject_norm, 3 AS importance FROM events WHERE event_id % 9 <> 0 AND event_id % 5 <> 0")
def memory_import(spark: SparkSession, d: str) -> DataFrame:
    """Claims read from lines, without those already known, lines that aren't claims, and lines with credentials."""
    e = table(spark, d, "events")
    claim = F.struct(F.concat(F.lit("e"), "event_id").alias("id"), F.lit("default").alias("ns"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("subject"), F.concat(F.lit("level "), F.col("event_type")).alias("text"))
    text = e.select(F.when(F.col("event_id") % 9 == 0, F.lit("{not json")).otherwise(F.to_json(claim)).alias("value"))
    known = e.where("event_id % 5 = 0").select(F.concat(F.lit("e"), "event_id").alias("id"))
    return memory.claims_of(text, known, NOW).select("id", "kind", "subject_norm", "importance")


@register("SELECT CAST(a.event_id AS BIGINT) AS event_id, ceil(strlen('level ' || a.event_type || ' of ' || a.user_id) / 3.0)::BIGINT AS cost FROM events a")
def memory_costs(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each claim's line."""
    text = F.concat(F.lit("level "), "event_type", F.lit(" of "), F.col("user_id").cast("string"))
    return table(spark, d, "events").select("event_id", memory.cost(text).alias("cost"))


# sources


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/export-{name}"


def _written(at: str, ending: str) -> list[str]:
    """The files of a folder that Spark wrote."""
    path = re.sub("^file:/+", "/", at)
    return sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(ending))


def _as_sources(paths: list[str], fmt: str) -> list[readers.Source]:
    return readers.discover(paths, fmt)


@register("""WITH v AS (SELECT doc, json_valid(doc) AND json_type(CASE WHEN json_valid(doc) THEN doc ELSE 'null' END) = 'OBJECT' AND CASE WHEN json_valid(doc) THEN doc ELSE 'null' END <> '{}' AS ok FROM raw_tickets)
    SELECT CASE WHEN ok THEN doc END AS doc, ok, count(*) AS n FROM v WHERE doc IS NOT NULL AND trim(doc) <> '' GROUP BY ALL""")
def read_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an export: records, and lines that are none."""
    at = _folder(spark, "jsonl")
    table(spark, d, "raw_tickets").where("doc IS NOT NULL").select("doc").write.mode("overwrite").text(at)
    rows = readers.read(spark, _as_sources(_written(at, ".txt"), "jsonl"))
    return rows.groupBy("doc", F.col("error").isNull().alias("ok")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_type AS type, CAST(p_size AS VARCHAR) AS size FROM part")
def read_delimited(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped files with semicolons, a header with blanks and a repeated name."""
    at = _folder(spark, "csv")
    p = table(spark, d, "part").select(F.col("p_partkey").alias(" id "), F.col("p_name").alias("name"), F.col("p_type").alias("name2"), F.col("p_size").alias("size"))
    p.write.mode("overwrite").option("header", True).option("sep", ";").option("compression", "gzip").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    rows = readers.read(spark, _as_sources(_written(at, ".csv.gz"), "auto"))
    return rows.where("error IS NULL").select(F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.name").alias("name"), F.get_json_object("doc", "$.name2").alias("type"), F.get_json_object("doc", "$.size").alias("size"))


@register("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def read_document(spark: SparkSession, d: str) -> DataFrame:
    """JSON documents that hold their records in an array of an object, one for each nation."""
    at = _folder(spark, "json")
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.struct(F.collect_list(F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))).alias("rows")).alias("data"))).alias("doc"))
    s.repartition(8, "s_nationkey").select("doc").write.mode("overwrite").option("lineSep", "\n").text(at)
    rows = readers.read(spark, _as_sources(_written(at, ".txt"), "json"))
    held = rows.where("error IS NULL").select(F.coalesce(F.from_json(F.get_json_object("doc", "$.data.rows"), "array<struct<id:string,name:string>>"), F.array(F.struct(F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.name").alias("name")))).alias("r"))
    return held.select(F.inline("r"))


@register("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'nation' AS tbl FROM nation UNION ALL SELECT CAST(r_regionkey AS VARCHAR), r_name, 'region' FROM region")
def read_sqlite(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a database file, each a source."""
    at = re.sub("^file:/+", "/", _folder(spark, "sqlite"))
    os.makedirs(at, exist_ok=True)
    path = f"{at}/export.db"
    with sqlite3.connect(path) as db:
        for name, k, n in (("nation", "n_nationkey", "n_name"), ("region", "r_regionkey", "r_name")):
            db.execute(f"DROP TABLE IF EXISTS {name}")
            db.execute(f"CREATE TABLE {name} (id INTEGER, name TEXT)")
            db.executemany(f"INSERT INTO {name} VALUES (?, ?)", [tuple(r) for r in table(spark, d, name).select(k, n).collect()])
    rows = readers.read(spark, readers.discover([path]))
    return rows.select(F.get_json_object("doc", "$.id").alias("id"), F.get_json_object("doc", "$.name").alias("name"), F.element_at(F.split("src", "#"), -1).alias("tbl"))
