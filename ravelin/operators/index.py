"""Building and keeping an index: versioned Parquet tables behind a pointer file.

``<path>/CURRENT`` names the version; ``<path>/<version>/`` has records (partitioned by kind, sorted by grp and date within
files, so that statistics prune), postings (with places, range-partitioned by term; searches read nothing else of the
texts), groups, facets and meta.json. A build that fails leaves the current version as it is.
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ravelin.config import Config, from_dict
from ravelin.functions import text as tx
from ravelin.functions.stem import stemmed
from ravelin.operators import files, postings
from ravelin.operators.mapping import prepare_rows
from ravelin.sources import readers

SCHEMA_VERSION = "r1"
#: Lines of a source are numbered below this, so (source, line) make one number without sorting.
LINE_BITS = 40
KEEP_VERSIONS = 2
EXAMPLES = 5


class Refused(ValueError):
    """A request that can't be served as it stands."""


@dataclass
class IngestReport:
    built: bool
    records: int = 0
    groups: int = 0
    inserted: int = 0
    updated: int = 0
    deleted: int = 0
    skipped: int = 0
    examples: list[str] = field(default_factory=list)
    kinds: dict[str, int] = field(default_factory=dict)


def tokenized(records: DataFrame, analyzer: str = "plain") -> DataFrame:
    """Adds the token arrays of title, body and names. ``porter`` stems them and takes diacritics off."""
    for c in ("title", "body", "names"):
        t = tx.token_array(F.col(c))
        records = records.withColumn(f"{c}_toks", stemmed(t) if analyzer == "porter" else t)
    n = F.size("title_toks") + F.size("body_toks") + F.size("names_toks") + F.coalesce(F.size("facets"), F.lit(0)) + F.col("grp").isNotNull().cast("int")
    return records.withColumn("n_toks", n)


def last_wins(rows: DataFrame, order: Column, key: str = "id") -> DataFrame:
    """One row for each key: the content of its last row, the number (``seq``) of its first."""
    w = Window.partitionBy(key)
    ranked = rows.withColumn("_o", order).withColumn("_first", F.min("_o").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(F.col("_o").desc())))
    return ranked.where("_rn = 1").withColumn("seq", F.col("_first")).drop("_o", "_first", "_rn")


def group_table(records: DataFrame, former: DataFrame | None = None) -> DataFrame:
    """(key, key_lower, name, name_normalized, record_count): the name is that of the newest record that has one."""
    newest = F.struct(F.coalesce("date", F.lit("")), "seq")
    named = F.max_by("grp_name", F.when(F.col("grp_name").isNotNull(), newest))
    out = records.where(F.col("grp").isNotNull()).groupBy(F.col("grp").alias("key")).agg(named.alias("name"), F.count(F.lit(1)).alias("record_count"))
    if former is not None:
        old = former.select(F.col("key").alias("_k"), F.col("name").alias("_n"))
        out = out.join(old, out["key"] == old["_k"], "left").withColumn("name", F.coalesce("name", "_n")).drop("_k", "_n")
    return out.select("key", F.lower("key").alias("key_lower"), "name", tx.name_key(F.col("name")).alias("name_normalized"), "record_count")


def facet_table(records: DataFrame) -> DataFrame:
    """(field, key, value, count): values that differ in case are one, shown as first seen."""
    each = records.select("seq", F.inline("facets"))
    return each.groupBy("field", F.lower("value").alias("key")).agg(F.min_by("value", F.struct("seq", "value")).alias("value"), F.count(F.lit(1)).alias("count"))


def qualified(records: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """(want, id) of the records meant: an exact id, else the only ``<kind>:<id>``. ``ids``: a list, or a table with the column ``want``."""
    wanted = ids.select("want").distinct() if isinstance(ids, DataFrame) else records.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "want string")
    keys = records.select("id", F.when(F.col("kind").isNotNull() & F.col("id").startswith(F.concat("kind", F.lit(":"))), F.expr("substring(id, length(kind) + 2)")).alias("bare"))
    exact = keys.join(wanted, keys["id"] == wanted["want"]).select("want", "id")
    bare = keys.join(wanted, keys["bare"] == wanted["want"]).join(exact.select(F.col("want").alias("w")), F.col("want") == F.col("w"), "left_anti")
    only = bare.groupBy("want").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).where("n = 1").select("want", "id")
    return exact.unionByName(only)


def merged(current: DataFrame, delta: DataFrame) -> DataFrame:
    """The current rows with those of ``delta`` (one for each id) in place of their own; a replaced row keeps its number."""
    old = current.select("id", F.col("seq").alias("_seq"))
    new = delta.join(old, "id", "left").withColumn("seq", F.coalesce("_seq", "seq")).drop("_seq")
    return current.join(delta.select("id"), "id", "left_anti").unionByName(new)


def without_ids(current: DataFrame, gone: DataFrame) -> DataFrame:
    """The current rows but those whose id is in ``gone``."""
    return current.join(gone.select("id"), "id", "left_anti")


def kind_counts(records: DataFrame) -> DataFrame:
    """(kind, n, n_ids, first_seq, last_seq); the distinct ids are counted in two grouped steps."""
    each = records.groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("lo"), F.max("seq").alias("hi"))
    return each.groupBy("kind").agg(F.sum("n").alias("n"), F.count("id").alias("n_ids"), F.min("lo").alias("first_seq"), F.max("hi").alias("last_seq"))


class Index:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @property
    def version(self) -> str | None:
        return files.read_text(self.spark, f"{self.path}/CURRENT")

    def table(self, name: str) -> DataFrame:
        v = self.version
        if v is None:
            raise Refused(f"there is no index at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{v}/{name}")

    @property
    def meta(self) -> dict:
        text = files.read_text(self.spark, f"{self.path}/{self.version}/meta.json")
        meta = json.loads(text) if text else {}
        if meta.get("schema_version") != SCHEMA_VERSION:
            raise Refused("the index has another version; build it again")
        return meta

    @property
    def config(self) -> Config:
        return from_dict(self.meta["config"])

    def _commit(self, records: DataFrame, config: Config, manifest: str, analyzer: str, former: DataFrame | None) -> dict:
        number = 1 + max([int(v[1:]) for v in files.folders(self.spark, self.path) if v[:1] == "v" and v[1:].isdigit()], default=0)
        version = f"v{number:06}"
        at = f"{self.path}/{version}"
        try:
            records.withColumn("part", F.coalesce("kind", F.lit("_"))).sortWithinPartitions("grp", "date").write.partitionBy("part").parquet(f"{at}/records")
            done = self.spark.read.parquet(f"{at}/records")
            groups = group_table(done, former)
            groups.write.parquet(f"{at}/groups")
            facet_table(done).write.parquet(f"{at}/facets")
            postings.write(done, f"{at}/postings")
            row = done.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"), F.sum("n_toks").alias("toks")).first()
            kinds = {r["kind"]: r["count"] for r in done.groupBy("kind").count().collect() if r["kind"]}
            meta = {"schema_version": SCHEMA_VERSION, "config": config.to_dict(), "manifest": manifest, "analyzer": analyzer, "record_count": row["n"], "group_count": self.spark.read.parquet(f"{at}/groups").count(), "date_min": row["lo"], "date_max": row["hi"], "tokens": row["toks"] or 0, "kinds": kinds, "updated_at": int(time.time())}
            files.write_text(self.spark, f"{at}/meta.json", json.dumps(meta))
        except Exception:
            files.remove(self.spark, at)
            raise
        files.write_text(self.spark, f"{self.path}/CURRENT", version)
        for old in [v for v in files.folders(self.spark, self.path) if v[:1] == "v"][:-KEEP_VERSIONS]:
            files.remove(self.spark, f"{self.path}/{old}")
        return meta

    def _staged(self, sources: list[readers.Source], config: Config, strict: bool) -> tuple[DataFrame, int, list[str]]:
        """Prepared rows, written once so that nothing is parsed twice; how many lines were no use, and some of them."""
        at = f"{self.path}/staged"
        prepare_rows(readers.read(self.spark, sources), config).write.mode("overwrite").parquet(at)
        rows = self.spark.read.parquet(at)
        bad = rows.where(F.col("error").isNotNull())
        skipped = bad.count()
        examples = [f"{r['src']}:{r['line']}: {r['error']}" for r in bad.orderBy("src_no", "line").limit(EXAMPLES).collect()] if skipped else []
        if strict and skipped:
            files.remove(self.spark, at)
            raise Refused(f"{skipped} records can't be used, e.g. {examples[0]}")
        return rows.where(F.col("error").isNull()).drop("error"), skipped, examples

    def build(self, sources: list[readers.Source], config: Config, *, force: bool = False, strict: bool = False, analyzer: str = "plain") -> IngestReport:
        """A new index from all sources; nothing happens if sources and mapping are as they were."""
        config.validate()
        sources = readers.assign_kinds(sources, config.kinds)
        mark = readers.manifest(sources, config.to_dict() | {"analyzer": analyzer})
        if not force and mark and self.version and self.meta["manifest"] == mark:
            meta = self.meta
            return IngestReport(False, meta["record_count"], meta["group_count"], kinds=meta["kinds"])
        rows, skipped, examples = self._staged(sources, config, strict)
        order = F.shiftleft(F.col("src_no").cast("long"), LINE_BITS) + F.col("line")
        kept = last_wins(rows, order)
        meta = self._commit(tokenized(kept, analyzer), config, mark, analyzer, None)
        total = rows.count()
        files.remove(self.spark, f"{self.path}/staged")
        return IngestReport(True, meta["record_count"], meta["group_count"], meta["record_count"], total - meta["record_count"], 0, skipped, examples, meta["kinds"])

    def upsert(self, sources: list[readers.Source], *, kind: str | None = None, strict: bool = False) -> IngestReport:
        """Insert new records and replace those with a known id, which keep their number."""
        meta, config = self.meta, self.config
        if any(not f.id for _, f in config.mappings()):
            raise Refused("upsert needs an id in every mapping")
        if config.kinds and kind is None:
            try:
                sources = readers.assign_kinds(sources, config.kinds)
            except readers.NoSource as e:
                raise Refused(str(e)) from None
        elif kind is not None:
            sources = readers.assign_kinds(sources, [k for k in config.kinds if k.name == kind], forced=kind)
        rows, skipped, examples = self._staged(sources, config, strict)
        current = self.table("records").drop("part")
        top = current.agg(F.max("seq")).first()[0] or 0
        order = F.shiftleft(F.col("src_no").cast("long"), LINE_BITS) + F.col("line") + F.lit(top + 1)
        delta = tokenized(last_wins(rows, order), meta["analyzer"])
        known = delta.select("id").join(current.select("id").withColumn("_old", F.lit(1)), "id", "left")
        counts = known.agg(F.count(F.lit(1)).alias("n"), F.count("_old").alias("u")).first()
        done = self._commit(merged(current, delta), config, "", meta["analyzer"], self.table("groups"))
        files.remove(self.spark, f"{self.path}/staged")
        return IngestReport(True, done["record_count"], done["group_count"], counts["n"] - counts["u"], counts["u"], 0, skipped, examples, done["kinds"])

    def delete(self, ids: list[str] | DataFrame) -> IngestReport:
        meta = self.meta
        current = self.table("records").drop("part")
        gone = qualified(current, ids)
        n = gone.count()
        if not n:
            return IngestReport(False, meta["record_count"], meta["group_count"], kinds=meta["kinds"])
        done = self._commit(without_ids(current, gone), self.config, "", meta["analyzer"], self.table("groups"))
        return IngestReport(True, done["record_count"], done["group_count"], deleted=n, kinds=done["kinds"])
