"""Ranked search over a stored posting list, for one question or many at once.

A posting is (term, seq) with the places of the term in title, body and names. The table is range-partitioned and sorted
by (term, seq), so that a search reads only the row groups of its terms, and a term that stands in most records is
split over many files. Phrases are places that follow each other, exclusions an anti join, statistics come from the postings
themselves and two numbers of the whole index. A batch is one job: its questions are a local table of terms, and each
question keeps its best rows by a window with a group limit, which cuts before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravelin.functions import text as tx
from ravelin.operators import rank
from ravelin.session import cut

COLUMNS = ("title", "body", "names")
TERMS = "q int, t int, off int, size int, barred boolean, term string"


@dataclass(frozen=True)
class Question:
    """``key``: the group searched in (``scope`` group) or left out (``others``)."""

    query: tx.Query
    key: str | None = None
    scope: str = "all"

    @property
    def columns(self) -> tuple[str, ...]:
        return COLUMNS[:2] if self.scope == "group" else COLUMNS


def posting_table(records: DataFrame) -> DataFrame:
    """(term, seq, n_toks, at_title, at_body, at_names): one row for each term of a record, with its places."""

    def marked(c: str) -> Column:
        return F.transform(f"{c}_toks", lambda t, i: F.struct(t.alias("term"), F.lit(c).alias("c"), i.alias("i")))

    each = records.select("seq", "n_toks", F.inline(F.concat(*map(marked, COLUMNS))))
    at = [F.sort_array(F.collect_list(F.when(F.col("c") == c, F.col("i")))).alias(f"at_{c}") for c in COLUMNS]
    return each.groupBy("term", "seq", "n_toks").agg(*at)


def write(records: DataFrame, path: str) -> None:
    """Store the postings of tokenised records."""
    posting_table(records).repartitionByRange("term", "seq").sortWithinPartitions("term", "seq").write.mode("overwrite").parquet(path)


def _terms(questions: list[Question], forms) -> list[tuple]:
    out = []
    for q, question in enumerate(questions):
        lists = [(False, t) for t in question.query.positive()] + [(True, t) for t in question.query.negative()]
        for t, (barred, words) in enumerate((b, w) for b, w in lists if w):
            out += [(q, t, off, len(words), barred, forms(w)) for off, w in enumerate(words)]
    return out


def term_counts(postings: DataFrame, questions: list[Question], forms=lambda t: t) -> DataFrame:
    """(q, t, barred, seq, n_toks, f_title, f_body, f_names): how often each term or phrase of each question stands in each record."""
    rows = _terms(questions, forms)
    wanted = postings.sparkSession.createDataFrame(rows, TERMS)
    hits = postings.where(F.col("term").isin(sorted({r[-1] for r in rows}))).join(F.broadcast(wanted), "term")
    head = ["q", "t", "barred", "seq", "n_toks"]
    single = hits.where("size = 1").select(*head, *[F.size(f"at_{c}").alias(f"f_{c}") for c in COLUMNS])
    moved = [F.transform(f"at_{c}", lambda p: p - F.col("off")).alias(f"at_{c}") for c in COLUMNS]
    # at most as many arrays as the phrase has words
    whole = hits.where("size > 1").select(*head, "size", *moved).groupBy(*head, "size").agg(*[F.collect_list(f"at_{c}").alias(f"l_{c}") for c in COLUMNS]).where(F.size("l_title") == F.col("size"))
    both = lambda c: F.size(F.aggregate(f"l_{c}", F.element_at(f"l_{c}", 1), F.array_intersect))
    return single.unionByName(whole.select(*head, *[both(c).alias(f"f_{c}") for c in COLUMNS]))


def scored(postings: DataFrame, records: DataFrame, questions: list[Question], n: int, mean_length: float, *, title_weight: float = 2.0, forms=lambda t: t, where: Column | None = None) -> DataFrame:
    """(q, seq, score, grp, date, boost): the records that match each question, BM25 over the question's columns.

    ``n`` and ``mean_length`` are those of the whole index. ``records`` are read for the columns (seq, grp, date, boost) and
    those of ``where``, which holds for all questions. Questions without a positive word match nothing.
    """
    spark = postings.sparkSession
    if not any(question.query.positive() for question in questions):
        return spark.createDataFrame([], "q int, seq bigint, score double, grp string, date string, boost double")
    weights = {"title": title_weight, "body": rank.BODY_WEIGHT, "names": rank.NAMES_WEIGHT}
    asked = spark.createDataFrame([(i, question.key, question.scope, "names" in question.columns) for i, question in enumerate(questions)], "q int, key string, scope string, named boolean")
    counts = term_counts(postings, questions, forms).join(F.broadcast(asked.select("q", "named")), "q")
    inside = F.col("f_title") + F.col("f_body") > 0
    seen = counts.where(~F.col("barred") & (inside | F.col("named") & (F.col("f_names") > 0)))
    df = seen.groupBy("q", "t").agg(F.count(F.lit(1)).alias("df"))  # a row for each term asked for
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(rank.LEAST_IDF))
    f = weights["title"] * F.col("f_title") + weights["body"] * F.col("f_body") + F.when(F.col("named"), weights["names"] * F.col("f_names")).otherwise(0.0)
    norm = rank.K1 * (1 - rank.B + rank.B * F.col("n_toks") / (mean_length or 1.0))
    hits = seen.join(F.broadcast(df), ["q", "t"]).withColumn("s", idf * f * (rank.K1 + 1) / (f + norm)).groupBy("q", "seq").agg(F.sum("s").alias("score"))
    if any(question.query.negative() for question in questions):
        hits = hits.join(counts.where(F.col("barred") & (inside | (F.col("f_names") > 0))).select("q", "seq"), ["q", "seq"], "left_anti")
    rows = (records if where is None else records.where(where)).select("seq", "grp", "date", "boost")
    hits = hits.join(rows, "seq").join(F.broadcast(asked.select("q", "key", "scope")), "q")
    ok = F.when(F.col("scope") == "group", F.coalesce(F.col("grp") == F.col("key"), F.lit(False))).when(F.col("scope") == "others", F.col("grp").isNull() | (F.col("grp") != F.col("key"))).otherwise(True)
    return hits.where(ok).select("q", "seq", "score", "grp", "date", "boost")


def pages(hits: DataFrame, limit: int, offset: int = 0, newest: bool = False) -> DataFrame:
    """(q, rank, seq, relevance): the page of each question, by ``rank.two_stage``'s two stages."""
    relevance = (F.col("score") * F.col("boost")).alias("relevance")
    if newest:
        order = [F.desc_nulls_last("date"), F.desc("seq")]
    else:
        first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc("seq")))
        hits = hits.withColumn("_n", first).where(F.col("_n") <= max(rank.OVERFETCH * (offset + limit), rank.LEAST_FETCH)).drop("_n")
        order = [F.desc("relevance"), F.desc_nulls_last("date"), F.asc("seq")]
    page = hits.select("q", "seq", "date", relevance).withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
    return page.where(F.col("rank").between(offset + 1, offset + limit)).select("q", "rank", "seq", "relevance")


def answered(ask: Callable[[list[Question]], DataFrame], questions: list[Question], limit: int) -> DataFrame:
    """(q, rank, seq, relevance, other_group): the pages of the questions; one that finds nothing in its group is asked of the others, and marked.

    ``ask`` gives the scored hits of questions. There are at most two jobs, whatever the number of questions.
    """
    page = cut(pages(ask(questions), limit).withColumn("other_group", F.lit(False)))  # at most `limit` rows for each question
    found = {r["q"] for r in page.select("q").distinct().collect()} if any(x.scope == "group" for x in questions) else set()
    left = [i for i, x in enumerate(questions) if x.scope == "group" and i not in found]
    if not left:
        return page
    again = pages(ask([replace(questions[i], scope="others") for i in left]), limit)
    number = F.element_at(F.array(*map(F.lit, left)), F.col("q") + 1)
    return page.unionByName(again.withColumn("q", number).withColumn("other_group", F.lit(True)))
