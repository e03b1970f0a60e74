"""Queries of runs: counts as they pass, a committed sink, summaries made once, ids left out by a filter."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.operators import metrics
from postlake.operators import reconcile as R
from postlake.sources import sites, snapshot
from postlake.sources.storage import shared_folder

from . import archive as A
from . import postings as P

CODES = [u[1] for u in rules.UNIVERSITIES]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def observed_run(spark: SparkSession, d: str) -> DataFrame:
    """A run written once, with what it found, kept and took for new of each university, counted as it ran."""
    found, kept, new = (metrics.Counted(n, "university", CODES) for n in ("found", "kept", "new"))
    run = kept.of(R.run(found.of(P.postings(spark, d)), P.previous(spark, d), P.as_of()))
    # New rows are counted beside the others, in a column that only they have.
    run = new.of(run.withColumnRenamed("university", "__u").withColumn("university", F.when(F.col("is_new"), F.col("__u"))))
    run.write.parquet(_folder(spark, "run"))
    return metrics.as_table(spark, "university", found=found, kept=kept, new=new)


def committed_parts(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot, written as parts that are committed together, and read again."""
    path = _folder(spark, "parts")
    snapshot.write_snapshot_parts(P.snapshot(spark, d), path)
    return snapshot.read_snapshot_parts(spark, path, P.as_of()).select("id", F.col("date_added").cast("string").alias("date_added"), "description")


def _never(*_) -> str:
    raise ValueError("called again")


def summaries_once(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of all that is due, and again by a run whose summariser answers no more: all are remembered."""
    memo, rows = _folder(spark, "memo"), P.snapshot(spark, d).select("id", "title", "department", "desc_action", "description")
    R.summarise_once(rows, lambda text, *_: text[:40], memo)
    return R.summarise_once(rows, _never, memo).select("id", "description")


def filtered_pending(spark: SparkSession, d: str) -> DataFrame:
    return R.pending_filtered(R.keep_first(P.postings(spark, d), ["id"], ["ingest_seq"]), P.previous(spark, d), P.as_of()).select("id")


_SNAPSHOT = ("id", "title", "rank", "department", "deadline", "reference", "position_type", "apply_url", "is_new", "date_added", "desc_action", "description")


def full_run(spark: SparkSession, d: str) -> DataFrame:
    """A whole day of all twelve sources, from their archived pages to the snapshot; one source's first way fails in part."""
    pages, details, previous = A.all_archived(spark, d, _folder(spark, "day"))
    out = sites.run_all(pages, details, previous.select("id", "description"), previous, P.as_of())
    return out.select(*(F.col(c).cast("string").alias(c) if c == "date_added" else c for c in _SNAPSHOT))


def full_run_counts(spark: SparkSession, d: str) -> DataFrame:
    """What the same day found and kept of each university, counted as it was written."""
    pages, details, previous = A.all_archived(spark, d, _folder(spark, "day"))
    counted = {n: metrics.Counted(n, "university", CODES) for n in ("found", "kept")}
    sites.run_all(pages, details, previous.select("id", "description"), previous, P.as_of(), counted).write.parquet(_folder(spark, "run"))
    return metrics.as_table(spark, "university", **counted)


def failing_source(spark: SparkSession, d: str) -> DataFrame:
    return A.run_failing(spark, d)


#: Queries whose SQL is that of a query of the registry, by its name.
SAME = {"k1_committed_parts": (committed_parts, "k1_csv_round_trip"), "g1_summarise_once": (summaries_once, "g1_summarise"), "j7_filtered_pending": (filtered_pending, "j7_pending")}
QUERIES = {
    "full_run": (full_run, A.all_sql("SELECT " + ", ".join("CAST(date_added AS VARCHAR) AS date_added" if c == "date_added" else c for c in _SNAPSHOT) + " FROM snap")),
    "full_run_counts": (full_run_counts, A.all_sql("SELECT u.university, coalesce(f.n, 0) AS found, coalesce(k.n, 0) AS kept FROM (VALUES %s) u(source, university) LEFT JOIN (SELECT source, count(*) AS n FROM found GROUP BY source) f ON u.source = f.source LEFT JOIN (SELECT source, count(*) AS n FROM snap GROUP BY source) k ON u.source = k.source" % ", ".join(f"('{u[0]}', '{u[1]}')" for u in rules.UNIVERSITIES))),
    "u7_with_fallback": (failing_source, A.failing_sql()),
    "k3_observed_run": (observed_run, P.sql("SELECT u.university, coalesce(f.n, 0) AS found, coalesce(k.n, 0) AS kept, coalesce(k.m, 0) AS new FROM (VALUES %s) u(university) LEFT JOIN (SELECT university, count(*) AS n FROM p GROUP BY university) f USING (university) LEFT JOIN (SELECT university, count(*) AS n, count(*) FILTER (is_new) AS m FROM snap GROUP BY university) k USING (university)" % ", ".join(f"('{c}')" for c in CODES))),
}
