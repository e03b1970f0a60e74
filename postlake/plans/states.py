"""Queries of incremental state: expiry by timers, bucketed versions, a manifest, each over batches of all postings."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.functions.text import deadline_date
from postlake.sources.storage import shared_folder
from postlake.streaming import expiry, state

from . import postings as P

_DAY = date.fromisoformat(P.AS_OF)
#: Days before which the rows of a stream's run are seen; the last run has the rest.
PERIODS = ("1996-09-01", "1998-05-01", "2000-01-01")
#: Runs of one posting table by quarter of the year; run k is on day AS_OF + k.
RUNS = 4


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, days as text."""
    return df.select(*(F.col(c).cast("string").alias(c) if dict(df.dtypes)[c] == "date" else c for c in columns))


# --- Expiry by timers -------------------------------------------------------------------


def expiry_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every posting in the order of its days, as a stream that stops after each period and goes on from its checkpoint."""
    at = _folder(spark, "expiry")
    rows = P.postings(spark, d, "orderdate").select("id", F.col("orderdate").cast("date").alias("seen"), F.col("ingest_seq").alias("seq"), deadline_date(F.col("deadline")).alias("deadline"))
    for low, high in zip([None, *PERIODS], [*PERIODS, None], strict=True):
        part = rows.where((F.lit(True) if low is None else F.col("seen") >= low) & (F.lit(True) if high is None else F.col("seen") < high))
        part.write.mode("append").parquet(f"{at}/in")
        expiry.run_expiries(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return _shown(spark.read.parquet(f"{at}/out"), "id", "deadline", "expired_on")


_EXPIRY = """SELECT id, CAST(dd AS VARCHAR) AS deadline, CAST(dd + 14 AS VARCHAR) AS expired_on
    FROM (SELECT *, lead(day) OVER (PARTITION BY id ORDER BY day, ingest_seq) AS next_day
      FROM (SELECT *, row_number() OVER w = 1 OR dd IS DISTINCT FROM lag(dd) OVER w AS armed
        FROM (SELECT p.id, p.ingest_seq, p.dd, CAST(raw.orderdate AS DATE) AS day FROM p JOIN raw ON p.ingest_seq = raw.ingest_seq)
        WINDOW w AS (PARTITION BY id ORDER BY day, ingest_seq)) WHERE armed)
    WHERE dd + 14 < coalesce(next_day, (SELECT max(CAST(orderdate AS DATE)) FROM raw))"""


# --- Versions ---------------------------------------------------------------------------


def _batch(spark: SparkSession, d: str, k: int) -> DataFrame:
    return P.postings(spark, d, "orderdate").where(F.quarter("orderdate") == k + 1).drop("orderdate", "custkey", "title_no")


_VERSION_COLUMNS = ("id", "title", "rank", "deadline", "is_new", "date_added", "desc_action", "description")


def bucketed_runs(spark: SparkSession, d: str) -> DataFrame:
    """Each run's snapshot replaces the last one's; the last of four."""
    folder = _folder(spark, "state")
    for k in range(RUNS):
        state.run(_batch(spark, d, k), state.State(spark, folder), _DAY + timedelta(k), k)
    return _shown(state.State(spark, folder).read(), *_VERSION_COLUMNS)


def versions_stream(spark: SparkSession, d: str) -> DataFrame:
    """A stream of runs that change the last snapshot, with a new base after two changes; the two versions that are kept at the end."""
    at = _folder(spark, "versions")
    for k in range(RUNS):
        batch = _batch(spark, d, k).withColumn("run_date", F.lit(_DAY + timedelta(k)))
        batch.write.mode("append").parquet(f"{at}/in")
        state.run_stream(spark.readStream.schema(batch.schema).parquet(f"{at}/in"), f"{at}/state", f"{at}/checkpoint", carry_forward=True, most_changes=2).awaitTermination()
    kept = state.State(spark, f"{at}/state")
    versions = [_shown(kept.read(int(v)).withColumn("version", F.lit(int(v))), "version", *_VERSION_COLUMNS) for v in kept.manifest.versions]
    return versions[0].unionByName(versions[1])


def _runs_sql(carry: bool, tail: str) -> str:
    """CTEs s0, s1 and so on: each run's snapshot, from the one before."""
    none = f"description NOT LIKE '%{rules.PLACEHOLDER}%' AND description NOT LIKE '%{rules.SEE_LINK}%'"
    rank = "CASE WHEN title_no IN (3, 4) AND description LIKE '%tenure-track%' THEN 'Tenure-Track' WHEN title_no IN (3, 4) AND description LIKE '%lecturer%' THEN 'Lecturer' ELSE rank END"
    parts = []
    for k in range(RUNS):
        day = f"(DATE '{P.AS_OF}' + {k})"
        last = f"s{k - 1}" if k else "(SELECT NULL AS id, NULL::DATE AS date_added, '' AS description, NULL::DATE AS dd WHERE false)"
        parts.append(f"b{k} AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.id ORDER BY p.ingest_seq) AS n FROM p JOIN raw ON p.ingest_seq = raw.ingest_seq WHERE quarter(raw.orderdate) = {k + 1}) WHERE n = 1 AND (dd IS NULL OR dd >= {day} - 14))")
        rest = f" UNION ALL SELECT id, title, rank, deadline, dd, false, date_added, desc_action, description FROM {last} WHERE id NOT IN (SELECT id FROM b{k}) AND (dd IS NULL OR dd >= {day} - 14)" if carry and k else ""
        parts.append(f"""s{k} AS (SELECT c.id, c.title, {rank.replace('description', 'c.description').replace('ELSE rank', 'ELSE c.rank')} AS rank, c.deadline, c.dd, o.id IS NULL AS is_new, coalesce(o.date_added, {day}) AS date_added,
            CASE WHEN o.reused THEN 'reuse' WHEN length(c.description) > 300 AND {none.replace('description', 'c.description')} THEN 'summarise' ELSE 'keep' END AS desc_action, CASE WHEN o.reused THEN o.description ELSE c.description END AS description
          FROM b{k} c LEFT JOIN (SELECT *, description <> '' AND length(description) <= 800 AND {none} AS reused FROM {last}) o ON c.id = o.id{rest})""")
    return P.sql("@").replace("@", "", 1).rstrip() + ", " + ", ".join(parts) + " " + tail


def _columns(version: int | None = None) -> str:
    shown = ", ".join("CAST(date_added AS VARCHAR) AS date_added" if c == "date_added" else c for c in _VERSION_COLUMNS)
    return (f"CAST({version} AS INTEGER) AS version, " if version is not None else "") + shown


QUERIES = {
    "t2_expiry_stream": (expiry_stream, P.sql(_EXPIRY)),
    "j1_bucketed_state": (bucketed_runs, _runs_sql(False, f"SELECT {_columns()} FROM s{RUNS - 1}")),
    "t1_manifest": (versions_stream, _runs_sql(True, f"SELECT {_columns(RUNS - 2)} FROM s{RUNS - 2} UNION ALL SELECT {_columns(RUNS - 1)} FROM s{RUNS - 1}")),
}
