"""Queries of the view layer over indexes and pages, of archives by source, and of HTML by table functions."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import deadline_date
from postlake.operators import index, pages
from postlake.operators import view as V
from postlake.sources import sites, tables
from postlake.sources.storage import shared_folder

from . import archive as A
from . import postings as P

#: What is searched for: 1 to 20 letters, in any case, within and across words, and what no posting has.
WORDS = ("q", "ph", "ICS", "mathem", "Physics", "of music", "tenure-track", "research assistant", "assistant professor i", "zebra")
_PAGE = 50


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- Search by an index -----------------------------------------------------------------


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot, indexed once, searched for each of WORDS."""
    folder = _folder(spark, "index")
    index.build(P.snapshot(spark, d), folder)
    found = [index.search(spark, folder, w).select(F.lit(w).alias("words"), F.col("key").alias("id")) for w in WORDS]
    return reduce(DataFrame.unionByName, found)


_HAY = "lower(title || ' ' || department || ' ' || university_full || ' ' || description)"
_SEARCH = "SELECT words, id FROM snap, (VALUES %s) q(words) WHERE contains(%s, lower(words))" % (", ".join(f"({P._quote(w)})" for w in WORDS), _HAY)

# --- Order over the whole view ----------------------------------------------------------

SMART = (pages.Key("badge", descending=True), pages.Key("university"), pages.Key("date_added", descending=True), pages.Key("id"))
BY_DEADLINE = (pages.Key("day"), pages.Key("id"))


def smart_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = P.snapshot(spark, d).select("id", "university", "date_added", V.is_badge(F.col("date_added"), P.as_of()).alias("badge"))
    return pages.numbered_pages(rows, SMART, _PAGE).select("id", "n", "page")


def deadline_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = P.snapshot(spark, d).select("id", deadline_date(F.col("deadline")).alias("day"))
    return pages.numbered_pages(rows, BY_DEADLINE, _PAGE).select("id", "n", "page")


_BADGE = f"coalesce(date_added BETWEEN {P._D} - 1 AND {P._D}, false)"


def _paged(order: str) -> str:
    return f"SELECT id, n, (n - 1) // {_PAGE} + 1 AS page FROM (SELECT id, row_number() OVER (ORDER BY {order}) AS n FROM snap)"


# --- Archives by source -----------------------------------------------------------------


def pruned_source(spark: SparkSession, d: str) -> DataFrame:
    """All sources' archived lists, written by source, of which one is read."""
    folder = _folder(spark, "archive")
    for source in A.SOURCES:
        sites.archive(A.pages(spark, d, source), folder)
    return sites.collect(sites.archived(spark, folder), "HKU")[0].select("id", "title")


# --- Table functions --------------------------------------------------------------------


def _sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    tables.register(spark)
    return spark.sql(query, **frames)


def lateral_links(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT page_id, l.link_no, l.href, l.text FROM {pages}, LATERAL html_links(html) l", pages=spark.read.parquet(f"{d}/pages.parquet"))


def lateral_rows(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT page_no AS page, r.row_no, array_join(transform(r.cells, c -> c.text), '|') AS cells, r.href FROM {pages}, LATERAL html_rows(html) r", pages=A.pages(spark, d, "cuhk").select("page_no", "html"))


def lateral_windows(spark: SparkSession, d: str) -> DataFrame:
    return _sql(spark, "SELECT doc_id, w.match_no, w.before, w.after FROM {documents}, LATERAL anchor_windows(text, 'the', 60, 20) w", documents=spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"))


#: Queries whose SQL is that of a query of the registry, by its name.
SAME = {"x2_lateral_links": (lateral_links, "x2_links"), "x1_lateral_rows": (lateral_rows, "x1_table_rows"), "x4_lateral_windows": (lateral_windows, "x4_anchor_windows")}
QUERIES = {
    "v3_indexed_search": (indexed_search, P.sql(_SEARCH)),
    "v1_smart_pages": (smart_pages, P.sql(_paged(f"{_BADGE} DESC, university, date_added DESC, id"))),
    "v2_deadline_pages": (deadline_pages, P.sql(_paged("dd ASC NULLS LAST, id"))),
    "s5_pruned_source": (pruned_source, f"SELECT id, title FROM ({A.listed_sql('hku')})"),
}
