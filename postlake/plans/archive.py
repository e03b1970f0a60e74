"""Archived pages of every source, derived from the star schema, and what its run must make of them, in SQL.

A customer is a page of its source's list and its orders are the page's rows, so that
pages are of bounded size; three orders in a row share a job number, so that postings
repeat within a source and the first one wins. Three of four jobs have an archived detail
page, some of them twice, and some have a description from an earlier run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.operators import reconcile as R
from postlake.sources import sites

from . import postings as P

#: Departments by order, and texts of detail pages.
NAMES = ("Music", "Law", "Physics", "History")
DUTIES = "The appointee will join a team that teaches and does research, advises students and takes part in the work of the unit."
MORE = "Applicants should hold a doctoral degree and have taught for at least three years at a university."
FILLER = "The post is open to all who meet what it asks for; the committee reads every application that it gets in time."
CACHED = "A summary that an earlier run made of this post, which is long enough to be taken as one worth keeping."
SOURCES = tuple(u[0] for u in rules.UNIVERSITIES)
COLUMNS = ("id", "title", "rank", "department", "deadline", "reference", "position_type", "apply_url", "description")


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def by_source(spark: SparkSession, d: str, folder: str) -> DataFrame:
    """What lists are made of, joined once and kept in folder by source, so that each source reads its own rows alone."""
    P.raw_postings(spark, d).select("ingest_seq", "source_no", "custkey", "orderdate", "title", "deadline_raw").write.partitionBy("source_no").parquet(folder)
    return spark.read.schema("ingest_seq long, custkey long, orderdate timestamp, title string, deadline_raw string, source_no int").parquet(folder)


def _listing(spark: SparkSession, d: str, source: str, kept: DataFrame | None = None) -> DataFrame:
    """k, page, row, title, job, dept, raw, day, of a source's rows; kept: of by_source."""
    raw = (P.raw_postings(spark, d) if kept is None else kept).where(F.col("source_no") == SOURCES.index(source))
    dept = F.concat(F.lit("Department of "), F.element_at(F.array(*(F.lit(n) for n in NAMES)), (F.col("ingest_seq") % 4 + 1).cast("int")))
    return raw.select(
        F.col("ingest_seq").alias("k"), F.col("custkey").alias("page"), F.row_number().over(Window.partitionBy("custkey").orderBy("ingest_seq")).alias("row"),
        "title", (10_000_000 + F.floor(F.col("ingest_seq") / 3)).alias("job"), dept.alias("dept"), F.col("deadline_raw").alias("raw"), F.col("orderdate").alias("day"),
    )


def _row(source: str) -> tuple[Column, Column]:
    """A row's part of the page's markup and of its text."""
    k, title, job, dept, raw, day = (F.col(c) for c in ("k", "title", "job", "dept", "raw", "day"))
    bare, none = k % 5 == 0, F.lit("")
    maybe = F.when(bare, "").otherwise(F.concat(F.lit(", "), dept))
    html, body = none, none
    if source == "polyu":
        html = _text("<tr><td>", dept, "<td>", title, "<td>", F.when(k % 2 == 0, "Opera").otherwise(""), "<td>", raw, "<td>", job, "</tr>")
    elif source == "eduhk":
        html = F.when(k % 2 == 0, _text("<a href='/cms/f/career/", k, ".pdf'>pdf</a>")).otherwise("")
        close = F.when(k % 10 < 2, raw).otherwise("N/A")
        body = _text(FILLER, "\nOpen: ", title, "\n", F.when(bare, "").otherwise(F.concat(dept, F.lit("\n"))), F.when(k % 7 == 0, "").otherwise(_text("Ref: ", job, "\n")), "Ad Date: 1 Jan 2026\nClose Date: ", close, "\n")
    elif source == "lingnan":
        html = _text("<a href='", F.when(k % 11 == 0, "/other/").otherwise("/ux/requisition/"), job, "'>", title, maybe, "</a>")
    elif source == "hku":
        html = _text("<tr><td>", job, "<td><a href='/en/", job, "'>", F.when(k % 13 == 0, "Finance Officer").otherwise(title), "</a><td>", F.when(bare, "-").otherwise(dept), "<td>", raw, "</tr>")
    elif source == "hkust":
        html = _text("<div class='card'><b>", title, "</b><span>Job ID: ", job, "</span>", F.when(k % 2 == 0, _text("<a href='https://apply.interfolio.com/", job, "'>Apply</a>")).otherwise(""), "</div>")
        body = _text("Filters (3)\n", title, "\nJob ID: ", job, "\n", F.when(bare, "").otherwise(F.concat(dept, F.lit("\n"))), "Open Date: 2026-01-01\nApply by: ", F.when(k % 10 == 8, "-").otherwise(F.date_format(day, "yyyy-MM-dd")), "\n")
    elif source == "cityu":
        href = F.when(k % 9 == 0, _text("http://c.example/", job)).otherwise(_text("/apply?ref=A-", job))
        html = _text("<tr><td><a href='", href, "'>", title, "</a><td>", dept, F.when(k % 6 == 0, "").otherwise(F.concat(F.lit("<td>"), raw)), "</tr>")
    elif source == "hkbu":
        about = F.when(k % 4 == 1, "It sits under the School of Business at our campus.").otherwise("")
        body = _text('{"', F.when(k % 3 == 0, "title").otherwise("Title"), '": "', title, maybe, '", "', F.when(k % 3 == 0, "RequisitionNumber").otherwise("Id"), '": ', job, ', "PostedEndDate": "', F.when(k % 2 == 0, "").otherwise(F.date_format(day, "yyyy-MM-dd")), '", "ShortDescription": "', about, '"}')
    elif source == "cuhk":
        html = _text("<tr><td>", job, "<td><a href='/c/", job, "'>", title, "</a><td>", F.when(bare, "-").otherwise(dept), "<td>123456</tr>")
    elif source == "hkmu":
        html = _text("<tr><th scope='row'><a href='/j?job=26", job, "BV&x=1'>", title, "</a></th><td>1<td>", F.when(bare, "").otherwise(dept), "<td>", F.date_format(day, "d/MMM/yyyy"), "</tr>")
    elif source == "hsu":
        dash = F.when(bare, "").when(k % 5 == 1, F.concat(dept, F.lit(" – "))).otherwise(F.concat(dept, F.lit(" - ")))
        html = _text("<a href='https://recruit.hsu.edu.hk/opening/content.php?id=", job, "'>", dash, title, "</a>")
    elif source == "sfu":
        html = _text("<div class='accordion-wrap'><a class='accordion-btn'>", title, maybe, " (Ref.: S/", job, ")</a><div class='accordion-content'><p>", FILLER, "</p><p>Deadline</p>\n<p>5 March 202", k % 10, "</p><li>Short</li></div></div>")
    elif source == "hksyu":
        html = _text("<tr><td>", dept, "<td>", F.when(bare, title).otherwise(_text("<a href='/files/ro-", job, ".pdf'>", title, "</a>")), "<td>FT<td>", F.date_format(day, "dd/MM/yyyy"), " or until filled</tr>")
    return html, body


_HEADER = {"polyu": "<tr><th>Dept</th><th>Post</th><th>Project</th><th>Closing</th><th>Ref</th></tr>", "hkmu": "<tr><th>Post</th></tr>", "hksyu": "<tr><th>Department / Unit</th><th>Position</th><th>Type</th><th>Closing</th></tr>"}


def pages(spark: SparkSession, d: str, source: str, kept: DataFrame | None = None) -> DataFrame:
    """The source's archived list: source, section, section_no, page_no, url, html, body_text. A page holds a customer's orders."""
    html, body = _row(source)
    rows = _listing(spark, d, source, kept).select("page", F.struct("row", html.alias("html"), body.alias("body")).alias("r"))
    one = rows.groupBy("page").agg(F.sort_array(F.collect_list("r")).alias("r"))
    joined = lambda part, by: F.array_join(F.transform("r", lambda x: x[part]), by)
    table = source in ("polyu", "hku", "cityu", "cuhk", "hkmu", "hksyu")
    html = F.concat(F.lit(f"<table>{_HEADER.get(source, '')}"), joined("html", ""), F.lit("</table>")) if table else F.concat(F.lit("<div>"), joined("html", ""), F.lit("</div>"))
    body = F.concat(F.lit('{"items": ['), joined("body", ", "), F.lit('], "hasMore": false}')) if source == "hkbu" else joined("body", "")
    return one.select(F.lit(source).alias("source"), F.lit("list").alias("section"), F.lit(0).cast("long").alias("section_no"), F.col("page").cast("long").alias("page_no"), _text(f"https://list.example/{source}/", F.col("page")).alias("url"), html.alias("html"), body.alias("body_text"))


def _detail_url(source: str) -> Column:
    job, base = F.col("job"), rules.BASES.get(source, "")
    start = {"polyu": f"{base}/job_detail.php?job=", "lingnan": f"{base}/ux/requisition/", "hku": f"{base}/en/", "hkust": "https://apply.interfolio.com/", "cityu": f"{base}/apply?ref=A-", "hkbu": f"{base}/", "cuhk": f"{base}/c/", "hsu": "https://recruit.hsu.edu.hk/opening/content.php?id=", "hkmu": f"{base}/j?job=26"}
    return _text(start.get(source, "none"), job, "BV&x=1" if source == "hkmu" else "")


def details(spark: SparkSession, d: str, source: str, kept: DataFrame | None = None) -> DataFrame:
    """url, html, body_text of the jobs' detail pages; every seventh job's is there twice."""
    job = F.col("job")
    rows = _listing(spark, d, source, kept).select("job").distinct().where(job % 4 != 3)
    rows = rows.withColumn("again", F.explode(F.when(job % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    first = _text("Duties of post ", job, ": ", DUTIES)
    closing = {"cuhk": _text("Closing Date: March 5, 199", job % 10), "hsu": _text("Please apply on or before 5 March 202", job % 10)}.get(source, _text("Closing Date: 5 March 199", job % 10))
    guard = F.when(job % 3 == 0, "Just a moment: cloudflare\n").otherwise("") if source == "hku" else F.lit("")
    body = _text(guard, "Menu\n", first, "\nShort line\n", MORE, "\n", closing)
    block = _text("<nav>", FILLER, "</nav><div>", first, " ", MORE, "</div><p>", closing, "</p>")
    if source == "polyu":
        rich = _text("<div class='side'>", FILLER, "</div><div class='", rules.CONTENT_CLASS, "'><p>", first, "</p><p>", F.upper(first), "</p><p>", MORE, "</p></div>")
        block = F.when(job % 2 == 0, rich).otherwise(block)
    return rows.select(_detail_url(source).alias("url"), block.alias("html"), body.alias("body_text"))


def cache(spark: SparkSession, d: str, source: str, kept: DataFrame | None = None) -> DataFrame:
    """id, description, date_added of an earlier run: a good description of every fifth job, a placeholder of every fifth."""
    job = F.col("job")
    prefix = {s: p for s, _, p, _ in rules.UNIVERSITIES}[source]
    rows = _listing(spark, d, source, kept).select("job").distinct().where(job % 5 < 2)
    return rows.select(_text(f"{prefix}-", "26" if source == "hkmu" else "", job, "BV" if source == "hkmu" else "").alias("id"), F.when(job % 5 == 0, CACHED).otherwise(f"Post. {rules.PLACEHOLDER} for full details.").alias("description"), F.date_sub(P.as_of(), (job % 30).cast("int")).alias("date_added"))


def failing_pages(spark: SparkSession, d: str, kept: DataFrame | None = None) -> DataFrame:
    """hkbu's pages as fetched on a bad day, with error: every seventh JSON page failed, and all lists were rendered too."""
    api, failed = pages(spark, d, "hkbu", kept), F.col("page_no") % 7 == 0
    gone = lambda c: F.when(~failed, F.col(c)).alias(c)
    listed = api.select("source", "section", "section_no", "page_no", "url", gone("html"), gone("body_text"), F.when(failed, "HTTPError: 503").alias("error"))
    k, title, job, dept = (F.col(c) for c in ("k", "title", "job", "dept"))
    link = _text(f"<a href='{rules.BASES['hkbu']}/", job, "'>", title, F.when(k % 5 == 0, "").otherwise(F.concat(F.lit(", "), dept)), "</a>")
    rows = _listing(spark, d, "hkbu", kept).select("page", F.struct("row", link.alias("html")).alias("r"))
    one = rows.groupBy("page").agg(F.sort_array(F.collect_list("r")).alias("r"))
    html = F.concat(F.lit("<div>"), F.array_join(F.transform("r", lambda x: x["html"]), ""), F.lit("</div>"))
    return listed.unionByName(one.select(F.lit("hkbu").alias("source"), F.lit(sites.RENDERED).alias("section"), F.lit(1).cast("long").alias("section_no"), F.col("page").cast("long").alias("page_no"), _text("https://list.example/hkbu/rendered/", F.col("page")).alias("url"), html.alias("html"), F.lit("").alias("body_text"), F.lit(None).cast("string").alias("error")))


def run_failing(spark: SparkSession, d: str) -> DataFrame:
    """hkbu's whole run on the bad day, first of each id."""
    out = sites.run_source("hkbu", failing_pages(spark, d), details(spark, d, "hkbu"), cache(spark, d, "hkbu"), P.as_of())
    return R.keep_first(out, ["id"], ["section_no", "page_no", "row_no"]).select(*COLUMNS)


def all_archived(spark: SparkSession, d: str, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every source's list and detail pages, archived by source in folder, and the last snapshot."""
    kept = by_source(spark, d, f"{folder}/raw")
    for source in SOURCES:
        listed = failing_pages(spark, d, kept) if source == "hkbu" else pages(spark, d, source, kept).withColumn("error", F.lit(None).cast("string"))
        sites.archive(listed, f"{folder}/pages")
        sites.archive(details(spark, d, source, kept).withColumn("source", F.lit(source)), f"{folder}/details")
    # Every source of a run joins it, so that it is kept too.
    previous = R.union_sources([cache(spark, d, source, kept) for source in SOURCES])
    previous.write.parquet(f"{folder}/previous")
    previous = spark.read.schema(previous.schema).parquet(f"{folder}/previous")
    return sites.archived(spark, f"{folder}/pages"), sites.archived(spark, f"{folder}/details"), previous


def run(spark: SparkSession, d: str, source: str) -> DataFrame:
    out = sites.run_source(source, pages(spark, d, source), details(spark, d, source), cache(spark, d, source), P.as_of())
    return out.select(*COLUMNS)


# --- What must come out, in SQL ---------------------------------------------------------


def _lst(source: str) -> str:
    """CTEs ending in l: the source's rows with what its pages say of them."""
    full = {u[0]: u[3] for u in rules.UNIVERSITIES}[source]
    return P.sql(f"""SELECT * FROM (SELECT p.ingest_seq AS k, raw.custkey AS page, row_number() OVER (PARTITION BY raw.custkey ORDER BY p.ingest_seq) AS r, p.title, p.title_no, p.rank, p.position_type AS type,
        10000000 + p.ingest_seq // 3 AS job, 'Department of ' || {P._case('p.ingest_seq % 4', enumerate(NAMES))} AS dept, p.deadline, strftime(orderdate, '%Y-%m-%d') AS day, p.ingest_seq % 5 = 0 AS bare,
        coalesce(nullif({P._case('p.title_no', sorted(P.DEPARTMENTS.items()))}, ''), '') AS inferred, {P._quote(full)} AS uni
      FROM p JOIN raw ON p.ingest_seq = raw.ingest_seq WHERE raw.source_no = {SOURCES.index(source)})""")


_FIRST, _MORE = f"'Duties of post ' || job || ': ' || {P._quote(DUTIES)}", P._quote(MORE)
_LINES = f"{_FIRST} || chr(10) || chr(10) || {_MORE}"
_BLOCK = f"{_FIRST} || ' ' || {_MORE}"
_HOLDER = "title || ' — ' || {dept} || '. " + rules.PLACEHOLDER + " for full details.'"
_SEEN = "job % 4 <> 3"
_KEPT = "(deadline = 'N' OR deadline IN ('', '-', 'Until filled') OR TRY_CAST(deadline AS DATE) >= %s - 14)" % P._D


def _id(prefix: str, key: str) -> str:
    return f"'{prefix}-' || CASE WHEN length({key}) <= 20 AND regexp_matches({key}, '^[\\w\\-]+$') THEN ({key}) ELSE md5({key})[1:10] END"


def _expected(source: str, placed: bool = False) -> str:
    """The source's query: from l to the posting columns; placed: with section, page and r, where the row stands."""
    named = "CASE WHEN bare THEN uni ELSE dept END"
    cached = "job % 5 = 0"
    first = lambda key, rows="l": f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY page, r) AS n FROM {rows}) WHERE n = 1)"
    base = rules.BASES.get(source, "")

    def out(id_, title, dept, deadline, ref, url, about, rows, where="true", kind="type"):
        return f"SELECT {id_} AS id, {title} AS title, rank, {dept} AS department, {deadline} AS deadline, {ref} AS reference, {kind} AS position_type, {url} AS apply_url, {about} AS description{', 0 AS section, page, r' if placed else ''} FROM {rows} WHERE {where}"

    job = "CAST(job AS VARCHAR)"
    if source == "polyu":
        rows = f"(SELECT * REPLACE (CASE WHEN k % 10 IN (2, 8, 9) THEN '' ELSE deadline END AS deadline) FROM {first('job')})"
        about = f"CASE WHEN NOT {_SEEN} THEN title || CASE WHEN k % 2 = 0 THEN ' — Project: Opera' ELSE '' END || ' (' || dept || '). See application link for full details.' WHEN job % 2 = 0 THEN {_LINES} ELSE {_BLOCK} END"
        return out(f"'POLYU-' || {job}", "title", "dept", "deadline", job, f"'{base}/job_detail.php?job=' || job", about, rows, _KEPT, "'Full-time'")
    if source == "eduhk":
        rows = f"(SELECT * REPLACE ('Open: ' || title AS title), CASE WHEN bare THEN '' ELSE dept END AS d0, CASE WHEN k % 7 = 0 THEN '' ELSE {job} END AS ref FROM l)"
        kept = first("title || '|' || CASE WHEN ref <> '' THEN ref ELSE d0 END", rows)
        zipped = f"(SELECT a.*, coalesce('https://list.example' || b.href, 'https://list.example/eduhk/' || a.page) AS url FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY r) AS i FROM {kept}) a LEFT JOIN (SELECT page, '/cms/f/career/' || k || '.pdf' AS href, row_number() OVER (PARTITION BY page ORDER BY r) AS i FROM l WHERE k % 2 = 0) b ON a.page = b.page AND a.i = b.i)"
        key = "CASE WHEN ref <> '' THEN ref ELSE trim(title[1:40] || '_' || d0[1:20]) END"
        return out(_id("EDUHK", key), "title", "CASE WHEN d0 <> '' THEN d0 WHEN inferred <> '' THEN inferred ELSE uni END", "CASE WHEN k % 10 < 2 THEN deadline ELSE 'N' END", "ref", "url", "title || CASE WHEN d0 <> '' THEN ' — ' || d0 ELSE '' END || '. See EdUHK website for full details.'", zipped)
    if source == "lingnan":
        about = f"CASE WHEN {cached} THEN '{CACHED}' WHEN {_SEEN} THEN {_LINES} ELSE {_HOLDER.format(dept=f'({named})')} END"
        return out(f"'LU-' || {job}", "title", named, "''", job, f"'{base}/ux/requisition/' || job", about, first("title || CASE WHEN bare THEN '' ELSE dept END", "(SELECT * FROM l WHERE k % 11 <> 0)"))
    if source == "hku":
        rows = f"(SELECT * REPLACE (CASE WHEN k % 10 IN (2, 8, 9) THEN '' ELSE deadline END AS deadline) FROM {first('job')} WHERE k % 13 <> 0)"
        about = f"CASE WHEN {cached} THEN '{CACHED}' WHEN {_KEPT} AND {_SEEN} AND job % 3 <> 0 THEN {_LINES} ELSE {_HOLDER.format(dept=f'({named})')} END"
        return out(f"'HKU-' || {job}", "title", named, "deadline", job, f"'{base}/en/' || job", about, rows)
    if source == "hkust":
        rows = f"(SELECT * REPLACE (CASE WHEN bare THEN '' ELSE dept END AS dept, CASE WHEN k % 10 = 8 THEN '-' ELSE day END AS deadline), job IN (SELECT job FROM l WHERE k % 2 = 0) AS moved FROM {first('page, job')})"
        url = f"CASE WHEN moved THEN 'https://apply.interfolio.com/' || job ELSE replace('{base}', '{{ref}}', {job}) END"
        about = f"CASE WHEN moved AND {_KEPT} AND {_SEEN} THEN {_LINES} ELSE title || CASE WHEN dept <> '' THEN ' — ' || dept ELSE '' END || '. {rules.PLACEHOLDER} for full details.' END"
        return out(f"'HKUST-' || {job}", "title", "dept", "deadline", job, url, about, rows)
    if source == "cityu":
        rows = f"(SELECT *, CASE WHEN k % 9 = 0 THEN '' ELSE 'A-' || job END AS ref, CASE WHEN k % 9 = 0 THEN 'http://c.example/' || job ELSE '{base}/apply?ref=A-' || job END AS url FROM (SELECT * REPLACE (CASE WHEN k % 6 = 0 THEN '' ELSE deadline END AS deadline) FROM l))"
        kept = first("CASE WHEN ref <> '' THEN ref ELSE CAST(k AS VARCHAR) || '#' END", rows)
        about = f"CASE WHEN NOT {_KEPT} THEN '' WHEN ref <> '' AND {_SEEN} THEN {_BLOCK} ELSE {_HOLDER.format(dept='dept')} END"
        return out(_id("CITYU", "CASE WHEN ref <> '' THEN ref ELSE trim(title[1:25]) END"), "title", "dept", "deadline", "ref", "url", about, kept)
    if source == "hkbu":
        dept = "CASE WHEN NOT bare THEN dept WHEN inferred <> '' THEN inferred WHEN k % 4 = 1 THEN 'School of Business' ELSE uni END"
        due = f"CASE WHEN k % 2 = 1 THEN day WHEN {_SEEN} THEN '199' || job % 10 || '-03-05' ELSE '' END"
        about = f"CASE WHEN k % 4 = 1 THEN 'It sits under the School of Business at our campus.' ELSE {_HOLDER.format(dept=f'({dept})')} END"
        return out(f"'HKBU-' || {job}", "title", dept, due, job, f"'{base}/' || job", about, first("title || CASE WHEN bare THEN '' ELSE dept END"))
    if source == "cuhk":
        return out(f"'CUHK-' || {job}", "title", named, f"CASE WHEN {_SEEN} THEN '199' || job % 10 || '-03-05' ELSE '' END", job, f"'{base}/c/' || job", f"CASE WHEN {_SEEN} THEN {_LINES} ELSE {_HOLDER.format(dept=f'({named})')} END", first("job"))
    if source == "hkmu":
        about = f"CASE WHEN {cached} THEN '{CACHED}' WHEN {_KEPT} AND {_SEEN} THEN {_LINES} ELSE {_HOLDER.format(dept=f'({named})')} END"
        return out(f"'HKMU-26' || job || 'BV'", "title", named, "deadline", "'26' || job || 'BV'", f"'{base}/j?job=26' || job || 'BV&x=1'", about, f"(SELECT * REPLACE (day AS deadline) FROM {first('job')})")
    if source == "hsu":
        own = _HOLDER.format(dept="(CASE WHEN bare THEN '' ELSE dept END)")
        return out(f"'HSU-' || {job}", "title", named, f"CASE WHEN {_SEEN} THEN '202' || job % 10 || '-03-05' ELSE '' END", job, "'https://recruit.hsu.edu.hk/opening/content.php?id=' || job", f"CASE WHEN {_SEEN} THEN {_BLOCK} ELSE {own} END", first("job"))
    if source == "sfu":
        return out(_id("SFU", "'S/' || job"), "title", named, "'202' || k % 10 || '-03-05'", "'S/' || job", "'https://list.example/sfu/' || page", P._quote(FILLER), first("job"))
    rows = first("CASE WHEN bare THEN dept || '|' || title ELSE CAST(job AS VARCHAR) END")
    key = "CASE WHEN bare THEN trim(title[1:25]) ELSE 'ro-' || job END"
    return out(_id("HKSYU", key), "title", "dept", "day", "CASE WHEN bare THEN '' ELSE 'ro-' || job END", f"CASE WHEN bare THEN 'https://list.example/hksyu/' || page ELSE '{base}/files/ro-' || job || '.pdf' END", _HOLDER.format(dept="dept"), rows)


def _expected_failing() -> str:
    """hkbu's on the bad day, placed: JSON rows of pages that did not fail, then all rendered rows."""
    named = "CASE WHEN bare THEN inferred ELSE dept END"
    api = _expected("hkbu", True).replace("FROM l)", "FROM (SELECT * FROM l WHERE page % 7 <> 0))")
    rows = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY title || CASE WHEN bare THEN '' ELSE dept END ORDER BY page, r) AS n FROM l) WHERE n = 1)"
    about = f"title || CASE WHEN {named} <> '' THEN ' — ' || {named} ELSE '' END || '. {rules.PLACEHOLDER} for full details.'"
    return f"""{api} UNION ALL SELECT 'HKBU-' || CAST(job AS VARCHAR), title, rank, coalesce(nullif({named}, ''), uni), CASE WHEN {_SEEN} THEN '199' || job % 10 || '-03-05' ELSE '' END, CAST(job AS VARCHAR), type,
        '{rules.BASES['hkbu']}/' || job, {about}, 1, page, r FROM {rows}"""


def failing_sql() -> str:
    return f"WITH l AS ({_lst('hkbu')}), x AS ({_expected_failing()}) SELECT {', '.join(COLUMNS)} FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section, page, r) AS n FROM x) WHERE n = 1"


def all_sql(tail: str) -> str:
    """tail after found, first and snap: every source's rows, the first of each id, and the snapshot."""
    found, last = [], []
    for source, _, prefix, _ in rules.UNIVERSITIES:
        body = _expected_failing() if source == "hkbu" else _expected(source, True)
        found.append(f"SELECT '{source}' AS source, * FROM (WITH l AS ({_lst(source)}) {body})")
        job = "'26' || job || 'BV'" if source == "hkmu" else "job"
        last.append(f"SELECT '{prefix}-' || {job} AS id, {P._D} - CAST(job % 30 AS INTEGER) AS date_added, CASE WHEN job % 5 = 0 THEN '{CACHED}' ELSE 'Post. {rules.PLACEHOLDER} for full details.' END AS description FROM (SELECT DISTINCT job FROM (WITH l AS ({_lst(source)}) SELECT job FROM l) WHERE job % 5 < 2)")
    none = lambda c: f"{c} NOT LIKE '%{rules.PLACEHOLDER}%' AND {c} NOT LIKE '%{rules.SEE_LINK}%'"
    reuse = f"coalesce(o.description <> '' AND length(o.description) <= 800 AND {none('o.description')}, false)"
    return f"""WITH found AS ({' UNION ALL '.join(found)}), prev AS ({' UNION ALL '.join(last)}),
      first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY section, page, r) AS n FROM found) WHERE n = 1),
      snap AS (SELECT f.* EXCLUDE (description, n, section, page, r), o.id IS NULL AS is_new, coalesce(o.date_added, {P._D}) AS date_added,
          CASE WHEN {reuse} THEN 'reuse' WHEN length(f.description) > 300 AND {none('f.description')} THEN 'summarise' ELSE 'keep' END AS desc_action, CASE WHEN {reuse} THEN o.description ELSE f.description END AS description
        FROM first f LEFT JOIN prev o ON f.id = o.id WHERE TRY_CAST(f.deadline AS DATE) IS NULL OR TRY_CAST(f.deadline AS DATE) >= {P._D} - 14)
      {tail}"""


def expected_sql(source: str) -> str:
    return f"WITH l AS ({_lst(source)}) {_expected(source)}"


def listed_sql(source: str) -> str:
    """The same of the list alone, which has what closed long ago too."""
    return f"WITH l AS ({_lst(source)}) {_expected(source).replace(_KEPT, 'true')}"
