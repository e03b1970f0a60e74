"""Postings derived from the star schema: the same rule as DataFrame and as SQL.

Orders stand for scraped rows, customers for references: an order repeats its customer's
reference, so that ids repeat and the first one wins. AS_OF is the run's day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.rules import PLACEHOLDER, SEE_LINK, UNIVERSITIES
from postlake.functions.text import detect_rank, detect_type, make_id, parse_date
from postlake.operators import reconcile as R

AS_OF = "1998-06-30"

#: Titles with the rank and type that they must get from the title alone.
TITLES = (
    ("Tenure-Track Assistant Professor in Data Science", "Tenure-Track", "Full-time"),
    ("Substantiation-track Faculty Member", "Tenure-Track", "Full-time"),
    ("Non-Tenure-Track Assistant Professor", "Assistant Professor", "Full-time"),
    ("Faculty Positions in Engineering", "Other", "Full-time"),
    ("Faculty Position in Nursing", "Other", "Full-time"),
    ("Teaching-track Professor of Law", "Lecturer", "Full-time"),
    ("Chair Professor of History", "Professor", "Full-time"),
    ("Associate Professor / Assistant Professor in Chemistry", "Associate Professor", "Full-time"),
    ("Assistant Professor in Physics", "Assistant Professor", "Full-time"),
    ("Professor in Mathematics", "Professor", "Full-time"),
    ("Research Assistant Professor", "Assistant Professor", "Full-time"),
    ("Postdoctoral Fellow in Biology", "Postdoctoral", "Full-time"),
    ("Post-doctoral Researcher", "Postdoctoral", "Full-time"),
    ("Post Doctoral Associate", "Postdoctoral", "Full-time"),
    ("Research Fellow (Part-time)", "Postdoctoral", "Part-time"),
    ("Dean of Students", "Senior Management", "Full-time"),
    ("Provost", "Senior Management", "Full-time"),
    ("Head of Department of Music", "Senior Management", "Full-time"),
    ("Vice-Chancellor", "Senior Management", "Full-time"),
    ("Vice Chancellor", "Senior Management", "Full-time"),
    ("Vice-President (Research)", "Senior Management", "Full-time"),
    ("Vice President", "Senior Management", "Full-time"),
    ("Teaching Associate in Design", "Teaching Assistant", "Full-time"),
    ("Teaching Assistant (Temporary)", "Teaching Assistant", "Fixed-term"),
    ("Research Engineer", "Research Assistant/Associate", "Full-time"),
    ("Research Assistant in AI", "Research Assistant/Associate", "Full-time"),
    ("Research Associate", "Research Assistant/Associate", "Full-time"),
    ("Research Officer", "Research Assistant/Associate", "Full-time"),
    ("Senior Lecturer in Accounting", "Lecturer", "Full-time"),
    ("Teaching Fellow", "Lecturer", "Full-time"),
    ("Instructor", "Lecturer", "Full-time"),
    ("Clinical Supervisor", "Lecturer", "Full-time"),
    ("Executive Officer, Registry", "Non-Academic", "Full-time"),
    ("Laboratory Assistant", "Non-Academic", "Full-time"),
    ("Project Associate (part-time, fixed-term)", "Non-Academic", "Fixed-term"),
    ("Security Guard", "Non-Academic", "Full-time"),
    ("Sustainability Trainee", "Other", "Full-time"),
    ("Deanery Assistant", "Senior Management", "Full-time"),
    ("Editorial Trainee", "Non-Academic", "Full-time"),
    ("Directorate Intern", "Non-Academic", "Full-time"),
)
#: Departments that the titles with one must give; others give none.
DEPARTMENTS = {0: "Data Science", 3: "Engineering", 4: "Nursing", 5: "", 6: "History", 7: "Chemistry", 8: "Physics", 9: "Mathematics", 11: "Biology", 15: "Students", 17: "Department of Music", 20: "Research", 22: "Design", 23: "Temporary", 28: "Accounting"}

_LONG = "The appointee will join a team that teaches and does research, advises students and takes part in the work of the department. "
#: Descriptions by order: 0 a placeholder, 1 of 120 characters, 2 of 400, 3 with a tenure track.
TEXTS = (f"Post. {PLACEHOLDER} for full details.", (_LONG * 2)[:120], (_LONG * 5)[:400], "This tenure-track post is open to all.")
LECTURER = "The lecturer teaches four courses."
#: Earlier descriptions by customer: a summary, a placeholder, a long raw text, none.
OLD = (("A short summary of the duties of this post, in one sentence that is over eighty characters long."), f"Post. {SEE_LINK}.", (_LONG * 8)[:900], "")


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case(of: str, values) -> str:
    return f"CASE {of} " + " ".join(f"WHEN {i} THEN {_quote(v)}" for i, v in values) + " END"


def _deadline(dialect: str) -> str:
    d = "o_orderdate"
    spark = ["d MMMM yyyy", "d MMM yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "d/MMM/yyyy", "MMMM d, yyyy", "MMM d, yyyy"]
    duck = ["%-d %B %Y", "%-d %b %Y", "%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%-d/%b/%Y", "%B %-d, %Y", "%b %-d, %Y"]
    form = [f"date_format({d}, '{p}')" for p in spark] if dialect == "spark" else [f"strftime({d}, '{p}')" for p in duck]
    return "CASE o_orderkey % 10 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(form)) + " WHEN 8 THEN '' ELSE 'Until filled' END"


def postings_sql(dialect: str = "duckdb") -> str:
    """ingest_seq, source_no, university, university_full, title_no, title, reference, deadline_raw, description."""
    text = f"CASE WHEN o_orderkey % 40 = 4 THEN {_quote(LECTURER)} ELSE {_case('o_orderkey % 4', enumerate(TEXTS))} END"
    return f"""SELECT o_orderkey AS ingest_seq, c_nationkey % 12 AS source_no, o_custkey AS custkey, o_orderdate AS orderdate,
      {_case('c_nationkey % 12', ((i, u[1]) for i, u in enumerate(UNIVERSITIES)))} AS university,
      {_case('c_nationkey % 12', ((i, u[3]) for i, u in enumerate(UNIVERSITIES)))} AS university_full,
      o_orderkey % 40 AS title_no, {_case('o_orderkey % 40', ((i, t[0]) for i, t in enumerate(TITLES)))} AS title,
      CAST(o_custkey AS {'STRING' if dialect == 'spark' else 'VARCHAR'}) AS reference, {_deadline(dialect)} AS deadline_raw, {text} AS description
    FROM orders JOIN customer ON o_custkey = c_custkey"""


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    return spark.sql(postings_sql("spark").replace("FROM orders JOIN customer", "FROM {orders} JOIN {customer}"), orders=orders, customer=customer)


def postings(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Raw postings, normalised and classified; more: raw columns beside them."""
    raw = raw_postings(spark, sf_dir)
    return raw.select(
        "ingest_seq", "custkey", make_id(F.col("university"), F.col("reference")).alias("id"), "title", "title_no", detect_rank(F.col("title")).alias("rank"),
        "university", "university_full", F.col("university_full").alias("department"), parse_date("deadline_raw").alias("deadline"), "reference",
        detect_type(F.col("title")).alias("position_type"), F.concat(F.lit("https://example.org/"), "reference").alias("apply_url"), "description", *more,
    )


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last snapshot: two of three ids, with dates up to a month back."""
    firsts = R.keep_first(postings(spark, sf_dir).select("id", "custkey", "ingest_seq"), ["id"], ["ingest_seq"]).where("custkey % 3 <> 0")
    old = F.element_at(F.array(*(F.lit(x) for x in OLD)), (F.col("custkey") % 4 + 1).cast("int"))
    return firsts.select("id", F.date_sub(F.lit(AS_OF).cast("date"), (F.col("custkey") % 30).cast("int")).alias("date_added"), old.alias("description"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole run over the derived postings."""
    return R.run(postings(spark, sf_dir), previous(spark, sf_dir), as_of())


def as_of():
    return F.lit(AS_OF).cast("date")


# --- The same in SQL, from what the rules say of each order -----------------------------

_D = f"DATE '{AS_OF}'"


def sql(tail: str) -> str:
    """tail after raw, p (postings), firsts, prev and snap."""
    swap = "CASE WHEN ingest_seq % 10 = 4 AND day(orderdate) <= 12 THEN strftime(orderdate, '%Y-%d-%m') WHEN ingest_seq % 10 < 8 THEN strftime(orderdate, '%Y-%m-%d') WHEN ingest_seq % 10 = 8 THEN '' ELSE 'Until filled' END"
    described = "CASE WHEN title_no IN (3, 4) AND description LIKE '%tenure-track%' THEN 'Tenure-Track' WHEN title_no IN (3, 4) AND description LIKE '%lecturer%' THEN 'Lecturer' ELSE rank END"
    return f"""WITH raw AS ({postings_sql()}),
    p AS (SELECT ingest_seq, custkey, upper(university) || '-' || reference AS id, title, title_no, {_case('title_no', ((i, t[1]) for i, t in enumerate(TITLES)))} AS rank,
        university, university_full, university_full AS department, {swap} AS deadline, reference,
        {_case('title_no', ((i, t[2]) for i, t in enumerate(TITLES)))} AS position_type, 'https://example.org/' || reference AS apply_url, description,
        CASE WHEN ingest_seq % 10 < 8 THEN TRY_CAST({swap} AS DATE) END AS dd FROM raw),
    firsts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ingest_seq) AS rn FROM p) WHERE rn = 1),
    prev AS (SELECT id, {_D} - CAST(custkey % 30 AS INTEGER) AS date_added, {_case('custkey % 4', enumerate(OLD))} AS description FROM firsts WHERE custkey % 3 <> 0),
    kept AS (SELECT * EXCLUDE (rank), {described} AS rank FROM firsts WHERE dd IS NULL OR dd >= {_D} - 14),
    snap AS (SELECT k.* EXCLUDE (description), prev.id IS NULL AS is_new, coalesce(prev.date_added, {_D}) AS date_added,
        CASE WHEN custkey % 3 <> 0 AND custkey % 4 = 0 THEN 'reuse' WHEN length(k.description) > 300 THEN 'summarise' ELSE 'keep' END AS desc_action,
        CASE WHEN custkey % 3 <> 0 AND custkey % 4 = 0 THEN prev.description ELSE k.description END AS description
      FROM kept k LEFT JOIN prev ON k.id = prev.id)
    {tail}"""
