"""The numbered oddities of the survey's register, each by its number; Q4, Q6, Q9, Q12, Q14, Q15 and Q17 are in test_quirks."""

from datetime import timedelta

from pyspark.sql import functions as F
from test_quirks import DETAIL, one
from test_runs import DAY, posts, state

from postlake.functions import text as T
from postlake.operators import reconcile as R
from postlake.sources import sites as S


def _strings(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "t string")


def test_q1_free_text_never_expires(spark):
    df = _strings(spark, "Until filled", "30 Feb 2020", "2020-01-01").select(T.parse_date("t").alias("d"))
    assert [tuple(r) for r in df.select("d", T.is_active(F.col("d"), F.lit(DAY)), T.is_retained(F.col("d"), F.lit(DAY))).collect()] == [("Until filled", True, True), ("30 Feb 2020", True, True), ("2020-01-01", False, False)]


def test_q2_a_long_cached_text_is_good_but_no_summary(spark):
    long = "y" * 900
    rows = R.restore_cached(posts(spark, ("a", "t", "", "z")), spark.createDataFrame([("a", long)], "id string, description string"))
    assert rows.first().description == long
    assert [R.describe(rows, state(spark, ("a", DAY, long))).first().desc_action for _ in range(2)] == ["summarise", "summarise"]


def test_q3_any_short_text_counts_as_a_summary(spark):
    out = R.describe(posts(spark, ("a", "t", "", "y" * 400)), state(spark, ("a", DAY, "raw"))).first()
    assert (out.desc_action, out.description) == ("reuse", "raw")


def test_q5_a_changed_url_leaves_the_last_snapshot(spark):
    cur = posts(spark, ("a", "t", "", "new text")).withColumns({"apply_url": F.lit("u"), "reference": F.lit("r")})
    changed = R.override_urls(cur, spark.createDataFrame([("r", "v")], "reference string, href string"))
    last = state(spark, ("a", DAY, "A short old summary."))
    assert R.invalidate(last, changed).count() == 0
    assert R.run(changed, last, F.lit(DAY)).first().description == "A short old summary."


def test_q7_not_available_is_read_as_n(spark):
    body = "Tutor\nDepartment of Art\nRef: 250001\nAd Date: 1 Jan 2026\nClose Date: N/A\n"
    assert [r.deadline for r in S.eduhk(one(spark, "", body)).collect()] == ["N"]


def test_q8_an_iso_cell_is_no_date_cell(spark):
    cells = spark.createDataFrame([(["a", "2026-02-27", "27/02/2026"],), (["2026-02-27"],)], "c array<string>")
    assert [r[0] for r in cells.select(T.date_cells(F.col("c"))).collect()] == [["2026-02-27"], []]


def test_q10_q11_blank_references_and_equal_beginnings(spark):
    row = "<tr><td><a href='http://c/%d'>Assistant Professor in the Department of %s</a></td><td>Law</td></tr>"
    out = S.cityu(one(spark, "<table>" + row % (1, "Law") + row % (2, "Music") + "</table>"))
    assert out.count() == 2  # a blank reference is no key of the source
    assert len({r.id for r in out.collect()}) == 1  # and the ids come from the titles' first 25 characters


def test_q13_same_day_reruns_and_gaps(spark):
    run = lambda rows, last, day: {r.id: (r.is_new, r.date_added) for r in R.run(posts(spark, *((i, "T", "", "x") for i in rows)), state(spark, *((i, d, "") for i, (_, d) in last.items())), F.lit(day)).collect()}
    first = run("ab", {}, DAY)
    again = run("ab", first, DAY)
    assert first["a"] == (True, DAY) and again["a"] == (False, DAY)
    alone = run("a", again, DAY + timedelta(1))
    back = run("ab", alone, DAY + timedelta(2))
    assert back == {"a": (False, DAY), "b": (True, DAY + timedelta(2))}


def test_q16_non_tenure_disables_the_first_rule_alone(spark):
    got = _strings(spark, "Tenure-track Professor (non-tenure option)", "Non-Tenure-Track Lecturer", "Tenure-Track Post").select(T.detect_rank(F.col("t"))).collect()
    assert [r[0] for r in got] == ["Professor", "Lecturer", "Tenure-Track"]


def test_q18_why_a_posting_has_no_detail(spark):
    rows = spark.createDataFrame([(u,) for u in "abcde"], "apply_url string")
    details = spark.createDataFrame([("a", "<p>x", "x", None), ("b", "", "", None), ("c", None, None, "HTTPError: 503"), ("e", None, None, "timeout"), ("e", "<p>y", "y", None), (None, "", "", None)], f"{DETAIL}, error string")
    assert {r.apply_url: r.detail_error for r in S.with_detail_error(rows, details).collect()} == {"a": None, "b": "empty", "c": "HTTPError: 503", "d": "not archived", "e": None}
    assert {r.detail_error for r in S.with_detail_error(rows, details.drop("error").limit(0)).collect()} == {"not archived"}
