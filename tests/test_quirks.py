"""Behaviour that looks odd and is kept on purpose, a test each."""

from datetime import date

from pyspark.sql import functions as F
from test_runs import DAY, posts, state
from test_sites import frame

from postlake.functions import text as T
from postlake.operators import reconcile as R
from postlake.sources import sites as S
from postlake.sources import snapshot as CSV

PAGE = "section_no long, page_no long, url string, html string, body_text string"
DETAIL = "url string, html string, body_text string"
LONG = "This line of the page is long enough to count as one of the description's own lines."


def one(spark, html, body=""):
    return spark.createDataFrame([(0, 0, "https://list/x", html, body)], PAGE)


def test_placeholder_without_marker_counts_as_summary(spark):
    old = "Lecturer — Physics. See EdUHK website for full details."
    out = R.describe(posts(spark, ("a", "t", "", "y" * 400)), state(spark, ("a", DAY, old))).first()
    assert (out.desc_action, out.description) == ("reuse", old)


def test_changed_url_is_read_again_every_run(spark):
    pages = frame(spark, ["hkust"])
    details = spark.createDataFrame([("https://apply.interfolio.com/9", "", LONG), ("https://apply.interfolio.com/9", "", LONG)], DETAIL)
    cache = spark.createDataFrame([("HKUST-101", "An old description that is long enough to be a good one, of over eighty characters."), ("HKUST-102", "x" * 90)], "id string, description string")
    got = {r.reference: r.description for r in S.run_source("hkust", pages, details, cache, F.lit(date(2026, 1, 1))).collect()}
    # The cached text of the changed one is void; the other keeps its placeholder, and no cached text comes back.
    assert got["101"] == LONG and "Please visit" in got["102"] and len(got) == 2


def test_links_go_to_accepted_posts_only(spark):
    body = "".join(f"{t}\nDepartment of Art\nRef: {n}\nAd Date: 1 Jan 2026\nClose Date: 5 Feb 2026\n" + "filler line of some length to part the posts " * 4 + "\n" for t, n in (("Tutor", 250001), ("Tutor", 250001), ("Dean", 250002)))
    html = "<a href='/cms/f/career/1.pdf'>a</a><a href='/cms/f/career/2.pdf'>b</a><a href='/cms/f/career/3.pdf'>c</a>"
    got = {r.reference: r.apply_url for r in S.eduhk(one(spark, html, body)).collect()}
    assert got == {"250001": "https://list/cms/f/career/1.pdf", "250002": "https://list/cms/f/career/2.pdf"}


def test_expired_first_removes_a_live_later_one(spark):
    out = R.run(posts(spark, ("d", "T", "2020-01-01", "x"), ("d", "live", "", "x"), ("e", "T", "until filled", "x")), state(spark), F.lit(DAY))
    assert [r.id for r in out.collect()] == ["e"]


def test_blank_date_added_is_carried(spark, tmp_path):
    (tmp_path / "jobs.csv").write_text('id,date_added,description\na,,text\n')
    last = CSV.read_snapshot(spark, str(tmp_path / "jobs.csv"), F.lit(DAY))
    out = R.run(posts(spark, ("a", "T", "", "x")), last, F.lit(DAY)).first()
    assert out.date_added is None and out.is_new is False


def test_en_dash_goes_before_hyphen(spark):
    got = spark.createDataFrame([("A - B – C",), ("A - B",), ("A",)], "t string").select(*T.first_dash(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("A - B", "C"), ("A", "B"), ("", "A")]


def test_filtered_title_still_takes_its_reference(spark):
    html = "<table><tr><td>529000</td><td><a href='/1'>Finance Officer</a></td></tr><tr><td>529000</td><td><a href='/2'>Professor of Law</a></td></tr></table>"
    assert S.hku(one(spark, html)).count() == 0


def test_repeated_sides_do_not_multiply(spark):
    cur = posts(spark, ("a", "T", "", "x")).withColumns({"apply_url": F.lit("u"), "reference": F.lit("r")})
    twice = spark.createDataFrame([("a", "g" * 90), ("a", "h" * 90)], "id string, description string")
    urls = spark.createDataFrame([("r", "v"), ("r", "w")], "reference string, href string")
    pages = spark.createDataFrame([("u", "one"), ("u", "two")], "url string, body_text string")
    assert R.restore_cached(cur, twice).count() == R.override_urls(cur, urls).count() == R.join_details(cur, pages, F.col("body_text")).count() == 1
    prev = state(spark, ("a", DAY, "s"), ("a", date(2026, 3, 3), "t"), (None, DAY, "n"))
    assert R.reconcile(cur, prev, F.lit(DAY)).count() == R.describe(cur, prev).count() == R.run(cur, prev, F.lit(DAY)).count() == 1


def test_interrupted_swap_keeps_a_snapshot(spark, tmp_path):
    path = tmp_path / "jobs.csv"
    CSV.write_snapshot(R.run(posts(spark, ("a", "T", "", "x")), state(spark), F.lit(DAY)), str(path))
    path.rename(tmp_path / "jobs.csv.old")  # as if the run ended between putting aside and replacing
    assert [r.id for r in CSV.read_snapshot(spark, str(path), F.lit(DAY)).collect()] == ["a"]


def test_links_resolve_like_in_a_browser(spark):
    rows = [("/a", "https://h.x/p/q?z=1"), ("b", "https://h.x/p/q?z=1"), ("//c.y/d", "https://h.x/p"), ("http://e", "https://h.x"), ("f", "https://h.x")]
    got = spark.createDataFrame(rows, "h string, p string").select(T.resolved_url(F.col("h"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["https://h.x/a", "https://h.x/p/b", "https://c.y/d", "http://e", "https://h.x/f"]
