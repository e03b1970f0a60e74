import hashlib
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from postlake.functions import text as T
from postlake.plans.postings import TITLES


def over(spark, values, *exprs):
    rows = [(i, v) for i, v in enumerate(values)]
    out = spark.createDataFrame(rows, "i int, v string").select("i", *(e.alias(f"c{k}") for k, e in enumerate(exprs))).orderBy("i").collect()
    return [tuple(r)[1:] if len(exprs) > 1 else r[1] for r in out]


v = "v"


def test_clean_and_ids(spark):
    values = ["  a\t b\n", None, "", " x y\x1cz ", "é  ü"]
    assert over(spark, values, T.clean(v)) == [" ".join((x or "").split()) for x in values]
    refs = ["260213012", "", None, "a b", "x" * 21, "ä-1_b", " ", "a\n"]

    def want(r):
        k = " ".join(r.split()) if r else "unknown"
        return "POLYU-" + (k if len(k) <= 20 and re.fullmatch(r"[\w\-]+", k) else hashlib.md5(k.encode()).hexdigest()[:10])

    assert over(spark, refs, T.make_id("polyu", F.col(v))) == [want(r) for r in refs]


def test_ranks_and_types(spark):
    got = over(spark, [t for t, _, _ in TITLES], T.detect_rank(F.col(v)), T.detect_type(F.col(v)))
    assert got == [(r, k) for _, r, k in TITLES]
    cases = [("Faculty Positions", "tenure-track roles", "Tenure-Track"), ("Faculty Position", "a lecturer", "Lecturer"), ("Faculty Position", "non-tenure tenure-track lecturer", "Lecturer"), ("Faculty Positions", "", "Other"), (None, None, "Other"), ("Facultyx Position", "lecturer", "Other"), ("non-tenure tenure track dean", "", "Senior Management")]
    df = spark.createDataFrame(cases, "t string, d string, want string")
    assert df.where(T.detect_rank(F.col("t"), F.col("d")) != F.col("want")).count() == 0


def test_dates(spark):
    cases = {"27 February 2026": "2026-02-27", "2026-02-27": "2026-02-27", "27/02/2026": "2026-02-27", "12/Mar/2026": "2026-03-12", "02/13/2026": "2026-02-13", "03/04/2026": "2026-04-03", "30 Feb 2026": "30 Feb 2026", "Until filled": "Until filled", "March 5, 2026": "2026-03-05", "5  mar 2026 ": "2026-03-05", "Mar 05, 2026": "2026-03-05", "": "", "N": "N"}
    assert over(spark, list(cases), T.parse_date(v)) == list(cases.values())
    day = date(2026, 3, 1)
    deadlines = ["", "Until filled", None, *(str(day - timedelta(n)) for n in (-1, 0, 1, 14, 15))]
    got = over(spark, deadlines, T.is_active(T.text(v), F.lit(day)), T.is_retained(T.text(v), F.lit(day)))
    assert got == [(True, True)] * 5 + [(False, True), (False, True), (False, False)]


def test_departments(spark):
    cases = {"Lecturer in Data Science": "Data Science", "Research Assistant in AI": "", "Lecturer in Nursing (Full-time)": "Nursing (Full-time)", "Lecturer in Nursing (3 posts)": "Nursing", "Professor in Finance / Senior Lecturer": "Finance", "Head of Human Resources": "Human Resources", "Officer (Library Services)": "Library Services", "Officer (2 posts)": "", "Clerk (Several posts)": ""}
    assert over(spark, list(cases), T.infer_department(F.col(v))) == list(cases.values())


def test_splits(spark):
    c = F.col(v)
    assert over(spark, ["Senior HR Officer, Human Resources Office", "a", "a, b ,c"], *T.last_comma(c)) == [("Senior HR Officer", "Human Resources Office"), ("a", ""), ("a, b", "c")]
    assert over(spark, ["Dean, School of Law", "Dean, Hong Kong", "Dean"], *T.last_comma_department(c)) == [("Dean", "School of Law"), ("Dean, Hong Kong", ""), ("Dean", "")]
    assert over(spark, ["Math - Tutor - x", "Math - A – Tutor", "Tutor"], *T.first_dash(c)) == [("Math", "Tutor - x"), ("Math - A", "Tutor"), ("", "Tutor")]
    assert over(spark, ["Post (Ref.: 25/1/X), School", "Post"], *T.inline_reference(c)) == [("25/1/X", "Post, School"), ("", "Post")]
    assert over(spark, ["/x", "y", "http://z"], T.absolute_url(c, "http://b"), T.prefixed_url(c, "http://b")) == [("http://b/x", "http://b/x"), ("y", "http://by"), ("http://z", "http://z")]
    assert over(spark, ['{"Title": "", "title": "t"}', "{}"], T.json_first(c, "Title", "title")) == ["t", ""]


@pytest.mark.parametrize("n", [60, 61])
def test_lines(spark, n):
    text = "\n".join(["x" * n, "short", "y" * 70])
    assert over(spark, [text], T.substantive(v)) == ["\n\n".join(x for x in ["x" * n, "y" * 70] if len(x) > 60)]
    parts = F.split(v, r"\|")
    assert over(spark, ["a|A|b||a"], T.distinct_paragraphs(parts)) == ["a\n\nb"]
    one, two = "p" * 200, "q" * 200
    assert over(spark, [f"{'r' * 150}|{one}|{two}|{'s' * 5000}"], T.longest_block(parts)) == [one]
    assert over(spark, ["Deadline is near for this post|until the position is filled|A long enough paragraph."], T.content_paragraphs(parts)) == ["A long enough paragraph."]
