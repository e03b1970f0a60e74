import random

import pytest
from pyspark.sql import functions as F

from postlake.operators import index, pages
from postlake.operators import view as V
from postlake.sources import html as H
from postlake.sources import sites as S
from postlake.sources import tables
from postlake.sources.web import Start, read_pages

ALPHABET = "abc \x00é"


def initial(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("== Initial Plan ==") :] if "== Initial Plan ==" in plan else plan


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    r = random.Random(3)
    texts = {f"k{i}": "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for i in range(300)}
    texts |= {"empty": "", "null": None, "one": "a", "upper": "x", "long": "abc é" * 2000}
    folder = str(tmp_path_factory.mktemp("index"))
    rows = spark.createDataFrame(list(texts.items()), "key string, t string").repartition(3)
    index.build(rows, folder, "key", F.lower("t"), part_rows=20)
    return folder, {k: (t or "").lower() for k, t in texts.items()}


@pytest.mark.parametrize("words", ["a", "é", "AB", "abc", " ab", "c aé", "cab a", "zzz", "abc éabc éabc éabc é", "b\x00", "\x00\x00", ""])
def test_search_is_exact(spark, indexed, words):
    folder, texts = indexed
    got = sorted(r.key for r in index.search(spark, folder, words).collect())
    assert got == sorted(k for k, t in texts.items() if words.lower() in t)


def test_search_reads_candidates_only(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("common text "), F.when(F.col("id") == 500, "needle").otherwise("hay")).alias("t")).coalesce(1)
    index.build(rows, str(tmp_path), "id", F.col("t"), part_rows=50)
    spark.conf.set("spark.sql.adaptive.enabled", False)  # so that the plan has its figures
    try:
        found = index.search(spark, str(tmp_path), "needle")
        assert [r.key for r in found.collect()] == ["500"]
        plan = found._jdf.queryExecution().executedPlan()
        assert "dynamicpruning" in plan.toString()
        leaves = plan.collectLeaves()
        read = [leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()) if leaves.apply(i).metrics().contains("numFiles")]
        assert read == [1]  # of the texts' 20 parts
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_places_over_many_tasks(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, 1, 2, 2, 2]), r.choice("ab")) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, day int, u string").repartition(4)
    keys = (pages.Key("u", descending=True), pages.Key("day"), pages.Key("id"))
    want = sorted(rows, key=lambda x: (-ord(x[2]), x[1] is None, x[1] or 0, x[0]))
    out = pages.placed(df, keys, parts=7)
    assert [x.id for x in sorted(out.collect(), key=lambda x: x.n)] == [x[0] for x in want]
    assert out.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 200
    assert {x.page for x in pages.numbered_pages(df, keys, 60).collect()} == set(range(1, 10))


def test_keyset_pages(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, 1, 2, 3])) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, day int")
    for descending, nulls_last in ((False, True), (True, True), (True, False), (False, False)):
        keys = (pages.Key("day", descending, nulls_last), pages.Key("id"))
        sign = -1 if descending else 1
        want = sorted(rows, key=lambda x: ((x[1] is None) == nulls_last, sign * (x[1] or 0), x[0]))
        last, got = None, []
        while page := pages.page_after(df, keys, last, 20).collect():
            got += [(x.id, x.day) for x in page]
            last = (page[-1].day, page[-1].id)
        assert got == want


def test_one_source_opens_its_files_alone(spark, tmp_path):
    page = "<table><tr><td>529001</td><td><a href='/en/3'>Lecturer in Law</a></td><td>Faculty of Law</td></tr></table>"
    pages_ = spark.createDataFrame([(s, "s", 0, 0, f"https://x/{s}", page, "") for s in ("hku", "cuhk", "sfu")], "source string, section string, section_no long, page_no long, url string, html string, body_text string")
    S.archive(pages_, str(tmp_path / "a"))
    out, errors = S.collect(S.archived(spark, str(tmp_path / "a")), "hku")
    assert not errors and [r.id for r in out.collect()] == ["HKU-529001"]
    plan = initial(out)
    assert "PartitionFilters: [isnotnull(source" in plan and "= hku" in plan
    leaves = out._jdf.queryExecution().executedPlan().collectLeaves()
    assert out.select("id").count() == 1 and leaves.size() >= 1


def test_filters_reach_the_page_source(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def fetch(url):
        with open(seen, "a") as f:
            f.write(url + "\n")
        return f"<p>{url}</p>"

    starts = [Start(s, "list", f"https://x/{s}") for s in ("a", "b", "c")]
    out = read_pages(spark, starts, fetch, 0).where("source = 'b'")
    assert out.rdd.getNumPartitions() == 1
    assert [r.source for r in out.collect()] == ["b"] and set(open(seen).read().split()) == {"https://x/b"}
    assert read_pages(spark, starts, fetch, 0).where("source in ('a', 'c') and page_no = 0").count() == 2


def test_table_functions(spark):
    tables.register(spark)
    html = "<table><tr><td>1<td><a href='/x'>y</a></tr></table><p>z"
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    rows = spark.sql("SELECT id, r.* FROM {df}, LATERAL html_rows(html) r", df=df).collect()
    assert [(r.id, r.row_no, [c.text for c in r.cells], r.href) for r in rows] == [(1, 0, ["1", "y"], "/x")]
    assert rows[0].cells[1].asDict() == H.table_rows(html)[0]["cells"][1]
    links = spark.sql("SELECT id, l.link_no, l.href, l.text FROM {df}, LATERAL html_links(html) l", df=df).collect()
    assert [tuple(r) for r in links] == [(1, 0, "/x", "y")]
    text = spark.createDataFrame([("xx ID: 7 yy ID: 8",), (None,)], "t string")
    found = spark.sql("SELECT w.* FROM {t}, LATERAL anchor_windows(t, 'ID: (\\\\d)', 3, 2) w", t=text).collect()
    assert [tuple(r) for r in found] == [(0, "7", "xx ", " y"), (1, "8", "yy ", "")]
    with pytest.raises(Exception, match="constant pattern"):
        spark.sql("SELECT w.* FROM {t}, LATERAL anchor_windows(t, t, 3, 2) w", t=text).collect()
    with pytest.raises(Exception, match="takes a string"):
        spark.sql("SELECT r.* FROM {df}, LATERAL html_rows(id) r", df=df).collect()


def test_areas_by_a_table_of_rules(spark):
    rules = spark.createDataFrame([(2, "Law", "law"), (1, "Music", "Opera"), (1, "Music", "sing"), (3, "None", None), (3, "None", ""), (2, "Art", "law"), (None, "Late", "tutor")], "place int, area string, word string")
    df = spark.createDataFrame([("Lawful opera", "x"), ("Tutor", "LAW"), ("Tutor", None), ("Dean", "Registry"), (None, None)], "t string, d string")
    got = [r[0] for r in df.select(V.area_of_rules(rules, F.col("t"), F.col("d"))).collect()]
    assert got == ["Music", "Art", "Late", "Other", "Other"]
    own = spark.createDataFrame([(i, a, w) for i, (a, words) in enumerate(V.AREAS) for w in words], "place int, area string, word string")
    both = spark.createDataFrame([("Lecturer in Nursing Law", "Music"), ("Officer", "")], "t string, d string").select(V.area_of_rules(own, F.col("t"), F.col("d")), V.area(F.col("t"), F.col("d"))).collect()
    assert all(r[0] == r[1] for r in both)
    assert df.select(V.area_of_rules(rules.limit(0), F.col("t"), F.col("d")).alias("a")).distinct().collect()[0].a == "Other"
    with pytest.raises(ValueError, match="over 2"):
        V.area_of_rules(rules, F.col("t"), F.col("d"), most=2)
