from datetime import date

from pyspark.sql import functions as F

from postlake.operators import reconcile as R
from postlake.sources import snapshot as S
from postlake.streaming import snapshots

DAY = date(2026, 3, 1)
POST = "id string, ingest_seq int, title string, university string, department string, deadline string, description string"


def posts(spark, *rows):
    return spark.createDataFrame([(i, n, t, "HKU", "D", d, x) for n, (i, t, d, x) in enumerate(rows)], POST)


def state(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, date_added date, description string")


def test_two_runs(spark):
    first = R.run(posts(spark, ("a", "Dean", "", "x"), ("b", "Tutor", "2026-02-15", "x"), ("c", "Tutor", "2026-02-14", "x"), ("d", "T", "2026-02-01", "x"), ("d", "live", "", "x")), state(spark), F.lit(DAY)).collect()
    assert {r.id: (r.is_new, r.date_added) for r in first} == {"a": (True, DAY), "b": (True, date(2026, 3, 1))}
    later = date(2026, 3, 2)
    second = R.run(posts(spark, ("a", "Dean", "", "x"), ("e", "New", "", "x")), state(spark, *((r.id, r.date_added, r.description) for r in first)), F.lit(later))
    assert {r.id: (r.is_new, r.date_added) for r in second.collect()} == {"a": (False, DAY), "e": (True, later)}
    counts = R.report(second, F.lit(later)).first()
    assert (counts.total, counts.active, counts.new, counts.closed) == (2, 2, 1, 0)


def test_descriptions(spark):
    long, old = "y" * 400, "A good summary."
    cur = posts(spark, ("a", "t", "", long), ("b", "t", "", long), ("c", "t", "", "short"), ("d", "t", "", long + " See application link"), ("e", "t", "", long))
    out = R.describe(cur, state(spark, ("a", DAY, old), ("e", DAY, "z" * 801), ("c", DAY, "")))
    assert {r.id: (r.desc_action, r.description[:4]) for r in out.collect()} == {"a": ("reuse", "A go"), "b": ("summarise", "yyyy"), "c": ("keep", "shor"), "d": ("keep", "yyyy"), "e": ("summarise", "yyyy")}

    def once(text, title, dept):
        if title == "t":
            return text[:5]
        raise ValueError

    assert {r.id: r.description for r in R.summarise(out, once).collect()}["b"] == "yyyyy"


def test_csv_state(spark, tmp_path):
    path = str(tmp_path / "jobs.csv")
    assert S.read_snapshot(spark, path, F.lit(DAY)).count() == 0
    text = 'line one\n"quoted", é'
    done = R.run(posts(spark, ("a", "Dean", "", text), ("b", "T", "", "")), state(spark), F.lit(DAY))
    S.write_snapshot(done, path)
    back = S.read_snapshot(spark, path, F.lit(DAY))
    assert {r.id: (r.date_added, r.description) for r in back.collect()} == {"a": (DAY, text), "b": (DAY, "")}
    S.write_snapshot(R.run(posts(spark, ("a", "Dean", "", text)), back, F.lit(date(2026, 3, 5))), path)  # reads the file that it replaces
    assert [(r.id, r.is_new, r.date_added) for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).collect()] == [("a", "FALSE", "2026-03-01")]
    (tmp_path / "old.csv").write_text("id,description\nx,first\n,blank\nx,last\n")
    assert [tuple(r) for r in S.read_snapshot(spark, str(tmp_path / "old.csv"), F.lit(DAY)).collect()] == [("x", DAY, "last")]


def test_streaks(spark):
    days = spark.createDataFrame([("a", date(2024, 1, d)) for d in (1, 2, 4, 5)], "k string, day date")
    assert {r.day.day: r.first_seen.day for r in R.presence_streaks(days, "k", "day").collect()} == {1: 1, 2: 1, 4: 4, 5: 4}


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    batch = lambda day, *rows: posts(spark, *rows).withColumn("run_date", F.lit(day)).write.mode("append").parquet(source)
    schema = posts(spark, ("a", "t", "", "")).withColumn("run_date", F.lit(DAY)).schema
    for n, (day, rows) in enumerate([(DAY, [("a", "Dean", "", "x"), ("b", "T", "", "x")]), (date(2026, 3, 2), [("a", "Dean", "", "x")])]):
        batch(day, *rows)
        snapshots.run_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), carry_forward=True).awaitTermination()
        got = {r.id: (r.is_new, r.date_added) for r in snapshots.version(spark, str(tmp_path / "out"), n).collect()}
        assert got == ({"a": (True, DAY), "b": (True, DAY)} if n == 0 else {"a": (False, DAY), "b": (False, DAY)})
