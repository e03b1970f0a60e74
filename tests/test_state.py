from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from postlake.streaming import expiry
from postlake.streaming import state as S

DAY = date(2026, 3, 1)
POST = "id string, ingest_seq int, title string, university string, department string, deadline string, description string"


def posts(spark, *rows):
    return spark.createDataFrame([(i, n, t, "HKU", "D", d, x) for n, (i, t, d, x) in enumerate(rows)], POST)


def test_expiry_is_told_once_and_after_a_restart(spark, tmp_path):
    schema, day = "id string, seen date, seq int, deadline date", date.fromisoformat

    def go(*rows):
        spark.createDataFrame([(i, day(s), n, d and day(d)) for n, (i, s, d) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        expiry.run_expiries(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.id, str(r.deadline), str(r.expired_on)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    told = go(("a", "2026-01-01", "2026-01-05"), ("b", "2026-01-01", None), ("c", "2026-01-02", "2026-01-03"), ("d", "2026-01-02", "2026-01-04"), (None, "2026-01-02", "2026-01-03"))
    assert told == []
    # d is given a new deadline before its first one has passed; on the 19th, a is on its last day still.
    told = go(("d", "2026-01-17", "2026-01-20"), ("x", "2026-01-19", None))
    assert told == [("c", "2026-01-03", "2026-01-17")]
    # The same deadline again arms nothing; another one does; a row before the watermark changes nothing.
    told = go(("c", "2026-01-20", "2026-01-03"), ("x", "2026-01-20", None), ("a", "2026-01-05", "2026-05-01"))
    assert told == [("a", "2026-01-05", "2026-01-19"), ("c", "2026-01-03", "2026-01-17")]
    told = go(("c", "2026-01-21", "2026-01-10"), ("b", "2026-01-21", "2026-01-30"), ("b", "2026-01-22", None), ("x", "2026-02-20", None))
    assert told == [("a", "2026-01-05", "2026-01-19"), ("c", "2026-01-03", "2026-01-17"), ("c", "2026-01-10", "2026-01-24"), ("d", "2026-01-20", "2026-02-03")]


def test_a_deadline_that_was_told_and_comes_back_is_told_again(spark, tmp_path):
    schema, day = "id string, seen date, seq int, deadline date", date.fromisoformat

    def go(*rows):
        spark.createDataFrame([(i, day(s), n, d and day(d)) for n, (i, s, d) in enumerate(rows)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        expiry.run_expiries(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        return sorted((r.id, str(r.deadline)) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert go(("a", "2026-01-01", "2026-01-03"), ("x", "2026-01-31", None)) == [("a", "2026-01-03")]
    # Another deadline and the first one again, in one batch.
    assert go(("a", "2026-02-01", "2026-06-01"), ("a", "2026-02-02", "2026-01-03"), ("x", "2026-02-05", None)) == [("a", "2026-01-03")] * 2
    # The same with no deadline between, and one that has not passed yet.
    assert go(("a", "2026-02-06", None), ("a", "2026-02-07", "2026-01-03"), ("b", "2026-02-07", "2026-01-25"), ("x", "2026-02-08", None)) == [("a", "2026-01-03")] * 3
    assert go(("b", "2026-02-08", None), ("b", "2026-02-08", "2026-01-25"), ("x", "2026-02-20", None)) == [("a", "2026-01-03")] * 3 + [("b", "2026-01-25")]


def ids(df):
    return {r.id: (r.is_new, r.date_added) for r in df.collect()}


def test_state_is_not_shuffled(spark, tmp_path):
    state = S.State(spark, str(tmp_path / "s"), buckets=3)
    assert state.read() is None
    S.run(posts(spark, ("a", "Dean", "", "x"), ("b", "T", "", "x")), state, DAY, 0)
    # A second generation, so that the state is a base and changes.
    S.run(posts(spark, ("c", "T", "", "x")), state, DAY + timedelta(1), 1, carry_forward=True)
    out = S.reconciled(posts(spark, ("a", "Dean", "", "x"), ("d", "T", "", "x")), state, DAY + timedelta(2))
    assert ids(out) == {"a": (False, DAY), "d": (True, DAY + timedelta(2))}
    plan = out._jdf.queryExecution().executedPlan().toString()
    initial = plan[plan.index("== Initial Plan ==") :]
    assert initial.count("Exchange") == 1 and "hashpartitioning(id" in initial and "Bucketed: true" in initial
    assert "SortMergeJoin" in initial


def test_versions(spark, tmp_path):
    folder, day = str(tmp_path / "s"), lambda k: DAY + timedelta(k)
    open_ = lambda: S.State(spark, folder, buckets=2, most_changes=1, keep=2)
    assert S.run(posts(spark, ("a", "Dean", "", "x"), ("b", "T", "2026-03-01", "x"), ("a", "later", "", "")), open_(), day(0), 0)
    assert S.run(posts(spark, ("c", "T", "", "x")), open_(), day(1), 1, carry_forward=True)
    assert ids(open_().read()) == {"a": (False, day(0)), "b": (False, day(0)), "c": (True, day(1))}
    # A batch that was committed before changes nothing.
    assert not S.run(posts(spark, ("z", "T", "", "x")), open_(), day(1), 1, carry_forward=True)
    # b closes; the third change makes a new base, and the first version goes.
    assert S.run(posts(spark, ("a", "Dean", "", "y")), open_(), day(20), 2, carry_forward=True)
    last = open_()
    assert ids(last.read()) == {"a": (False, day(0)), "c": (False, day(1))}
    assert [len(g) for g in last.manifest.versions.values()] == [2, 1] and list(last.manifest.versions) == ["1", "2"]
    assert ids(last.read(1)) == {"a": (False, day(0)), "b": (False, day(0)), "c": (True, day(1))}
    with pytest.raises(ValueError, match="kept are 1, 2"):
        last.read(0)
    # Without carrying forward the snapshot is replaced whole.
    assert S.run(posts(spark, ("e", "T", "", "x")), open_(), day(21), 3)
    assert ids(open_().read()) == {"e": (True, day(21))}


def test_a_run_that_is_cut_off_leaves_the_old_version(spark, tmp_path):
    folder = str(tmp_path / "s")
    S.run(posts(spark, ("a", "Dean", "", "x")), S.State(spark, folder, buckets=2), DAY, 0)
    broken = S.State(spark, folder)

    def stop(_):
        raise OSError("cut off")

    broken._swap_pointer = stop
    with pytest.raises(OSError, match="cut off"):
        S.run(posts(spark, ("b", "T", "", "x")), broken, DAY + timedelta(1), 1)
    left = lambda: sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("g"))
    assert ids(S.State(spark, folder).read()) == {"a": (True, DAY)} and len(left()) == 2
    assert S.run(posts(spark, ("b", "T", "", "x")), S.State(spark, folder), DAY + timedelta(1), 1)
    again = S.State(spark, folder)
    assert ids(again.read()) == {"b": (True, DAY + timedelta(1))}
    assert left() == sorted(g for gs in again.manifest.versions.values() for g in gs)


def test_stream_of_versions(spark, tmp_path):
    source, schema = str(tmp_path / "in"), posts(spark).withColumn("run_date", F.lit(DAY)).schema
    for n, rows in enumerate([[("a", "Dean", "", "x"), ("b", "T", "", "x")], [("a", "Dean", "", "x")], []]):
        posts(spark, *rows).withColumn("run_date", F.lit(DAY + timedelta(n))).write.mode("append").parquet(source)
        S.run_stream(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "cp"), buckets=2).awaitTermination()
    assert ids(S.State(spark, str(tmp_path / "out")).read()) == {"a": (False, DAY)}
