from datetime import date

import pytest
from pyspark.sql import functions as F

from postlake.functions.rules import PLACEHOLDER
from postlake.operators import metrics
from postlake.operators import reconcile as R
from postlake.sources import lines
from postlake.sources import snapshot as S

DAY = date(2026, 3, 1)


def test_counts_arrive_with_the_run(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "u string, n int")
    found, kept = metrics.Counted("found", "u", ["a", "b", "z"]), metrics.Counted("kept", "u", ["a", "b", "z"])
    out = kept.of(found.of(df).where("n > 1"))
    assert out.count() == 4
    assert found.counts() == {"a": 2, "b": 1, "z": 0} and found.total() == 5
    assert {r.u: (r.found, r.kept) for r in metrics.as_table(spark, "u", found=found, kept=kept).collect()} == {"a": (2, 1), "b": (1, 1), "z": (0, 0)}


def snap(spark, n, parts):
    text = 'line one\n"quoted", é, and , a comma'
    cols = [F.concat(F.lit("i"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("id"), F.when(F.col("id") % 3 == 0, text).when(F.col("id") % 3 == 1, " blank ").otherwise("").alias("title"), F.lit("x").alias("description"), (F.col("id") % 2 == 0).alias("is_new"), F.lit(DAY).alias("date_added")]
    return spark.range(0, n, 1, parts).select(*cols)


def _bytes(folder):
    return b"".join(p.read_bytes() for p in sorted(folder.iterdir()) if p.name.startswith("part-"))


def test_parts_are_the_one_file(spark, tmp_path):
    for n, parts in ((50, 7), (2, 4), (0, 2)):
        S.write_snapshot(snap(spark, n, parts), str(tmp_path / "one"))
        S.write_snapshot_parts(snap(spark, n, parts), str(tmp_path / "parts"))
        files = [p.name for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-")]
        assert len(files) == (parts if n else 1) and _bytes(tmp_path / "parts").startswith(b"id,title,rank")
        if n:
            assert _bytes(tmp_path / "one") == _bytes(tmp_path / "parts")
        back = {r.id: (r.date_added, r.description) for r in S.read_snapshot_parts(spark, str(tmp_path / "parts"), F.lit(DAY)).collect()}
        assert back == {f"i{k:03d}": (DAY, "x") for k in range(n)}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["one", "parts"]
    assert S.read_snapshot_parts(spark, str(tmp_path / "none"), F.lit(DAY)).count() == 0


def test_a_failed_task_leaves_the_old_file(spark, tmp_path):
    S.write_snapshot_parts(snap(spark, 9, 3), str(tmp_path / "s"))
    before = _bytes(tmp_path / "s")
    bad = snap(spark, 20, 4).withColumn("title", F.when(F.col("id") == "i017", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("title")))
    with pytest.raises(Exception, match="no"):
        S.write_snapshot_parts(bad, str(tmp_path / "s"))
    assert _bytes(tmp_path / "s") == before and [p.name for p in tmp_path.iterdir()] == ["s"]
    with pytest.raises(Exception, match="overwrite"):
        snap(spark, 1, 1).select(F.col("id").alias("line")).write.format("postlake_lines").option("path", str(tmp_path / "s")).mode("append").save()
    assert lines._files("file:/x/y")[1] == "/x/y"


def test_a_text_is_summarised_once(spark, tmp_path):
    calls, memo = tmp_path / "calls", str(tmp_path / "memo")
    long = "y" * 400
    rows = [(i, "t", "d", "summarise", f"{long}{i % 3}") for i in range(30)] + [(100, "t", "d", "keep", long), (101, "bad", "d", "summarise", long), (102, None, None, "summarise", long)]
    df = spark.createDataFrame(rows, "id int, title string, department string, desc_action string, description string").repartition(5)

    def summariser(text, title, department):
        with open(calls, "a") as f:
            f.write(f"{title}{text[-1]}\n")
        if title == "bad":
            raise OSError
        return f"s{text[-1]}"

    def got(out):
        return {r.id: r.description for r in out.collect()}

    want = {i: f"s{i % 3}" for i in range(30)} | {100: long, 101: long, 102: "sy"}
    first = R.summarise_once(df, summariser, memo)
    # The run is cut off after its calls, tried again, and its result is read twice.
    assert got(R.summarise_once(df, summariser, memo)) == want == got(first) == got(first)
    called = calls.read_text().split()
    assert sorted(set(called)) == ["bady", "t0", "t1", "t2", "y"] and called.count("bady") == 2
    assert all(called.count(x) == 1 for x in ("t0", "t1", "t2", "y"))


@pytest.mark.parametrize("bits", [64, 1 << 12])
def test_the_filter_has_no_false_negatives(spark, bits):
    ids = spark.range(0, 300, 3).select(F.col("id").cast("string").alias("id"))
    words = R.id_filter(ids, bits=bits)
    assert len(words.first().words) == bits // 64
    rows = spark.range(300).select(F.col("id").cast("string").alias("id"))
    may = {r.id for r in rows.where(R.may_have(words.scalar(), "id", bits)).collect()}
    assert may >= {str(i) for i in range(0, 300, 3)}
    assert len(may) == 300 if bits == 64 else len(may) < 130
    assert R.id_filter(ids.where("id = 'none'"), bits=64).first().words == []
    with pytest.raises(ValueError, match="multiple"):
        R.id_filter(ids, bits=100)


def test_pending_is_exact_whatever_the_filter(spark):
    good, bad = "g" * 100, f"{PLACEHOLDER} {'x' * 100}"
    cache = spark.createDataFrame([(f"i{k}", good if k % 2 else bad) for k in range(0, 200, 2)] + [(f"i{k}", good) for k in range(1, 200, 4)], "id string, description string")
    rows = spark.createDataFrame([(f"i{k}", "", k) for k in range(400)] + [(None, "", 1), ("old", "2020-01-01", 2)], "id string, deadline string, n int")
    want = sorted(str(r.id) for r in R.pending(rows, cache, F.lit(DAY)).collect())
    for bits in (64, 1 << 16):
        out = R.pending_filtered(rows, cache, F.lit(DAY), bits)
        assert sorted(str(r.id) for r in out.collect()) == want and out.columns == rows.columns
    assert sorted(str(r.id) for r in R.pending_filtered(rows, cache.limit(0), F.lit(DAY)).collect()) == sorted([*(f"i{k}" for k in range(400)), "None"])
