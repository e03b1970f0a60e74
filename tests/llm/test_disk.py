"""What steps leave on disk while their session goes on."""

import time

from pyspark.sql import functions as F

from postlake.llm import components as C
from postlake.llm.common import CLEAN_SHUFFLES, cut


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {p for p in (files.apply(i).getName() for i in range(files.size())) if p.startswith("shuffle_")}


def test_what_a_cut_shuffled_goes_at_once(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEAN_SHUFFLES)
    rows = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    got = cut(rows.join(rows.select("k", F.lit(1).alias("one")).groupBy("k").count().hint("merge"), "k"))
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert not left and got.count() == 7
    assert spark.conf.get(CLEAN_SHUFFLES) == setting


def test_rounds_of_few_edges_have_few_tasks(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(C, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r.node: r.root for r in C.components(spark.range(40).select("id", (F.col("id") + 1).alias("v")).toDF("u", "v")).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == dict.fromkeys(range(41), 0)
    assert max(df.rdd.getNumPartitions() for df in kept[1:]) <= spark.sparkContext.defaultParallelism
