"""Incremental runs: each batch of postings becomes the next snapshot.

The state is the snapshot itself, in a folder of Parquet versions; a batch reads the
last version and writes the next, so that a retried batch writes the same one again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlake.functions.text import is_retained
from postlake.operators import reconcile as R

_STATE = ("id", "date_added", "description")


def version(spark: SparkSession, folder: str, n: int) -> DataFrame | None:
    """The n-th snapshot, or None."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{folder}/v{n}/_SUCCESS")
    return spark.read.parquet(f"{folder}/v{n}") if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p) else None


def next_snapshot(batch: DataFrame, last: DataFrame | None, as_of, carry_forward: bool = False) -> DataFrame:
    """The run's snapshot. With carry_forward, retained rows of the last one whose id the batch lacks stay, as known."""
    spark = batch.sparkSession
    state = last.select(*_STATE) if last is not None else spark.createDataFrame([], "id string, date_added date, description string")
    out = R.run(batch, state, as_of)
    if carry_forward and last is not None:
        rest = R.new_rows(last, out).where(is_retained(F.col("deadline"), as_of)).withColumn("is_new", F.lit(False))
        out = out.unionByName(rest, allowMissingColumns=True)
    return out


def run_stream(batches: DataFrame, folder: str, checkpoint: str, as_of_col: str = "run_date", carry_forward: bool = False) -> StreamingQuery:
    """Starts the stream; a batch's day is the largest as_of_col of its rows."""

    def write(batch: DataFrame, n: int) -> None:
        day = batch.agg(F.max(as_of_col)).first()[0]
        if day is None:
            return
        last = next((v for k in range(n - 1, -1, -1) if (v := version(batch.sparkSession, folder, k)) is not None), None) if n else None
        next_snapshot(batch.drop(as_of_col), last, F.lit(day).cast("date"), carry_forward).write.mode("overwrite").parquet(f"{folder}/v{n}")

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
