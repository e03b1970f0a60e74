"""Expiry of postings as a stream: each one once, when the clock passes its deadline and the days after it.

The clock is the watermark: the last day on which rows were seen, less the delay allowed
for late ones. Postings are dealt into buckets by a hash of the id. A bucket is a key with
one state and one timer, that of what falls due next, in the RocksDB store, so that what is
held does not depend on memory, and only buckets that have rows or where something falls due
are read. Within a bucket all is done on arrays: a call of Python for each posting, with
some six messages between Python and the store, took most of the time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from postlake.functions import rules

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "id string, due long"
#: Buckets of postings. A bucket that has rows in a batch is read and written whole; a
#: checkpoint keeps the number that it began with.
BUCKETS = 1024
_HELD = pa.schema([("id", pa.string()), ("seen", pa.int64()), ("seq", pa.int64()), ("due", pa.int64()), ("told", pa.bool_())])


def packed(held: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _HELD) as out:
        out.write_table(pa.Table.from_pandas(held, _HELD, preserve_index=False))
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pd.DataFrame:
    with pa.ipc.open_stream(data) as source:
        return source.read_all().to_pandas()


def advanced(held: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """What is held after rows (id, seen, seq, due), and what (id, due) expired among them.

    held has, per id, when its row was seen, that row's number and due time (-1: none), and
    whether its expiry was told. Rows count in the order of seen and seq (of equal ones the
    least due time); those not after what is held change nothing. A run of rows of one due
    time ends with the first row of another one, and expired if that was seen after it.
    """
    rows = rows.assign(told=False, new=True)
    if held is not None:
        rows = pd.concat([held.assign(new=False), rows], ignore_index=True)
    code, ids = pd.factorize(rows["id"])
    seen, seq, due, told, new = (rows[c].to_numpy(t) for c, t in (("seen", np.int64), ("seq", np.int64), ("due", np.int64), ("told", bool), ("new", bool)))
    least = np.iinfo(np.int64).min
    since, after = np.full(len(ids), least), np.full(len(ids), least)
    known = np.zeros(len(ids), bool)
    since[code[~new]], after[code[~new]], known[code[~new]] = seen[~new], seq[~new], True
    late = new & known[code] & ((seen < since[code]) | (seen == since[code]) & (seq <= after[code]))
    order = np.lexsort((due, seq, seen, code))
    order = order[~late[order]]
    code, seen, seq, due, told = (x[order] for x in (code, seen, seq, due, told))
    other = np.append(True, code[1:] != code[:-1])
    once = other | np.append(True, (seen[1:] != seen[:-1]) | (seq[1:] != seq[:-1]))
    code, seen, seq, due, told, other = (x[once] for x in (code, seen, seq, due, told, other))
    first = np.flatnonzero(other | np.append(True, due[1:] != due[:-1]))
    last = np.append(first[1:], len(code)) - 1
    # A run begins with what is held, if anything of it is.
    told, end = told[first], np.append(code[first[1:]] != code[first[:-1]], True)
    following = np.append(seen[first[1:]], least)
    gone = ~end & ~told & (due[first] >= 0) & (due[first] < following)
    kept = last[end]
    out = pd.DataFrame({"id": ids[code[kept]], "seen": seen[kept], "seq": seq[kept], "due": due[kept], "told": told[end]})
    return out, pd.DataFrame({"id": ids[code[first[gone]]], "due": due[first[gone]]})


class _Expiry(StatefulProcessor):
    """Per bucket: what is held of its postings (packed), and the time of its timer (-1: none).

    A timer stands one millisecond after the least due time that was not told: the day itself still counts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.postings = handle.getValueState("postings", "timer long, held binary")

    def _keep(self, held: pd.DataFrame, stands: int) -> None:
        due = held["due"].to_numpy()[(held["due"].to_numpy() >= 0) & ~held["told"].to_numpy(bool)]
        wanted = int(due.min()) + 1 if len(due) else -1
        if stands != wanted:
            if stands >= 0:
                self.handle.deleteTimer(stands)
            if wanted >= 0:
                self.handle.registerTimer(wanted)
        self.postings.update((wanted, packed(held)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.postings.get()
        batch = pd.concat([r[["id", "seen_ms", "seq", "due"]] for r in rows], ignore_index=True).rename(columns={"seen_ms": "seen"})
        held, told = advanced(None if before is None else unpacked(bytes(before[1])), batch)
        self._keep(held, -1 if before is None else before[0])
        if len(told):
            yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.postings.get()
        if before is None or before[0] != expiredTimerInfo.getExpiryTimeInMs():
            return
        # All that falls due until the clock: the timer is that of the first of them.
        held, now = unpacked(bytes(before[1])), max(before[0], timerValues.getCurrentWatermarkInMs())
        told = ~held["told"] & (held["due"] >= 0) & (held["due"] + 1 <= now)
        self._keep(held.assign(told=held["told"] | told), -1)  # a timer that told is gone by itself
        yield held.loc[told, ["id", "due"]].reset_index(drop=True)

    def close(self) -> None:
        pass


@contextmanager
def rocksdb(spark: SparkSession):
    """The session with the state store that timers need; a query started within keeps it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def expiries(rows: DataFrame, days: int = rules.RETENTION_DAYS, delay: str = "0 seconds", buckets: int = BUCKETS) -> DataFrame:
    """id, deadline, expired_on of the stream rows(id, seen, seq, deadline), where seen and deadline are dates.

    A posting expires when rows of a later day than deadline + days have been seen, by the
    watermark. A row with another deadline than the posting's last one re-arms it, also
    after an expiry, and if it comes before the last one has passed, that one is not told.
    A null deadline never expires, and disarms. Rows count in the order of seen and seq,
    within a batch and between batches; one that is older than what is known, or than the
    watermark, changes nothing. Rows with a null id or a null day are left out.
    """
    at_day = lambda day: F.unix_millis(day.cast("timestamp"))
    seen = F.col("seen").cast("timestamp")
    keyed = rows.where("id is not null and seen is not null").select("id", seen.alias("seen"), at_day(F.col("seen")).alias("seen_ms"), F.coalesce(F.col("seq").cast("long"), F.lit(-(1 << 63))).alias("seq"), F.coalesce(at_day(F.date_add("deadline", days)), F.lit(-1)).alias("due"))
    keyed = keyed.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    told = keyed.withWatermark("seen", delay).groupBy("bucket").transformWithStateInPandas(_Expiry(), _OUT, "append", "eventTime")
    day = F.timestamp_millis("due").cast("date")
    return told.select("id", F.date_sub(day, days).alias("deadline"), day.alias("expired_on"))


def run_expiries(rows: DataFrame, out: str, checkpoint: str, days: int = rules.RETENTION_DAYS, delay: str = "0 seconds", buckets: int = BUCKETS) -> StreamingQuery:
    """Works off what rows has and appends the expiries to Parquet files in out; the checkpoint is where a later run goes on, with the same buckets."""
    with rocksdb(rows.sparkSession):
        return expiries(rows, days, delay, buckets).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
