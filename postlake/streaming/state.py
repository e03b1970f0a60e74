"""The snapshot as a table of versions, bucketed by id and named by one small pointer file.

A version is a base and the changes after it, each a generation: a folder of Parquet files
bucketed by id. Joining it with a batch shuffles the batch alone, and what comes out has the
buckets' partitioning already, so that the next generation is written as it stands. The
pointer, manifest.json, lists the generations of the last version and of those before it
that are still kept. It is replaced in one step after the data is whole: a run that is cut
off before leaves the old version as it was, and its files are swept up later.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from postlake.functions.text import detect_rank, is_retained
from postlake.operators import reconcile as R

_POINTER = "manifest.json"
#: Columns of a generation besides the posting's own: its version, and whether the id is new in it.
_VERSION = "version"


@dataclass
class Manifest:
    """What the pointer file says: the last version, the batch that made it, and the day and generations of every version kept."""

    version: int
    batch: int
    buckets: int
    schema: str
    versions: dict[str, list[str]] = field(default_factory=dict)
    days: dict[str, str] = field(default_factory=dict)


class State:
    """The versions in a folder that all executors share.

    buckets is fixed when the folder is new. A base is written anew when a version has more
    than `most_changes` generations of changes; `keep` versions stay readable, and the
    generations that none of them names are removed.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 8, most_changes: int = 8, keep: int = 2):
        if keep < 1 or most_changes < 0 or buckets < 1:
            raise ValueError("buckets and keep are 1 at least, most_changes is not negative")
        self.spark, self.folder, self.most_changes, self.keep = spark, folder.rstrip("/"), most_changes, keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.manifest = self._read_pointer()
        self.buckets = self.manifest.buckets if self.manifest else buckets

    # --- The pointer ---------------------------------------------------------------------

    def _read_pointer(self) -> Manifest | None:
        at = self._path(f"{self.folder}/{_POINTER}")
        if not self._files.exists(at):
            return None
        stream = self._files.open(at)
        try:
            return Manifest(**json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _swap_pointer(self, manifest: Manifest) -> None:
        jvm, beside = self.spark.sparkContext._jvm, self._path(f"{self.folder}/.{_POINTER}.{uuid.uuid4().hex}")
        stream = self._files.create(beside)
        stream.write(bytearray(json.dumps(asdict(manifest)).encode()))
        stream.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(beside, self._path(f"{self.folder}/{_POINTER}"), options)
        self.manifest = manifest

    # --- Reading -------------------------------------------------------------------------

    def _name(self, generations: list[str]) -> str:
        """The name in the session's catalog under which a version's files are read in their buckets; its files are not the catalog's."""
        return f"postlake_state_{hashlib.md5(' '.join([self.folder, *generations]).encode(), usedforsecurity=False).hexdigest()}"

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version's rows, the last one's by default; None without one, and an error for one that is not kept.

        They are each id's last row, unless its deadline is past retention on the version's
        day. One look at the pointer tells the folders, however many versions there were.
        is_new holds for rows of the version itself. The rows keep the buckets' partitioning.
        """
        m = self.manifest
        if m is None:
            return None
        version = m.version if version is None else version
        if str(version) not in m.versions:
            raise ValueError(f"version {version} is not kept; kept are {', '.join(m.versions)}")
        generations = m.versions[str(version)]
        name = self._name(generations)
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({m.schema}, generation STRING) USING parquet PARTITIONED BY (generation) CLUSTERED BY (id) INTO {self.buckets} BUCKETS LOCATION '{self.folder}'")
        self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS " + " ".join(f"PARTITION (generation='{g}') LOCATION '{self.folder}/{g}'" for g in generations))
        rows = self.spark.table(name)
        if len(generations) > 1:
            rows = R.keep_last(rows, ["id"], [_VERSION]).where(is_retained(F.col("deadline"), F.lit(m.days[str(version)]).cast("date")))
        return rows.drop("generation").withColumn("is_new", F.col("is_new") & (F.col(_VERSION) == version)).drop(_VERSION)

    # --- Writing -------------------------------------------------------------------------

    def bucketed(self, rows: DataFrame) -> DataFrame:
        """rows, shuffled into the buckets: the only shuffle of a run."""
        return rows.repartition(self.buckets, "id")

    def commit(self, rows: DataFrame, batch: int, day: date, changes: bool = False) -> bool:
        """Makes rows, which are bucketed, the day's version, or with changes the last one with these rows in place of its own of their ids.

        A batch that is not later than the last committed one was committed before, and
        nothing happens: a retried batch is written once. False then.
        """
        m = self.manifest
        if m is not None and batch <= m.batch:
            return False
        version = m.version + 1 if m else 0
        columns = [c for c in rows.columns if c != _VERSION]
        before = list(m.versions[str(m.version)]) if m and changes else []
        if before and len(before) > self.most_changes:
            # Compaction: what stays of the version so far goes into the new base with the changes.
            rest = self.read().join(rows.select("id").hint("merge"), "id", "left_anti").where(is_retained(F.col("deadline"), F.lit(day)))
            rows = rows.unionByName(rest.withColumn("is_new", F.lit(False)), allowMissingColumns=True).select(*columns)
            before = []
        generation = f"g{version:08d}-{uuid.uuid4().hex[:12]}"
        schema = self._write(rows.select(*columns).withColumn(_VERSION, F.lit(version).cast("long")), generation)
        if before and m and schema != m.schema:
            raise ValueError("changes must have the columns of the version that they change")
        known = {**(m.versions if m else {}), str(version): [*before, generation]}
        versions = dict(sorted(known.items(), key=lambda x: int(x[0]))[-self.keep :])
        days = {**(m.days if m else {}), str(version): day.isoformat()}
        self._swap_pointer(Manifest(version, batch, self.buckets, schema, versions, {v: days[v] for v in versions}))
        for v in known.keys() - versions.keys():
            self.spark.sql(f"DROP TABLE IF EXISTS {self._name(known[v])}")
        self.sweep()
        return True

    def _write(self, rows: DataFrame, generation: str) -> str:
        name = f"postlake_write_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "id").option("path", f"{self.folder}/{generation}").saveAsTable(name)
        try:
            return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.spark.table(name).schema)
        finally:
            self.spark.sql(f"DROP TABLE {name}")

    def sweep(self) -> list[str]:
        """Removes generations that no kept version names, those of runs that were cut off among them. One run writes at a time."""
        named = {g for gs in self.manifest.versions.values() for g in gs} if self.manifest else set()
        gone = [s.getPath().getName() for s in self._files.listStatus(self._path(self.folder)) if s.isDirectory() and s.getPath().getName().startswith("g") and s.getPath().getName() not in named]
        for g in gone:
            self._files.delete(self._path(f"{self.folder}/{g}"), True)
        return gone


def reconciled(batch: DataFrame, state: State, day: date, summariser=None) -> DataFrame:
    """The batch's postings of a run against the state, bucketed: first of each id, retention, rank, known and new, descriptions.

    As reconcile.run, but with one shuffle, the batch's: the state is read in its buckets.
    """
    out = R.keep_first(state.bucketed(batch), ["id"], ["ingest_seq"]).where(is_retained(F.col("deadline"), F.lit(day)))
    out = out.withColumn("rank", detect_rank(F.col("title"), F.col("description"))).drop("is_new", "date_added", "ingest_seq")
    last = state.read()
    if last is None:
        last = batch.sparkSession.createDataFrame([], "id string, date_added date, description string")
    return R.summarise(R.joined_last(out, last, F.lit(day), "merge", unique_ids=True), summariser)


def run(batch: DataFrame, state: State, day: date, number: int, carry_forward: bool = False, summariser=None) -> bool:
    """A run: batch, reconciled, becomes the next version. With carry_forward, retained rows of ids that the batch lacks stay."""
    return state.commit(reconciled(batch, state, day, summariser), number, day, changes=carry_forward)


def run_stream(batches: DataFrame, folder: str, checkpoint: str, as_of_col: str = "run_date", carry_forward: bool = False, **options) -> StreamingQuery:
    """A stream's batches as runs over the State in folder; a batch's day is the largest as_of_col of its rows."""

    def write(batch: DataFrame, n: int) -> None:
        day = batch.agg(F.max(as_of_col)).first()[0]
        if day is not None:
            run(batch.drop(as_of_col), State(batch.sparkSession, folder, **options), day, n, carry_forward)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
