"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space (fixed value): a word is a run of anything else.
SPACES = " \t\n\x0b\x0c\r"
#: The same and its opposite as classes of a regular expression.
SPACE_CLASS, WORD_CLASS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: Bytes of a batch that goes to a Python worker at once, but for a single row that is longer.
BATCH_BYTES = "8m"
#: Rows of ids up to which they are sent to every task, through the driver; beyond, they are joined by shuffling.
MAX_SENT = 100_000
#: Bytes of such a row; of wider ones as many fewer are sent.
SENT_ROW = 32
#: Rows of a key from which it is a hot one, and no longer meets in one task.
HOT_ROWS = 10_000
#: Rows of ids from which a task is worth its files.
TASK_ROWS = 10_000
#: Share of the driver's largest heap from which a cut has the driver collect its garbage.
HEAP_SHARE = 0.4
#: Spark's setting that removes the files of an execution's shuffles at its end.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def bounded(spark: SparkSession) -> SparkSession:
    """The session, with batches for Python workers bounded by bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one in spark.checkpoint.dir.

    Where none is named, a local session gets a temporary one, as in tests; on a cluster
    that is an error, because executors do not see each other's folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Removes a folder of a run, wherever it is."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, from where a lost executor's part is read again.

    What was shuffled for it is read by nothing else, and is removed from the executors'
    disks at once, not when the driver happens to collect its garbage. That garbage, plans
    and sent tables of the steps before, would let the driver's heap grow to its limit over
    many steps, however little is in use, and goes when the heap has grown.
    """
    spark = bounded(df.sparkSession)
    shared_folder(spark)
    before = spark.conf.get(CLEAN_SHUFFLES)
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        return df.select("*").checkpoint()  # a frame keeps the setting of when it was made
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
        lessen_heap(spark)


def lessen_heap(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage, and give memory back, if its heap has grown to HEAP_SHARE of what it may be."""
    jvm = spark.sparkContext._jvm
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() >= HEAP_SHARE * heap.maxMemory():
        jvm.java.lang.System.gc()


def narrowed(df: DataFrame, rows: int) -> DataFrame:
    """df in as many tasks as its rows, at most so many, ask for: every task leaves files, also one of few rows."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))


def stored(df: DataFrame) -> DataFrame:
    """df, written as a table in the shared folder and read from there: readers of a few columns read these only."""
    path = f"{shared_folder(bounded(df.sparkSession))}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame, most: int = MAX_SENT, row_bytes: int = SENT_ROW) -> DataFrame:
    """df, which is read twice, marked for sending to every task if its rows, which are counted, are few for their width."""
    return F.broadcast(df) if df.count() * max(row_bytes, SENT_ROW) <= most * SENT_ROW else df


def with_looked_up(rows: DataFrame, found: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """rows inner-joined with found, which has a row for each key, by a key of any skew.

    Keys of HOT_ROWS rows or more are few, at most one for so many rows, so their part of
    found goes to every task and their rows stay where they are; the others are joined by
    shuffling. The bound rises with the rows, so that never more than MAX_SENT are sent.
    """
    total = rows.count() if total is None else total
    heavy = max(HOT_ROWS, -(-total // MAX_SENT))
    if total < heavy:
        return rows.join(found, key)
    hot = cut(rows.groupBy(key).agg(F.count("*").alias("__rows")).where(F.col("__rows") >= heavy).join(found, key).drop("__rows"))
    names = F.broadcast(hot.withColumnRenamed(key, "__key"))
    stays = rows.join(names, F.col(key) == F.col("__key")).drop("__key")
    rest = rows.join(F.broadcast(hot.select(F.col(key).alias("__key"))), F.col(key) == F.col("__key"), "left_anti")
    return stays.unionByName(rest.join(found, key))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the worker gives memory that it no longer uses back: workers wait for other tasks beside the JVM."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of one C library, not of every
    if trim:
        trim(0)


def ascii_words(text: str | None) -> list[bytes]:
    """The text's words, A-Z lower-cased, as UTF-8; bytes.split() cuts at exactly SPACES."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")
