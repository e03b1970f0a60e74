"""The snapshot file: a CSV of the posting columns, read as state and replaced whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from postlake.functions.rules import COLUMNS
from postlake.functions.text import text
from postlake.operators.reconcile import keep_last

from .lines import write_lines

_CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def read_snapshot(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """id, date_added, description of the last run: the last row of each id, none without the file.

    Rows with a blank id are left out. date_added is as_of where the file has no such
    column, and null where the field is blank. In a folder, files go by their names; a
    file with line breaks in its fields is read by one task, in its own order.
    """
    fs, path_of = _fs(spark, path)
    at = _settled(fs, path_of, path)
    if at is None:
        return spark.createDataFrame([], StructType([StructField(c, StringType()) for c in ("id", "date_added", "description")])).withColumn("date_added", F.col("date_added").cast("date"))
    return _last_rows(spark.read.options(**_CSV).csv(at), as_of)


def read_snapshot_parts(spark: SparkSession, path: str, as_of: Column) -> DataFrame:
    """The same of what write_snapshot_parts wrote: only the first file has a header."""
    fs, path_of = _fs(spark, path)
    at = _settled(fs, path_of, path)
    if at is None:
        return read_snapshot(spark, path, as_of)
    rows = spark.read.options(**_CSV | {"header": False}).schema(", ".join(f"`{c}` string" for c in COLUMNS)).csv(at)
    header = F.lit(True)
    for c in COLUMNS:
        header = header & F.col(c).eqNullSafe(F.lit(c))
    return _last_rows(rows.where(~header), as_of)


def _last_rows(rows: DataFrame, as_of: Column) -> DataFrame:
    added = F.try_to_date(F.col("date_added"), "yyyy-MM-dd") if "date_added" in rows.columns else as_of
    rows = rows.select(F.trim(text("id")).alias("id"), added.alias("date_added"), (text("description") if "description" in rows.columns else F.lit("")).alias("description"), F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    return keep_last(rows.where("id <> ''"), ["id"], ["f", "n"]).drop("f", "n")


def _fields(snapshot: DataFrame) -> list[Column]:
    """The posting columns in order, as text."""
    flags = {"is_new": F.when(F.col("is_new"), "TRUE").otherwise("FALSE"), "date_added": F.date_format("date_added", "yyyy-MM-dd")}
    return [(flags.get(c, F.col(c)) if c in snapshot.columns else F.lit("")).cast("string").alias(c) for c in COLUMNS]


def write_snapshot_parts(snapshot: DataFrame, path: str) -> None:
    """The same lines as write_snapshot's, one file for each task: nothing meets in one task.

    The first file begins with the header; all files one after the other are the one file.
    A failed run leaves the old folder. read_snapshot_parts reads them again.
    """
    options = {"quote": '"', "escape": '"', "emptyValue": ""}
    line = F.coalesce(F.to_csv(F.struct(*_fields(snapshot)), options), F.lit(""))
    write_lines(snapshot, line, path, ",".join(COLUMNS) + "\n", ".csv")


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    """The posting columns in order as one CSV file, as its readers expect it.

    Written beside the old one, which is put aside before the new one takes its place and
    deleted after: the input may be the old file, and at no time is there no whole
    snapshot. For large states write the Parquet versions of streaming.snapshots.
    """
    out = snapshot.select(*_fields(snapshot))
    whole = path.rstrip("/")
    beside, aside = f"{whole}.{uuid.uuid4().hex}", f"{whole}.old"
    out.coalesce(1).write.options(**{k: v for k, v in _CSV.items() if k != "multiLine"}, emptyValue="").csv(beside)
    fs, path_of = _fs(snapshot.sparkSession, path)
    old, kept = path_of(whole), path_of(aside)
    if fs.exists(old):
        fs.delete(kept, True)
        fs.rename(old, kept)
    fs.rename(path_of(beside), old)
    fs.delete(kept, True)


def _settled(fs, path_of, path: str) -> str | None:
    """Where the last whole snapshot is: at path, or aside where a swap was cut short."""
    return next((p for p in (path.rstrip("/"), path.rstrip("/") + ".old") if fs.exists(path_of(p))), None)


def elements(details: DataFrame, most: int = 40) -> DataFrame:
    """What a detail page is made of, for looking at: tag, class, id and text of its first elements, cut to 100 characters."""
    from .html import elements as read
    from .html import with_parsed

    out = with_parsed(details.select("url", "html"), "html", "parts", "elements", lambda h: read(h, most, "div", "td", "table", "p"))
    return out.select("url", F.posexplode("parts").alias("n", "part")).select("url", F.col("n").cast(LongType()).alias("n"), "part.*")
