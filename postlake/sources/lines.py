"""A sink for text files that is there whole or not at all.

Each task writes its rows as a file; when all are done, the files of the tasks that
succeeded are put in order and the folder takes the old one's place. A failed job leaves
the old folder as it was. Rows are lines already, made by Spark: what a file holds does not
depend on Python. The folder is one that executors and driver share; any that pyarrow's
file systems reach.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    task: int
    file: str
    rows: int


def _files(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = f"/{path[5:].lstrip('/')}"
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, header: str, ending: str):
        self.path, self.header, self.ending = path.rstrip("/"), header, ending
        self.beside = f"{self.path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context, rows = TaskContext.get(), 0
        task = context.partitionId()
        files, beside = _files(self.beside)
        files.create_dir(beside)
        # An attempt has a file of its own: one that is lost does not disturb the next.
        name = f"task-{task:05d}-{context.taskAttemptId()}"
        with files.open_output_stream(f"{beside}/{name}") as out:
            if task == 0 and self.header:
                out.write(self.header.encode())
            for batch in iterator:
                lines = batch.column(0).to_pylist()
                rows += len(lines)
                out.write("".join([x + "\n" for x in lines]).encode())
        return _Written(task, name, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, beside = _files(self.beside)
        _, path = _files(self.path)
        files.create_dir(beside)
        written = sorted((m for m in messages if m is not None), key=lambda m: m.task)
        for n, m in enumerate(written):
            files.move(f"{beside}/{m.file}", f"{beside}/part-{n:05d}{self.ending}")
        from pyarrow import fs

        for left in files.get_file_info(fs.FileSelector(beside)):
            if left.base_name.startswith("task-"):
                files.delete_file(left.path)
        with files.open_output_stream(f"{beside}/_SUCCESS"):
            pass
        if files.get_file_info(path).type != fs.FileType.NotFound:
            # The old folder stands aside until the new one is there; a reader takes either.
            if files.get_file_info(f"{path}.old").type != fs.FileType.NotFound:
                files.delete_dir(f"{path}.old")
            files.move(path, f"{path}.old")
        files.move(beside, path)
        if files.get_file_info(f"{path}.old").type != fs.FileType.NotFound:
            files.delete_dir(f"{path}.old")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        files, beside = _files(self.beside)
        if files.get_file_info(beside).type != fs.FileType.NotFound:
            files.delete_dir(beside)


class Lines(DataSource):
    """format("postlake_lines"): a column of lines; options path, header (the first line, with its end) and ending (of file names)."""

    @classmethod
    def name(cls):
        return "postlake_lines"

    def schema(self):
        return "line string"

    def writer(self, schema, overwrite):
        if not overwrite:
            raise ValueError("postlake_lines replaces its folder: write with mode overwrite")
        return _Writer(self.options["path"], self.options.get("header", ""), self.options.get("ending", ".txt"))


def write_lines(rows: DataFrame, line: Column, path: str, header: str = "", ending: str = ".txt") -> None:
    """Replaces the folder at path by files of lines, one for each task in its order, with the header before the first.

    The files one after the other are what one task would have written.
    """
    rows.sparkSession.dataSource.register(Lines)
    rows.select(line.alias("line")).write.format("postlake_lines").option("path", path).option("header", header).option("ending", ending).mode("overwrite").save()
