"""Packing by power-of-two decomposition.

A document of n ids becomes whole pieces of the longest length, then one piece for each
bit that is set in the rest. Every piece is a sequence of its own and lies in the bucket
of its length, so that no sequence crosses documents and none needs padding. Batches are
drawn from one bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .encoding import default_tokenizer, encoder

#: The longest piece, and the id that ends a document (fixed values).
MAX_LENGTH, END_ID = 4096, 2
_FLUSH = 8 << 20


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths, in order, of the pieces of n ids: powers of two that sum to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, longest: int = MAX_LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: document, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset.

    Documents are cut where they are read, without a shuffle. sequence_id is unique
    within the result; a partition numbers its own pieces. A null or empty text is one
    piece that holds the ending id. Repeated rows are packed each for itself, a null
    document id stays null, other columns are not read, and an empty table gives no rows.
    A text is encoded whole, so a worker holds one text and its ids at a time.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    path = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, names = encoder(path), ["id", "start", "length", "ids", "doc_tokens"]
        for b in batches:
            rows, starts, lengths, ids, totals, held = [], [], [], [], [], 0

            def flush():
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(ids, pa.binary()), pa.array(totals, pa.int64())], names)

            for i, text in enumerate(b.column(1)):
                all_ids = coder.encode(text.as_py()) + end
                n, start = len(all_ids) // 4, 0
                for k in piece_lengths(n, longest):
                    rows.append(i)
                    starts.append(start)
                    lengths.append(k)
                    ids.append(all_ids[4 * start : 4 * (start + k)])
                    totals.append(n)
                    start += k
                    held += 4 * k
                    if held >= _FLUSH:
                        yield flush()
                        rows, starts, lengths, ids, totals, held = [], [], [], [], [], 0
            if rows:
                yield flush()

    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint")
    return out.select(F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens", F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the pieces as one folder of Parquet files for each bucket of equal lengths."""
    pieces.write.mode("overwrite").partitionBy("bucket").parquet(path)


def piece_digests(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
