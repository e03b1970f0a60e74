"""Token counts from an exact histogram of encoded lengths.

Documents are counted by encoded length; suffix sums over the lengths then answer, for
every context limit, how many tokens there are, how many remain when every text is cut
at the limit, and which length a given share of the documents reaches.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, tidy
from .encoding import default_tokenizer, encoder

#: Lengths whose suffix sums one task forms; blocks of them are summed first.
BLOCK = 1024


def length_histogram(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """length, n_docs: whole texts by the number of their ids; a null text counts as empty.

    Each task sends a row for each length that it met. Repeated rows count each time,
    other columns are not read, and an empty table gives no rows.
    """
    path = tokenizer or default_tokenizer()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts = encoder(path), Counter()
        for b in batches:
            counts.update(len(coder.encode(t.as_py())) // 4 for t in b.column(0))
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n_docs"])

    parts = docs.select(docs[text_col].cast("string")).mapInArrow(run, "length bigint, n_docs bigint")
    return parts.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length as a context limit: docs_at_least, tokens_at_least, truncated_total, docs_at_most and total_tokens.

    truncated_total is the sum of min(document length, length). Sums within a block of
    BLOCK lengths and over the blocks meet, so that no task holds all lengths. The
    histogram is read twice.
    """
    h = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    later, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(a).over(later), F.lit(0)).alias(b) for a, b in (("bd", "later_docs"), ("bt", "later_tokens"))), F.sum("bd").over(every).alias("all_docs"), F.sum("bt").over(every).alias("total_tokens"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.withColumn("d", F.sum("n_docs").over(within)).withColumn("t", F.sum("tokens").over(within)).join(blocks, "block")
    docs, tokens = F.col("d") + F.col("later_docs"), F.col("t") + F.col("later_tokens")
    return out.select(
        "length", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("total_tokens") - tokens + F.col("length") * docs).alias("truncated_total"),
        (F.col("all_docs") - docs + F.col("n_docs")).alias("docs_at_most"), "total_tokens",
    )


def token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """suffix_sums of the documents' length_histogram, which is counted once and kept in the shared folder."""
    bounded(docs.sparkSession)
    return suffix_sums(cut(length_histogram(docs, text_col, tokenizer)))


def truncated_totals(sums: DataFrame, limits: Sequence[int]) -> DataFrame:
    """context_limit, truncated_total: any limits, answered from the suffix sums alone."""
    # The first length at or over the limit has all documents that the limit cuts.
    first = [F.min_by(F.struct("docs_at_least", "tokens_at_least"), F.when(F.col("length") >= int(k), F.col("length"))).alias(f"s{i}") for i, k in enumerate(limits)]
    one = sums.agg(F.max("total_tokens").alias("total"), *first)
    answer = lambda i, k: F.coalesce(F.col("total") - F.col(f"s{i}.tokens_at_least") + k * F.col(f"s{i}.docs_at_least"), F.col("total"), F.lit(0))
    return one.select(F.explode(F.array(*(F.struct(F.lit(int(k)).cast("long").alias("context_limit"), answer(i, int(k)).alias("truncated_total")) for i, k in enumerate(limits)))).alias("x")).select("x.*")


def length_quantiles(sums: DataFrame, shares: Sequence[float]) -> DataFrame:
    """share, length: the least length that at least that share of the documents does not exceed."""
    total = F.col("docs_at_most") + F.col("docs_at_least") - F.col("n_docs")
    found = [F.min(F.when(F.col("docs_at_most") >= F.ceil(F.lit(float(q)) * total), F.col("length"))).alias(f"q{i}") for i, q in enumerate(shares)]
    one = sums.agg(*found)
    return one.select(F.explode(F.array(*(F.struct(F.lit(float(q)).alias("share"), F.col(f"q{i}").alias("length")) for i, q in enumerate(shares)))).alias("x")).select("x.share", "x.length")
