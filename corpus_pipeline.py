"""The corpus pipeline: toxicity, quality, near-duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept;
its result is written as Parquet and read again. All but the last return the columns of
documents.
"""

from postlake.llm.stages import STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]

#: SQL expresses neither the fitted lexicon nor the tokenizer; the tests have a brute-force version.
ORACLE_SQL = None
