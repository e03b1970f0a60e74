"""Counts that arrive with a run: taken where the rows pass, not by another pass over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Counted:
    """Counts rows by a column's values, which are known before, as a plan runs.

    counts() waits for an action over a DataFrame that of() gave, and must come after it.
    Stages that are run again after a lost executor may be counted again: these are
    progress figures, as a log has them, and no part of the result.
    """

    def __init__(self, name: str, column: str, values: Sequence[str]):
        self.column, self.values, self._seen = column, list(values), Observation(name)

    def of(self, rows: DataFrame) -> DataFrame:
        """rows, counted as they pass. Once for each object."""
        each = [F.count_if(F.col(self.column) == v).alias(f"v{i}") for i, v in enumerate(self.values)]
        return rows.observe(self._seen, F.count(F.lit(1)).alias("all"), *each)

    def counts(self) -> dict[str, int]:
        seen = self._seen.get
        return {v: seen[f"v{i}"] for i, v in enumerate(self.values)}

    def total(self) -> int:
        return self._seen.get["all"]


def as_table(spark: SparkSession, column: str, **counted: Counted) -> DataFrame:
    """The counts of several places of a run beside each other, a row for each value."""
    found = {name: c.counts() for name, c in counted.items()}
    values = next(iter(counted.values())).values
    schema = ", ".join([f"{column} string", *(f"{name} long" for name in counted)])
    return spark.createDataFrame([(v, *(f[v] for f in found.values())) for v in values], schema)
