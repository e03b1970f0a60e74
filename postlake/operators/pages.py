"""Order over a whole view: global places by range partitions, and pages by the last row's key.

Rows are dealt to tasks by ranges of the whole order, the tie-break included, and sorted
within them; a task numbers its own rows, and the counts of the tasks before, which are a
few numbers, make the numbers global. However many rows one university, day or deadline
has, they are dealt over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.sources.storage import kept


@dataclass(frozen=True)
class Key:
    """A column to order by."""

    name: str
    descending: bool = False
    nulls_last: bool = True

    def order(self) -> Column:
        c = F.col(self.name)
        if self.descending:
            return c.desc_nulls_last() if self.nulls_last else c.desc_nulls_first()
        return c.asc_nulls_last() if self.nulls_last else c.asc_nulls_first()

    def after(self, value) -> Column:
        """Whether a row's value comes after this one in the order."""
        c = F.col(self.name)
        if value is None:
            return F.lit(False) if self.nulls_last else c.isNotNull()
        beyond = c < F.lit(value) if self.descending else c > F.lit(value)
        return F.coalesce(beyond, F.lit(self.nulls_last))


def placed(rows: DataFrame, keys: Sequence[Key], name: str = "n", parts: int | None = None) -> DataFrame:
    """rows with their place, from 1, in the order of keys, which end in one that tells all rows apart.

    The rows are worked out once and kept, as ranges are drawn from a sample of them first;
    the dealt rows are kept before they are counted, as another draw would deal otherwise.
    Give narrow rows: a key, what orders it, and an id.
    """
    order, rows = [k.order() for k in keys], kept(rows)
    dealt = rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)
    # The number's upper part is the task, the lower 33 bits are the row within it.
    held = kept(dealt.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    task = F.shiftright("__at", 33)
    counts = held.groupBy(task.alias("__task")).agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A row for each task that has rows.
    counts = counts.select("__task", before.alias("__before"))
    out = held.withColumn("__task", task).join(F.broadcast(counts), "__task")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__task", "__before", "__at")


def numbered_pages(rows: DataFrame, keys: Sequence[Key], size: int) -> DataFrame:
    """placed rows with page, from 1."""
    if size < 1:
        raise ValueError("a page has a row at least")
    return placed(rows, keys).withColumn("page", F.floor((F.col("n") - 1) / size) + 1)


def page_after(rows: DataFrame, keys: Sequence[Key], last: Sequence | None, size: int) -> DataFrame:
    """The page that follows the row with the values last of keys; the first one for None.

    Tasks keep their first `size` rows beyond the key and only these meet: no sort of all
    rows, whatever the page.
    """
    if last is not None:
        beyond, same = F.lit(False), F.lit(True)
        for key, value in zip(keys, last, strict=True):
            beyond = beyond | (same & key.after(value))
            same = same & F.col(key.name).eqNullSafe(F.lit(value))
        rows = rows.where(beyond)
    return rows.orderBy(*(k.order() for k in keys)).limit(size)
