"""HTML and text as table functions, for LATERAL joins in SQL.

    register(spark)
    spark.sql("SELECT page_id, l.href FROM pages, LATERAL html_links(html) l")

Rows pass to Python and back in Arrow batches. Schemas come from analyze, which also checks
the arguments before anything runs; a pattern is a constant, which it compiles once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.pandas.types import from_arrow_type
from pyspark.sql.types import IntegralType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import html as H


def _schema(kind: str) -> StructType:
    return from_arrow_type(H.TYPES[kind]).elementType


def _is_text(name: str, argument: AnalyzeArgument) -> None:
    if not isinstance(argument.dataType, StringType):
        raise ValueError(f"{name} takes a string, not {argument.dataType.simpleString()}")


def _of_html(name: str, kind: str, read: Callable[[str | None], list[dict]]) -> type:
    fields = _schema(kind).names

    class Reader:
        """Rows that read finds in a page; none for null."""

        @staticmethod
        def analyze(html: AnalyzeArgument) -> AnalyzeResult:
            _is_text(name, html)
            return AnalyzeResult(schema=_schema(kind))

        def eval(self, html: str | None) -> Iterator[tuple]:
            for row in read(html):
                yield tuple(row[f] for f in fields)

    return Reader


class AnchorWindows:
    """Every match of a pattern in a text with the characters before and after it."""

    @staticmethod
    def analyze(text: AnalyzeArgument, pattern: AnalyzeArgument, before: AnalyzeArgument, after: AnalyzeArgument) -> AnalyzeResult:
        _is_text("anchor_windows", text)
        if not pattern.isConstantExpression or not isinstance(pattern.value, str):
            raise ValueError("anchor_windows takes a constant pattern")
        re.compile(pattern.value)
        for n in (before, after):
            if not isinstance(n.dataType, IntegralType) or not n.isConstantExpression or n.value is None or n.value < 0:
                raise ValueError("anchor_windows takes constant lengths, 0 or more")
        return AnalyzeResult(schema=_schema("windows"))

    def eval(self, text: str | None, pattern: str, before: int, after: int) -> Iterator[tuple]:
        for w in H.windows(text, pattern, before, after):
            yield w["match_no"], w["value"], w["before"], w["after"]


#: Table functions by their names in SQL.
FUNCTIONS = {
    "html_rows": _of_html("html_rows", "rows", H.table_rows),
    "html_links": _of_html("html_links", "links", H.links),
    "html_accordions": _of_html("html_accordions", "accordions", H.accordions),
    "anchor_windows": AnchorWindows,
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    for name, cls in FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, useArrow=True))
