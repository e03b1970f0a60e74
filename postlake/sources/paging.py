"""Lists read from an archive of fetched pages: the ways that sites page, as joins and windows over all lists at once.

starts has a row for each list: source, section, section_no and url. archive has url, html
and maybe error, a row for each page that was fetched. What comes out is what
web.read_pages gives for the same lists: a row for each page up to where the list ends, and
one with page_no -1 and an error where a page was needed that the archive lacks or that
failed. Addresses that count pages have the number at their end.
"""

from __future__ import annotations

from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import html as H
from .storage import kept

_LIST = ("source", "section", "section_no")
COLUMNS = (*_LIST, "page_no", "url", "html", "body_text", "error")
MISSING = "not archived"


def _with_error(archive: DataFrame) -> DataFrame:
    error = F.col("error") if "error" in archive.columns else F.lit(None).cast("string")
    return archive.select(F.col("url").alias("__url"), F.col("html"), F.when(F.col("html").isNull(), F.coalesce(error, F.lit("empty"))).alias("error"))


def with_text(pages: DataFrame, json: bool = False) -> DataFrame:
    """pages with body_text: the text of their html, a line for each block, or the body as it is of JSON pages."""
    if json:
        return pages.withColumn("body_text", F.col("html")).select(*COLUMNS)
    read = H.with_parsed(pages.withColumn("__html", F.col("html")), "__html", "body_text", "text", lambda h: None if h is None else H.body_text(h))
    return read.select(*COLUMNS)


def fetched(starts: DataFrame, archive: DataFrame) -> DataFrame:
    """The page of each start, as its page 0: a list of addresses that is known before."""
    out = starts.join(_with_error(archive), F.col("url") == F.col("__url"), "left")
    error = F.when(F.col("__url").isNull(), F.lit(MISSING)).otherwise(F.col("error"))
    return out.select(*_LIST, F.when(error.isNull(), 0).otherwise(-1).cast("long").alias("page_no"), "url", F.when(error.isNull(), F.col("html")).alias("html"), error.alias("error"))


def _numbered(starts: DataFrame, archive: DataFrame, first: int, step: int, most: int) -> DataFrame:
    """Every list's archived pages with page_no from 0, up to `most`; starts' url ends where the number stands."""
    number = F.regexp_extract("__url", r"(\d{1,18})$", 1)
    pages = _with_error(archive).withColumns({"__n": number.try_cast("long"), "__base": F.regexp_replace("__url", r"\d{1,18}$", "")}).where("__n is not null")
    out = starts.join(pages, F.col("url") == F.col("__base"))
    at = F.col("__n") - first
    out = out.where((at >= 0) & (at % step == 0) & (at < most * step))
    return out.select(*_LIST, F.floor(at / step).cast("long").alias("page_no"), F.col("__url").alias("url"), "html", "error")


def _ended(pages: DataFrame, starts: DataFrame, stop: Column, most: int) -> DataFrame:
    """Pages up to each list's first that stops it, failed or is missing; a row with the error where it did not end by itself.

    stop may be null for a failed page. A list's pages are numbered and bounded by `most`.
    """
    whole = Window.partitionBy(*_LIST).orderBy("page_no")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    halts = F.col("error").isNotNull() | F.coalesce(stop, F.lit(False))
    out = pages.withColumns({"__i": F.row_number().over(whole) - 1, "__halts": halts})
    reached = (F.col("page_no") == F.col("__i")) & ~F.coalesce(F.max("__halts").over(before), F.lit(False))
    out = out.withColumn("__reached", reached).where("__reached")
    good = out.where("error is null").select(*_LIST, "page_no", "url", "html", "error")
    ends = out.groupBy(*_LIST).agg(F.max("page_no").alias("__last"), F.max_by(F.struct("__halts", "error"), "page_no").alias("__end"))
    same = F.lit(True)
    for c in _LIST:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    lists = starts.select(*_LIST, "url").join(ends.withColumnsRenamed({c: f"__{c}" for c in _LIST}), same, "left")
    cut_off = F.col("__last").isNull() | F.col("__end.error").isNotNull() | (~F.col("__end.__halts") & (F.col("__last") < most - 1))
    failed = lists.where(cut_off).select(*_LIST, F.lit(-1).cast("long").alias("page_no"), "url", F.lit(None).cast("string").alias("html"), F.coalesce(F.col("__end.error"), F.lit(MISSING)).alias("error"))
    return good.unionByName(failed)


def by_next(starts: DataFrame, archive: DataFrame, most: int = 50) -> DataFrame:
    """Numbered pages while they have an enabled control that leads to a next one."""
    pages = _numbered(starts, archive, 1, 1, most)
    out = H.with_parsed(pages.withColumn("__html", F.col("html")), "__html", "stop", "flag", lambda h: h is None or H.next_link(h) is None)
    return with_text(_ended(out, starts, F.col("stop"), most))


def by_numbers(starts: DataFrame, archive: DataFrame, most: int = 50) -> DataFrame:
    """Numbered pages up to the largest number on a page's buttons."""
    pages = _numbered(starts, archive, 1, 1, most)
    out = H.with_parsed(pages.withColumn("__html", F.col("html")), "__html", "buttons", "texts", H.page_numbers)
    numbers = F.filter(F.transform("buttons", lambda b: b.try_cast("int")), lambda n: n > 0)
    last = F.coalesce(F.array_max(numbers), F.lit(1))
    return with_text(_ended(out, starts, F.col("page_no") + 1 >= last, most))


def by_offset(starts: DataFrame, archive: DataFrame, size: int = 25, last_offset: int = 1000, most: int = 50) -> DataFrame:
    """JSON pages of `size` items while hasMore and items last, up to an offset."""
    pages = _numbered(starts, archive, 0, size, most)
    body = F.from_json("html", "items array<string>, hasMore boolean")
    more = F.coalesce(body["hasMore"], F.lit(False)) & (F.coalesce(F.size(body["items"]), F.lit(0)) > 0) & ((F.col("page_no") + 1) * size <= last_offset)
    return with_text(_ended(pages, starts, ~more, most), json=True)


def by_growth(starts: DataFrame, archive: DataFrame, rows: str = "", patience: int = 1, most: int = 500) -> DataFrame:
    """Of pages that each have all rows so far, the one after which `patience` had no more; rows: a pattern, the length without."""
    pages = _numbered(starts, archive, 1, 1, most)
    count = F.regexp_count("html", F.lit(rows)) if rows else F.length("html")
    whole = Window.partitionBy(*_LIST).orderBy("page_no")
    before, until = whole.rowsBetween(Window.unboundedPreceding, -1), whole.rowsBetween(Window.unboundedPreceding, 0)
    out = pages.withColumn("__c", F.coalesce(count, F.lit(-1))).withColumn("__grew", F.col("__c") > F.coalesce(F.max("__c").over(before), F.lit(-1)))
    out = out.withColumn("__at", F.max(F.when(F.col("__grew"), F.col("page_no"))).over(until))
    out = _ended(out, starts, F.col("page_no") - F.col("__at") >= patience, most)
    # A failed list has no page to show: what it had grown to is not all.
    failed = out.where("error is not null")
    longest = F.max_by(F.struct("page_no", "url", "html", "error"), F.struct(F.coalesce(F.regexp_count("html", F.lit(rows)) if rows else F.length("html"), F.lit(-1)), -F.col("page_no")))
    good = out.where("error is null").join(failed.select(*_LIST), list(_LIST), "left_anti").groupBy(*_LIST).agg(longest.alias("p")).select(*_LIST, "p.*")
    return with_text(good.unionByName(failed))


def by_links(starts: DataFrame, archive: DataFrame, most: int = 20, anchor: str = "") -> DataFrame:
    """Pages as their next links lead, whatever the addresses; a page without the anchor ends a list.

    The links of all pages are read once; lists then take a step at a time, all together,
    through this narrow table, and texts are joined to the pages that were reached.
    """
    known = _with_error(archive)
    read = H.with_parsed(known.withColumn("__html", F.col("html")), "__html", "__link", "text", lambda h: None if h is None or anchor not in h else H.next_link(h))
    absolute = F.pandas_udf(lambda base, link: base.combine(link, lambda b, x: urljoin(b, x) if x else None), "string")
    has = F.col("html").isNotNull() & (F.contains("html", F.lit(anchor)) if anchor else F.lit(True))
    edges = kept(read.select("__url", has.alias("__has"), F.col("error").alias("__error"), absolute("__url", "__link").alias("__next")))
    at, reached = kept(starts.select(*_LIST, "url")), []
    for n in range(most):
        step = kept(at.join(edges, F.col("url") == F.col("__url"), "left").withColumn("page_no", F.lit(n).cast("long")))
        reached.append(step)
        at = step.where("__has and __next is not null").select(*_LIST, F.col("__next").alias("url"))
        if at.isEmpty():
            break
    steps = reached[0]
    for more in reached[1:]:
        steps = steps.unionByName(more)
    failed = F.col("__url").isNull() | F.col("__error").isNotNull()
    error = F.when(F.col("__url").isNull(), F.lit(MISSING)).otherwise(F.col("__error"))
    places = steps.where(F.col("__has") | failed).select(*_LIST, F.when(failed, -1).otherwise(F.col("page_no")).cast("long").alias("page_no"), "url", error.alias("error"))
    out = places.join(known.select("__url", "html"), F.col("url") == F.col("__url"), "left").select(*_LIST, "page_no", "url", F.when(F.col("error").isNull(), F.col("html")).alias("html"), "error")
    return with_text(out)


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Every list's primary pages, and the fallback's too of those lists of which a page failed."""
    failed = primary.where("error is not null").select(*_LIST).distinct()
    return primary.unionByName(fallback.join(failed, list(_LIST), "left_semi"))
