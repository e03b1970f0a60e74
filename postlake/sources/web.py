"""Pages from the web as a Spark data source, and the ways that sites page their lists.

A fetcher is any callable url -> text that raises on failure; it runs on executors, one
partition for each start, and one row for each page comes out, with an error in place of
the page where fetching failed. Without a fetcher pages come over HTTP.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urljoin

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from .html import body_text, next_link, page_numbers

SCHEMA = "source string, section string, section_no long, page_no long, url string, html string, body_text string, error string"
#: Seconds to wait for a page and between pages, and what a request says of itself.
TIMEOUT, PAUSE = 15, 1.0
HEADERS = {"User-Agent": "Mozilla/5.0 (compatible; postlake)", "Accept-Language": "en-US,en;q=0.9"}


def http(url: str) -> str:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=HEADERS), timeout=TIMEOUT) as r:  # noqa: S310  sources are a parameter
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


@dataclass(frozen=True)
class Start:
    """A list to read: where it starts, how it goes on, and where it ends at the latest."""

    source: str
    section: str
    url: str
    section_no: int = 0
    paging: str = "one"  # one, next, numbered, offset, grow
    most: int = 50  # pages, clicks or rounds
    size: int = 25  # items of a JSON page
    last_offset: int = 1000  # of JSON pages
    anchor: str = ""  # what every page of the list has
    rows: str = ""  # what a growing list has more of, as a pattern; its length by default
    patience: int = 1  # rounds without growth that end a growing list


def pages(start: Start, fetch: Callable[[str], str]) -> Iterator[tuple[int, str, str]]:
    """page_no, url, text of a list's pages, until its own end or its bounds.

    one: the page alone. next: while it has an enabled link to a next one, which is
    followed, or gives the number in `{page}` if it has no address. numbered: up to the
    largest number on its buttons. offset: JSON pages of `size` items (`{offset}`) while
    hasMore and items last. grow: page after page (`{page}`) until `patience` of them had
    no more rows than the longest; that one has all. A page without the anchor ends a list.
    """
    if start.paging == "one":
        yield 0, start.url, fetch(start.url)
        return
    at, longest, still = None, -1, 0
    url = start.url.replace("{page}", "1").replace("{offset}", "0")
    for n in range(start.most):
        text = fetch(url)
        if start.anchor and start.anchor not in text:
            break
        following = start.url.replace("{page}", str(n + 2)).replace("{offset}", str((n + 1) * start.size))
        if start.paging == "grow":
            count = len(re.findall(start.rows, text)) if start.rows else len(text)
            if count > longest:
                longest, still, at = count, 0, (n, url, text)
            else:
                still += 1
                if still >= start.patience:
                    break
            url = following
            continue
        yield n, url, text
        if start.paging == "next":
            link = next_link(text)
            if link is None or not link and following == start.url:
                break
            following = urljoin(url, link) if link else following
        if start.paging == "numbered" and n + 1 >= max([1, *(int(x) for x in page_numbers(text) if re.fullmatch(r"[1-9]\d*", x))]):
            break
        if start.paging == "offset":
            body = json.loads(text)
            if not body.get("hasMore") or not body.get("items") or (n + 1) * start.size > start.last_offset:
                break
        url = following
    if at:
        yield at


@dataclass
class _List(InputPartition):
    start: Start

    def __init__(self, start: Start):
        self.start = start


class _Reader(DataSourceReader):
    def __init__(self, starts: list[Start], fetch, pause: float):
        self.starts, self.fetch, self.pause = starts, fetch, pause

    def pushFilters(self, filters):
        """Takes over equalities of source and section: lists of others are not fetched."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at in (("source",), ("section",)) and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.starts = [s for s in self.starts if getattr(s, at[0]) in values]
            else:
                yield f

    def partitions(self):
        return [_List(s) for s in self.starts]

    def read(self, partition):
        s = partition.start
        try:
            for n, url, text in pages(s, self.fetch):
                if n and self.pause:
                    time.sleep(self.pause)
                yield s.source, s.section, s.section_no, n, url, text, text if s.paging == "offset" else body_text(text), None
        except Exception as e:  # noqa: BLE001  a failed list is a row that says so
            yield s.source, s.section, s.section_no, -1, s.url, None, None, f"{type(e).__name__}: {e}"


class Pages(DataSource):
    """format("postlake_pages"): options starts (JSON) and fetch (a pickled callable as hexadecimal)."""

    @classmethod
    def name(cls):
        return "postlake_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        fetch = self.options.get("fetch")
        return _Reader([Start(**x) for x in json.loads(self.options["starts"])], cloudpickle.loads(bytes.fromhex(fetch)) if fetch else http, float(self.options.get("pause", PAUSE)))


def read_pages(spark: SparkSession, starts: list[Start], fetch: Callable[[str], str] | None = None, pause: float = PAUSE) -> DataFrame:
    """All lists' pages; a partition for each list. Where a source or section is asked for, other lists are not fetched."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Pages)
    reader = spark.read.format("postlake_pages").option("starts", json.dumps([s.__dict__ for s in starts])).option("pause", pause)
    return (reader.option("fetch", cloudpickle.dumps(fetch).hex()) if fetch else reader).load()


def with_fallback(primary: DataFrame, fallback: Callable[[], DataFrame]) -> DataFrame:
    """The primary list's pages, and the fallback's too if any of its pages failed."""
    return primary.unionByName(fallback()) if primary.where("error is not null").limit(1).count() else primary
