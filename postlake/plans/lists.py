"""Lists that are paged in every way, from pages that the orders of each customer make, and what reading them must give.

A customer is a list and its orders are the posts, four to a page, so that lists have the
lengths that the table gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.sources import html as H
from postlake.sources import paging as G

SIZE, PATIENCE = 4, 3
_HOST = "https://lists.example"


def _lists(spark: SparkSession, d: str) -> DataFrame:
    """list, posts (a customer's orders in order), last (its number of pages)."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    lists = orders.groupBy(F.col("o_custkey").alias("list")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("posts"))
    return lists.withColumn("last", F.ceil(F.size("posts") / SIZE).cast("int"))


def _starts(spark: SparkSession, d: str, style: str, tail: str = "/") -> DataFrame:
    lists = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("list")).distinct()
    return lists.select(F.lit("lists").alias("source"), F.col("list").cast("string").alias("section"), F.col("list").alias("section_no"), F.concat(F.lit(f"{_HOST}/{style}/"), F.col("list").cast("string"), F.lit(tail)).alias("url"))


def _each(posts: Column, open_: str, close: str) -> Column:
    return F.array_join(F.transform(posts, lambda k: F.concat(F.lit(open_), k.cast("string"), F.lit(close))), "")


def _pages(spark: SparkSession, d: str, style: str) -> DataFrame:
    """The archive of a style: url, html. Pages go on beyond the last for lists that grow."""
    beyond = {"more": 1, "scroll": PATIENCE}.get(style, 0)
    rows = _lists(spark, d).withColumn("page", F.explode(F.sequence(F.lit(1), F.col("last") + beyond)))
    page, last = F.col("page"), F.col("last")
    own, so_far = F.slice("posts", (page - 1) * SIZE + 1, SIZE), F.slice("posts", 1, page * SIZE)
    number = (page - 1) * SIZE if style == "offset" else page
    html = {
        "next": lambda: F.concat(_each(own, "<p>Ad ", "</p>"), F.when(page < last, F.concat(F.lit("<a title='Next' href='"), (page + 1).cast("string"), F.lit("'>go</a>"))).otherwise("")),
        "disabled": lambda: F.concat(_each(own, "<p>Post ", "</p>"), F.when(page < last, "<a class='page' href='#'>Next</a>").otherwise("<a class='page disabled' href='#'>Next</a>")),
        "numbered": lambda: F.concat(_each(own, "<p>Post ", "</p>"), F.array_join(F.transform(F.sequence(F.lit(1), last), lambda n: F.concat(F.lit("<button>"), n.cast("string"), F.lit("</button>"))), ""), F.lit("<button>Search</button>")),
        "more": lambda: F.concat(F.lit("<table>"), _each(so_far, "<tr><td>", "</td></tr>"), F.lit("</table><!-- "), page.cast("string"), F.lit(" -->")),
        "scroll": lambda: _each(so_far, "<p>Post ", "</p>"),
        "offset": lambda: F.concat(F.lit('{"items": ['), F.array_join(F.transform(own, lambda k: F.concat(F.lit('{"Id": '), k.cast("string"), F.lit("}"))), ", "), F.lit('], "hasMore": '), (page < last).cast("string"), F.lit("}")),
    }[style]()
    return rows.select(F.concat(F.lit(f"{_HOST}/{style}/"), F.col("list").cast("string"), F.lit("/"), number.cast("string")).alias("url"), html.alias("html"))


def _cover(spark: SparkSession, d: str) -> DataFrame:
    """One page of each list, but that of every fifth was never fetched."""
    text = lambda c: F.col(c).cast("string")
    html = F.concat(F.lit("<html><head><title>t</title></head><body><script>var x = '</p>';</script><p>Jobs of list "), text("list"), F.lit("</p><p>"), F.size("posts").cast("string"), F.lit("  posts</p></body></html>"))
    return _lists(spark, d).where("list % 5 <> 4").select(F.concat(F.lit(f"{_HOST}/cover/"), text("list")).alias("url"), html.alias("html"))


def _listed(pages: DataFrame, *more) -> DataFrame:
    return pages.select(F.col("section_no").alias("list"), "page_no", *more)


def _by(read, style: str, **how):
    return lambda s, d: _listed(read(_starts(s, d, style), _pages(s, d, style), **how))


def _static(spark: SparkSession, d: str) -> DataFrame:
    return G.with_text(G.fetched(_starts(spark, d, "cover", ""), _cover(spark, d)))


def _addresses(spark: SparkSession, d: str) -> DataFrame:
    """Every page's address is known before."""
    starts = _starts(spark, d, "numbered").drop("url").join(_lists(spark, d), F.col("section_no") == F.col("list"))
    at = starts.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("last")))).select("source", "section", "section_no", "n", F.concat(F.lit(f"{_HOST}/numbered/"), "section", F.lit("/"), F.col("n").cast("string")).alias("url"))
    return G.fetched(at, _pages(spark, d, "numbered")).where("error is null").select(F.col("section_no").alias("list"), F.regexp_extract("url", r"(\d+)$", 1).cast("bigint").alias("page"))


def _offsets(spark: SparkSession, d: str, archive: DataFrame | None = None) -> DataFrame:
    return G.by_offset(_starts(spark, d, "offset"), _pages(spark, d, "offset") if archive is None else archive, size=SIZE)


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    """JSON lists of which every fifth stops after its first page, and rendered ones in their place."""
    pages = _pages(spark, d, "offset")
    gone = (F.split("url", "/")[4].cast("long") % 5 == 4) & ~F.col("url").endswith("/0")
    primary = _offsets(spark, d, pages.where(~gone))
    return G.with_fallback(primary, G.by_growth(_starts(spark, d, "scroll"), _pages(spark, d, "scroll"), patience=PATIENCE))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """What the pages' own buttons say: their number and the largest page that one leads to."""
    read = H.with_parsed(_pages(spark, d, "numbered"), "html", "buttons", "texts", H.page_numbers)
    numbers = F.filter(F.transform("buttons", lambda b: b.try_cast("bigint")), lambda n: n > 0)
    return read.select("url", F.size("buttons").cast("bigint").alias("buttons"), F.coalesce(F.array_max(numbers), F.lit(1)).alias("largest"))


_L = f"(SELECT o_custkey AS list, count(*) AS posts, CAST(ceil(count(*) / {SIZE}.0) AS BIGINT) AS last FROM orders GROUP BY o_custkey)"
_ALL = f"SELECT list, unnest(range(last)) AS page_no FROM {_L}"
_LAST = f"SELECT list, last - 1 AS page_no FROM {_L}"

#: name: (query, SQL).
QUERIES = {
    "s1_static_scan": (lambda s, d: _listed(_static(s, d), "body_text", F.col("error").isNotNull().alias("failed")), f"SELECT list, CAST(CASE WHEN list % 5 = 4 THEN -1 ELSE 0 END AS BIGINT) AS page_no, CASE WHEN list % 5 <> 4 THEN 'Jobs of list ' || list || chr(10) || posts || ' posts' END AS body_text, list % 5 = 4 AS failed FROM {_L}"),
    "s2_rendered_scan": (lambda s, d: _listed(G.by_growth(_starts(s, d, "scroll"), _pages(s, d, "scroll"), patience=PATIENCE), "body_text"), f"SELECT list, last - 1 AS page_no, body_text FROM {_L} JOIN (SELECT o_custkey, string_agg('Post ' || o_orderkey, chr(10) ORDER BY o_orderkey) AS body_text FROM orders GROUP BY o_custkey) ON list = o_custkey"),
    "s3_json_scan": (lambda s, d: _offsets(s, d).select(F.col("section_no").alias("list"), F.explode(F.from_json("body_text", "items array<struct<Id:bigint>>")["items"]).alias("i")).select("list", "i.Id"), "SELECT o_custkey AS list, o_orderkey AS Id FROM orders"),
    "s7a_url_list": (_addresses, f"SELECT list, unnest(range(1, last + 1)) AS page FROM {_L}"),
    "s7b_next_link": (lambda s, d: _listed(G.by_links(_starts(s, d, "next", "/1"), _pages(s, d, "next"), anchor="Ad")), _ALL),
    "s7c_next_disabled": (_by(G.by_next, "disabled"), _ALL),
    "s7d_numbered": (_by(G.by_numbers, "numbered"), _ALL),
    "s7e_load_more": (_by(G.by_growth, "more", rows="<tr"), _LAST),
    "s7f_offsets": (lambda s, d: _listed(_offsets(s, d)), _ALL),
    "s7g_scroll": (_by(G.by_growth, "scroll", patience=PATIENCE, most=60), _LAST),
    "s8_fallback": (lambda s, d: _listed(_fallback(s, d), F.col("error").isNotNull().alias("failed")), f"SELECT list, CAST(unnest(range(CASE WHEN list % 5 = 4 THEN 1 ELSE last END)) AS BIGINT) AS page_no, false AS failed FROM {_L} UNION ALL SELECT list, -1, true FROM {_L} WHERE list % 5 = 4 AND last > 1 UNION ALL SELECT list, last - 1, false FROM {_L} WHERE list % 5 = 4 AND last > 1"),
    "g3_in_page": (_labels, f"SELECT '{_HOST}/numbered/' || list || '/' || unnest(range(1, last + 1)) AS url, last + 1 AS buttons, last AS largest FROM {_L}"),
    "o2_union_pages": (lambda s, d: G.by_numbers(_starts(s, d, "numbered"), _pages(s, d, "numbered")).groupBy(F.col("section_no").alias("list")).agg(F.count("*").alias("n"), F.max("page_no").alias("last")), f"SELECT list, last AS n, last - 1 AS last FROM {_L}"),
}
