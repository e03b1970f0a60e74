"""From postings of one run to the next snapshot: dedup, retention, known and new, descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions import rules
from postlake.functions.text import contains_any, detect_rank, is_active, is_retained, text


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order of arrival; null is a key like any other.

    Tasks keep one row a key before they shuffle, so that a hot key costs a row a task;
    only the columns that are read later go along. Rows that tie are equal in keys and
    order, and any one of them stays.
    """
    return _keep(df, keys, [F.asc(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, in the same way."""
    return _keep(df, keys, [F.desc(c) for c in order])


def _keep(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).where("__n = 1").drop("__n")


def unique(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value for each key that is not null, the largest: a side that is joined must not multiply rows."""
    return keep_last(df.select(key, value).where(F.col(key).isNotNull()), [key], [value])


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Sources one after the other; ingest_seq orders rows by source, then as they came."""
    from functools import reduce

    if not parts:
        raise ValueError("no source gave rows")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _known(previous: DataFrame, *columns: str) -> DataFrame:
    """The last snapshot's columns under names that start with __, a row for each id: a repeated one has its last date."""
    rows = keep_last(previous.select("id", *columns).where(F.col("id").isNotNull()), ["id"], list(columns))
    return rows.select(*(F.col(c).alias(f"__{c}") for c in ("id", *columns)))


def _dated(joined: DataFrame, as_of: Column) -> DataFrame:
    known = F.col("__id").isNotNull()
    return joined.withColumns({"is_new": ~known, "date_added": F.when(known, F.col("__date_added")).otherwise(as_of)})


def reconcile(current: DataFrame, previous: DataFrame, as_of: Column) -> DataFrame:
    """current with is_new and date_added: a known id keeps its date, a new one gets as_of."""
    out = current.drop("is_new", "date_added").join(_known(previous, "date_added"), F.col("id") == F.col("__id"), "left")
    return _dated(out, as_of).drop("__id", "__date_added")


def new_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select("id"), "id", "left_anti")


def known_rows(current: DataFrame, previous: DataFrame) -> DataFrame:
    return current.join(previous.select("id"), "id", "left_semi")


def good_cached(d: Column) -> Column:
    """A cached description that saves a fetch: no placeholder, over 80 characters."""
    d = text(d)
    return ~F.contains(d, F.lit(rules.PLACEHOLDER)) & (F.length(d) > rules.GOOD_CACHED)


def good_summary(d: Column) -> Column:
    """An earlier description that is a summary: no placeholder of either kind, up to 800 characters."""
    d = text(d)
    return (d != "") & ~contains_any(d, (rules.PLACEHOLDER, rules.SEE_LINK)) & (F.length(d) <= rules.LONGEST_SUMMARY)


def restore_cached(current: DataFrame, cache: DataFrame) -> DataFrame:
    """A good cached description in place of the run's own. cache: id, description."""
    good = unique(cache.where(good_cached(F.col("description"))), "id", "description")
    out = current.join(good.select(F.col("id").alias("__id"), F.col("description").alias("__d")), F.col("id") == F.col("__id"), "left")
    return out.withColumn("description", F.coalesce("__d", "description")).drop("__id", "__d")


def override_urls(current: DataFrame, urls: DataFrame) -> DataFrame:
    """apply_url by reference where urls(reference, href) has one; url_changed tells that it differs."""
    one = unique(urls, "reference", "href").select(F.col("reference").alias("__r"), F.col("href").alias("__h"))
    out = current.join(one, F.col("reference") == F.col("__r"), "left")
    changed = F.coalesce(F.col("__h") != F.col("apply_url"), F.lit(False))
    return out.withColumn("url_changed", changed).withColumn("apply_url", F.coalesce("__h", "apply_url")).drop("__r", "__h")


def invalidate(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """The cache without ids whose URL changed."""
    return cache.join(changed.where("url_changed").select("id"), "id", "left_anti")


def zip_by_ordinal(rows: DataFrame, links: DataFrame, page: list[str], order: list[str], link_order: str, fallback: Column) -> DataFrame:
    """The i-th row of a page with the page's i-th link; the fallback beyond the last."""
    at = Window.partitionBy(*page).orderBy(*order)
    left = rows.withColumn("__n", F.row_number().over(at))
    right = links.select(*(F.col(c).alias(f"__{c}") for c in page), F.col("href").alias("__href"), F.row_number().over(Window.partitionBy(*page).orderBy(link_order)).alias("__m"))
    same = F.col("__n") == F.col("__m")
    for c in page:
        same = same & (F.col(c) == F.col(f"__{c}"))
    return left.join(right, same, "left").withColumn("apply_url", F.coalesce("__href", fallback)).drop("__n", "__m", "__href", *(f"__{c}" for c in page))


def pending(current: DataFrame, cache: DataFrame, as_of: Column) -> DataFrame:
    """Retained rows without a good cached description: those whose detail page is due."""
    good = cache.where(good_cached(F.col("description"))).select("id")
    return current.where(is_retained(F.col("deadline"), as_of)).join(good, "id", "left_anti")


#: Bits of a Bloom filter of ids, and how many of them an id sets.
FILTER_BITS, FILTER_HASHES = 1 << 23, 4


def _bits(key: str, bits: int, hashes: int) -> list[Column]:
    """An id's places in the filter."""
    return [F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(bits).cast("long")) for i in range(hashes)]


def id_filter(ids: DataFrame, key: str = "id", bits: int = FILTER_BITS, hashes: int = FILTER_HASHES) -> DataFrame:
    """One row with `words`: a Bloom filter of ids as an array of longs, bits / 64 of them whatever the ids.

    Tasks set the bits of their own ids in words first, and these are merged; an empty
    array stands for no ids. bits is a multiple of 64.
    """
    if bits <= 0 or bits % 64 or hashes < 1:
        raise ValueError("bits is a multiple of 64, hashes is 1 at least")
    at = ids.where(F.col(key).isNotNull()).select(F.explode(F.array(*_bits(key, bits, hashes))).alias("b"))
    words = at.select(F.shiftright("b", 6).alias("w"), F.expr("shiftleft(1L, cast(b & 63 AS INT))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    filled = ids.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("w"), "left").select("id", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("id", "m"))), lambda x: x["m"])
    return filled.agg(F.when(F.bit_or("m") != 0, ordered).otherwise(F.array().cast("array<bigint>")).alias("words"))


def may_have(words: Column, key: str, bits: int = FILTER_BITS, hashes: int = FILTER_HASHES) -> Column:
    """Whether a filter's words may have the row's id: true for all that it was made of, and for few others."""
    out = F.col(key).isNotNull() & (F.size(words) > 0)
    for b in _bits(key, bits, hashes):
        word = F.get(words, F.shiftright(b, 6).cast("int"))
        out = out & (F.call_function("getbit", word, b.bitwiseAND(F.lit(63)).cast("int")) == 1)
    return out


def pending_filtered(current: DataFrame, cache: DataFrame, as_of: Column, bits: int = FILTER_BITS, hashes: int = FILTER_HASHES) -> DataFrame:
    """pending(), where rows whose id cannot have a good cached description do not go through the join.

    The filter of good ids, of bits / 8 bytes, is worked out once and applied where current
    is read; what it lets through is joined, so that the result is exact whatever it lets
    through. Rows with a null id are pending.
    """
    good = cache.where(good_cached(F.col("description"))).select("id")
    words = id_filter(good, "id", bits, hashes).scalar()
    retained = current.where(is_retained(F.col("deadline"), as_of)).withColumn("__may", may_have(words, "id", bits, hashes))
    sure = retained.where(~F.col("__may")).drop("__may")
    return sure.unionByName(retained.where("__may").drop("__may").join(good, "id", "left_anti").select(*sure.columns))


def join_details(current: DataFrame, details: DataFrame, extract: Column) -> DataFrame:
    """description from the detail page of the row's URL; the row's own where there is none. details: url, body_text."""
    one = unique(details.select("url", extract.alias("x")), "url", "x").select(F.col("url").alias("__u"), F.col("x").alias("__x"))
    out = current.join(one, F.col("apply_url") == F.col("__u"), "left")
    return out.withColumn("description", F.coalesce(F.nullif("__x", F.lit("")), "description")).drop("__u", "__x")


def _described(joined: DataFrame) -> DataFrame:
    own = text("description")
    due = (F.length(own) > rules.LEAST_TO_SUMMARISE) & ~contains_any(own, (rules.PLACEHOLDER, rules.SEE_LINK))
    reuse = good_summary(F.col("__description"))
    out = joined.withColumn("desc_action", F.when(reuse, "reuse").when(due, "summarise").otherwise("keep"))
    return out.withColumn("description", F.when(reuse, F.col("__description")).otherwise(own))


def describe(current: DataFrame, previous: DataFrame) -> DataFrame:
    """description and desc_action: an earlier summary is reused; else a long scraped text is due for a summary; else it stays."""
    out = current.join(_known(previous, "description"), F.col("id") == F.col("__id"), "left")
    return _described(out).drop("__id", "__description")


def summarise(rows: DataFrame, summariser=None) -> DataFrame:
    """Descriptions due for a summary, through summariser(text, title, department) in batches; as they are without one.

    The summariser's failures leave a text as it is. Materialise the result before it is
    used twice: an outside summariser may answer differently.
    """
    if summariser is None:
        return rows
    from collections.abc import Iterator

    import pyarrow as pa

    names, at = rows.columns, rows.columns.index("description")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d, t, dept, action in zip(*(b.column(names.index(c)).to_pylist() for c in ("description", "title", "department", "desc_action"))):
                if action == "summarise":
                    try:
                        d = summariser(d[: rules.LONGEST], t, dept)
                    except Exception:  # noqa: BLE001  the text as it is stands in for any failure
                        pass
                out.append(d)
            yield b.set_column(at, b.schema.field(at), pa.array(out, b.schema.field(at).type))

    return rows.mapInArrow(run, rows.schema)


def summarise_once(rows: DataFrame, summariser, memo: str) -> DataFrame:
    """summarise(), but a text is summarised once, however many rows, runs or retries have it.

    memo is a folder, shared by all executors, of the summaries so far, by a checksum of
    what the summariser is given. What is due and not there yet is called for first, each
    once, and written; then all rows take their summaries from there. A run that is cut off
    later and tried again finds them. A failed call is not remembered, and its text stays.
    """
    spark, names = rows.sparkSession, rows.columns
    given = [F.left("description", F.lit(rules.LONGEST)), F.coalesce("title", F.lit("")), F.coalesce("department", F.lit(""))]
    key = F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(given)))), 256)
    keyed = rows.withColumn("__key", F.when(F.col("desc_action") == "summarise", key))
    schema = "key string, summary string"
    known = lambda: spark.read.schema(schema).parquet(memo) if _exists(spark, memo) else spark.createDataFrame([], schema)
    due = keyed.where("__key is not null").groupBy("__key").agg(*(F.first(c).alias(n) for c, n in zip(given, ("text", "title", "department"), strict=True)))
    due = due.join(known().select(F.col("key").alias("__key")), "__key", "left_anti")
    _called(due, summariser, schema).write.mode("append").parquet(memo)
    # Two runs at once may both have called for a text; one of the answers stands.
    one = unique(known(), "key", "summary").select(F.col("key").alias("__k"), F.col("summary").alias("__s"))
    out = keyed.join(one, F.col("__key") == F.col("__k"), "left")
    return out.withColumn("description", F.coalesce("__s", "description")).select(*names)


def _exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _called(due: DataFrame, summariser, schema: str) -> DataFrame:
    """key, summary of due(__key, text, title, department), without those whose call failed."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, summaries = [], []
            for k, *args in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    summaries.append(summariser(*args))
                    keys.append(k)
                except Exception:  # noqa: BLE001, S112  the text as it is stands in for any failure
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(summaries, pa.string())], ["key", "summary"])

    return due.select("__key", "text", "title", "department").mapInArrow(run, schema)


def presence_streaks(history: DataFrame, key: str, day: str) -> DataFrame:
    """first_seen of each key and day: the first day of the unbroken run of days that holds it."""
    days = history.select(key, day).distinct()
    w = Window.partitionBy(key).orderBy(day)
    island = F.date_sub(day, F.row_number().over(w))
    return days.withColumn("__i", island).withColumn("first_seen", F.min(day).over(Window.partitionBy(key, "__i"))).drop("__i")


def joined_last(current: DataFrame, previous: DataFrame, as_of: Column, hint: str | None = None, unique_ids: bool = False) -> DataFrame:
    """current with what the last snapshot says of its ids: is_new, date_added, description and desc_action, by one join. unique_ids: the snapshot has no id twice."""
    names = ("id", "date_added", "description")
    known = previous.select(*(F.col(c).alias(f"__{c}") for c in names)) if unique_ids else _known(previous, *names[1:])
    out = current.drop("is_new", "date_added").join(known.hint(hint) if hint else known, F.col("id") == F.col("__id"), "left")
    return _described(_dated(out, as_of)).drop("__id", "__date_added", "__description")


def run(current: DataFrame, previous: DataFrame, as_of: Column, summariser=None) -> DataFrame:
    """The whole run in its order: first of each id, retention, rank again with the description, known and new, descriptions."""
    out = keep_first(current, ["id"], ["ingest_seq"])
    out = out.where(is_retained(F.col("deadline"), as_of)).withColumn("rank", detect_rank(F.col("title"), F.col("description")))
    return summarise(joined_last(out, previous, as_of), summariser)


def report(snapshot: DataFrame, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """total, active, new and closed counts."""
    live = is_active(F.col("deadline"), as_of)
    out = snapshot.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if("is_new").alias("new"))
    return out.withColumn("closed", F.col("total") - F.col("active"))
