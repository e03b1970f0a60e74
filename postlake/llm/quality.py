"""Quality rules with thresholds that follow each language and source.

Every measure is counted into fixed bins; the counts of a group are a quantile sketch
that merges by addition, exact to a bin and the same in any order of merging. Each
group's quartiles give its fences, joined back to the documents. Groups with few
documents take the merged sketch of their language, or of everything. Native throughout:
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, cut

#: measure: (bins at most, slack beyond the fence, whether low values fail too).
#: symbols: thousandths of word characters; lines: thousandths of lines that repeat; length: hundredths of characters a word.
MEASURES = {"symbols": (1000, 20, False), "lines": (1000, 250, False), "length": (10_000, 100, True)}
#: Interquartile ranges from the quartiles to the fences, and documents that a group's own sketch needs.
RANGES, LEAST_DOCS = 3, 30
#: Words under which a document fails, and repeated words in a hundred over which it fails (fixed values).
MIN_WORDS, MAX_REPEATED = 50, 50
#: Groups up to which the fences are sent to every task; beyond, they are joined by shuffling.
MAX_SENT = 50_000

_SYMBOLS = "[#*$%&|<>]"
_M = "__quality_"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE_CLASS}+"), "")


def _windows(words: Column, low: Column) -> Column:
    """A long for each three-word window, sorted: its hash in the upper bits, its place in the bits of low.

    Equal windows stand side by side, and plain longs sort without objects.
    """
    n = F.size(words)
    hashed = lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))
    # No null can be there, which coalesce tells the planner: longs that may be null sort as objects.
    packed = lambda w, i: F.coalesce(hashed(w, i).bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")), F.lit(0).cast("long"))
    return F.sort_array(F.slice(F.transform(words, packed), F.lit(1), F.greatest(n - 2, F.lit(0))))


def _ones(n: Column) -> Column:
    """Ones in the bits that a place among n needs."""
    bits = F.ceil(F.log2(F.greatest(n, F.lit(2)).cast("double"))).cast("int")
    return F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long"), F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with what the rules read, in columns whose names start with _M; nothing is shuffled.

    A null text has no words. Windows are compared by the upper bits of a 64-bit hash of
    their words, all but those that the text's places need.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words, lines, low, ordered, places = (F.col(_M + x) for x in ("words", "lines", "low", "windows", "places"))
    out = docs.withColumns({f"{_M}words": _words(text), f"{_M}lines": F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))})
    out = out.withColumn(f"{_M}low", _ones(F.size(words)))
    out = out.withColumn(f"{_M}windows", _windows(words, low))
    # Equal windows differ in the bits of their places alone.
    same = lambda x, j: x.bitwiseXOR(F.coalesce(F.get(ordered, j), F.bitwise_not(x))).between(F.lit(0), low)
    twice = lambda x, i: same(x, i + 1) | same(x, i - 1)
    out = out.withColumn(f"{_M}places", F.sort_array(F.transform(F.filter(ordered, twice), lambda x: F.coalesce(x.bitwiseAND(low), F.lit(0).cast("long")))))
    gaps = F.transform(places, lambda x, i: F.least(F.lit(3).cast("long"), x - F.coalesce(F.get(places, i - 1), x - 3)))
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(_SYMBOLS)),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x),
    }
    # One generated row holds the counts: conditions on them are read from it and cannot be
    # pushed below, where each would work out the arrays again, once for every element.
    one = F.explode(F.array(F.struct(*(v.cast("long").alias(k) for k, v in counts.items())))).alias(f"{_M}counts")
    return out.select(*docs.columns, one).select(*docs.columns, *(F.col(f"{_M}counts.{k}").alias(_M + k) for k in counts))


def _bins() -> dict[str, Column]:
    c = lambda x: F.col(_M + x)
    ratio = lambda a, k, b: F.floor(a * k / F.greatest(b, F.lit(1)))
    values = {"symbols": ratio(c("n_symbols"), 1000, c("word_chars")), "lines": ratio(c("n_dup_lines"), 1000, c("n_lines")), "length": ratio(c("word_chars"), 100, c("n_words"))}
    return {m: F.least(values[m], F.lit(MEASURES[m][0])).cast("long") for m in MEASURES}


def sketches(rows: DataFrame, group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """g1, g2, measure, bin, n: how many measured documents of each group are in each bin.

    Documents of MIN_WORDS words or more are counted; tasks sum before they send, so a
    hot group arrives as a row for each bin and task.
    """
    a, b = group_cols
    bins = F.array(*(F.struct(F.lit(m).alias("measure"), v.alias("bin")) for m, v in _bins().items()))
    long = rows.where(F.col(f"{_M}n_words") >= MIN_WORDS).select(F.col(a).alias("g1"), F.col(b).alias("g2"), F.explode(bins).alias("x"))
    return long.groupBy("g1", "g2", "x.measure", "x.bin").agg(F.count("*").alias("n")).select("g1", "g2", "measure", "bin", "n")


def fences(sketch: DataFrame) -> DataFrame:
    """g1, g2 and, for each measure, its low and high fence."""

    def level(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
        upto = Window.partitionBy(*keys, "measure").orderBy("bin")
        run = merged.withColumn("c", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys, "measure")))
        quartile = lambda q: F.min(F.when(F.col("c") * 4 >= F.col("all") * q, F.col("bin")))
        return run.groupBy(*keys, "measure").agg(F.max("all").alias("n"), quartile(1).alias("q1"), quartile(3).alias("q3"))

    own, by_first, total = level(["g1", "g2"]), level(["g1"]), level([])
    rename = lambda df, k: df.select(*[c for c in df.columns if c in ("g1", "measure")], *(F.col(c).alias(f"{c}_{k}") for c in ("n", "q1", "q3")))
    o, f, t = own.alias("o"), rename(by_first, 1).alias("f"), rename(total, 2).alias("t")
    all_ = o.join(f, F.col("o.g1").eqNullSafe(F.col("f.g1")) & (F.col("o.measure") == F.col("f.measure"))).join(t, F.col("o.measure") == F.col("t.measure"))
    pick = lambda q: F.when(F.col("o.n") >= LEAST_DOCS, F.col(f"o.{q}")).when(F.col("n_1") >= LEAST_DOCS, F.col(f"{q}_1")).otherwise(F.col(f"{q}_2"))
    q = all_.select("o.g1", "o.g2", "o.measure", pick("q1").alias("q1"), pick("q3").alias("q3"))
    spread = RANGES * (F.col("q3") - F.col("q1"))
    side = lambda m, v: F.max(F.when(F.col("measure") == m, v))
    return q.groupBy("g1", "g2").agg(*(x for m, (_, slack, _) in MEASURES.items() for x in (side(m, F.col("q1") - spread - slack).alias(f"low_{m}"), side(m, F.col("q3") + spread + slack).alias(f"high_{m}"))))


def judged(rows: DataFrame, group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """Measured documents with base_failed and kept, under names that start with _M.

    Null languages and sources are groups of their own. Fences of up to MAX_SENT groups,
    which is checked, go to every task; more are joined by shuffling, where hot groups
    are split by Spark's skew handling. Repeated rows count and are judged each for
    itself; an empty table gives no rows. rows is read twice: cut it before.
    """
    limits = cut(fences(sketches(rows, group_cols)).select(*(F.col(c).alias(_M + c) for c in ("g1", "g2", *(f"{s}_{m}" for m in MEASURES for s in ("low", "high"))))))
    if limits.count() <= MAX_SENT:
        limits = F.broadcast(limits)
    a, b = (F.col(c) for c in group_cols)
    out = rows.join(limits, a.eqNullSafe(F.col(f"{_M}g1")) & b.eqNullSafe(F.col(f"{_M}g2")), "left")
    n, rep = F.col(f"{_M}n_words"), F.col(f"{_M}n_repeat_words")
    failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEATED * n)
    fits = [v <= F.col(f"{_M}high_{m}") for m, v in _bins().items()] + [v >= F.col(f"{_M}low_{m}") for m, v in _bins().items() if MEASURES[m][2]]
    verdict = ~failed
    for x in fits:
        verdict = verdict & F.coalesce(x, F.lit(True))
    return out.withColumns({f"{_M}base_failed": failed, f"{_M}kept": verdict})


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document.

    Each text is measured once; counts without texts are kept in the shared folder.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    rows = cut(measured(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    return judged(rows).select("doc_id", *(F.col(_M + c).alias(c) for c in names))


def good_documents(docs: DataFrame, text_col: str = "text", group_cols: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """The rows of docs, as they are, that the rules keep.

    Each text is measured once; documents that fail the base rules count in the sketches
    and their texts are not written again. Columns of docs whose names start with _M are
    kept under them: the measures get out of their way. Null and empty texts have no words
    and go; repeated rows share their fate; an empty table stays empty.
    """
    # Names of the measures must not clash with columns of docs.
    plain = docs.toDF(*(f"__own_{i}" for i in range(len(docs.columns))))
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    rows = measured(plain, own[text_col])
    failed = (F.col(f"{_M}n_words") < MIN_WORDS) | (100 * F.col(f"{_M}n_repeat_words") > MAX_REPEATED * F.col(f"{_M}n_words"))
    rows = cut(rows.withColumn(own[text_col], F.when(~failed, F.col(own[text_col]))))
    kept = judged(rows, tuple(own[c] for c in group_cols)).where(F.col(f"{_M}kept"))
    return kept.select(*(F.col(f"__own_{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)


def oracle() -> str:
    """The query's SQL."""
    space = "\\x20\\x09-\\x0D"
    value = {"symbols": "n_symbols * 1000 // greatest(word_chars, 1)", "lines": "n_dup_lines * 1000 // greatest(n_lines, 1)", "length": "word_chars * 100 // greatest(n_words, 1)"}
    binned = ", ".join(f"least({v}, {MEASURES[m][0]}) AS b_{m}" for m, v in value.items())
    rows = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, b_{m} AS bin FROM base WHERE n_words >= {MIN_WORDS}" for m in MEASURES)
    quart = lambda keys, k: f"""q{k} AS (SELECT {keys} measure, max(total) AS n, min(CASE WHEN c * 4 >= total THEN bin END) AS q1, min(CASE WHEN c * 4 >= 3 * total THEN bin END) AS q3
      FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bin) AS c, sum(n) OVER (PARTITION BY {keys} measure) AS total
            FROM (SELECT {keys} measure, bin, count(*) AS n FROM vals GROUP BY ALL)) GROUP BY ALL)"""  # noqa: E731
    pick = lambda q: f"CASE WHEN a.n >= {LEAST_DOCS} THEN a.{q} WHEN b.n >= {LEAST_DOCS} THEN b.{q} ELSE c.{q} END AS {q}"
    fits = " AND ".join([f"coalesce(b_{m} <= max(CASE WHEN f.measure = '{m}' THEN f.q3 + {RANGES} * (f.q3 - f.q1) + {MEASURES[m][1]} END), true)" for m in MEASURES] + [f"coalesce(b_{m} >= max(CASE WHEN f.measure = '{m}' THEN f.q1 - {RANGES} * (f.q3 - f.q1) - {MEASURES[m][1]} END), true)" for m in MEASURES if MEASURES[m][2]])
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT rid, doc_id, lang, source, text, regexp_extract_all(text, '[^{space}]+') AS w,
            list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS ls FROM d),
    win AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM
      (SELECT rid, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))),
    rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY rid),
    m AS (SELECT w.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[{space}]', '', 'g'))::BIGINT AS word_chars,
            (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
            (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
          FROM w LEFT JOIN rep ON w.rid = rep.rid),
    base AS (SELECT *, {binned} FROM m),
    vals AS ({rows}),
    {quart('lang, source,', 0)}, {quart('lang,', 1)}, {quart('', 2)},
    f AS (SELECT a.lang, a.source, a.measure, {pick('q1')}, {pick('q3')} FROM q0 a JOIN q1 b ON a.lang IS NOT DISTINCT FROM b.lang AND a.measure = b.measure JOIN q2 c ON a.measure = c.measure)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
      (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed,
      NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AND {fits} AS kept
    FROM base LEFT JOIN f ON base.lang IS NOT DISTINCT FROM f.lang AND base.source IS NOT DISTINCT FROM f.source
    GROUP BY rid, doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b_symbols, b_lines, b_length"""
