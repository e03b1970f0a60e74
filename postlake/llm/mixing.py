"""Mixing sources to target weights by temperature.

A source's weight is its share of the tokens to the power a, made to sum to one; a = 1 is
proportional, a = 0 even. Bisection finds the exponent that meets a target entropy, or
the least that keeps to a repetition limit. The weights times the budget give each source
its epochs. Each epoch reads the source in a permutation of its own, in blocks; the last
one stops where the source's budget ends. Native throughout: DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, sent, word_count

#: Times that a document may be read for each time that the least read source is, at most. By
#: default the square root of the largest source's tokens over the least one's, if that is less:
#: half way between proportional and even.
REPETITION = 2.0
#: Halvings of the exponent's range, and exponents that one pass over the sources tries.
STEPS, TRIED = 48, 63
#: Sources up to which the plan is sent to every task; beyond, it is joined by shuffling.
MAX_SENT = 50_000
#: Blocks of an epoch, and blocks of a block.
BLOCKS = 1024
_M = "__mix_"


def token_count(text_col: str) -> Column:
    """Words of a text; 0 for null. DataFrame functions know no tokenizer, so words stand for tokens."""
    return word_count(F.col(text_col))


def exponent(totals: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None) -> tuple[float, float, float]:
    """The exponent a, the sum of all shares to the power a, and all tokens.

    Bisection. What a halving must know of the sources are sums and extremes over them,
    which an aggregation gives for TRIED exponents at once, that is for six halvings; no
    list of sources is gathered.
    """
    some = totals.where("tokens > 0")
    ends = some.agg(F.sum("tokens").alias("n"), F.min("tokens").alias("least"), F.max("tokens").alias("most")).first()
    if ends["n"] is None:
        return 0.0, 1.0, 0.0
    total = float(ends["n"])
    if repetition is None:
        repetition = REPETITION if budget is not None else min(REPETITION, math.sqrt(ends["most"] / ends["least"]))
    share = F.col("tokens") / F.lit(total)

    def measured(exponents: list[float]) -> list[bool]:
        """Whether each exponent makes the mixture flatter than it may be."""
        if entropy is None and budget is None:
            return [(total / ends["least"]) ** (1 - a) / (total / ends["most"]) ** (1 - a) > repetition for a in exponents]
        sums = [x for i, a in enumerate(exponents) for x in (F.sum(F.pow(share, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(share, F.lit(a)) * F.log(share)).alias(f"s{i}"))]
        row = some.agg(*sums).first()
        if entropy is not None:
            # H = ln z - a * sum(p^a ln p) / z
            return [math.log(row[f"z{i}"]) - a * row[f"s{i}"] / row[f"z{i}"] > entropy for i, a in enumerate(exponents)]
        return [(total / ends["least"]) ** (1 - a) / row[f"z{i}"] * budget / total > repetition for i, a in enumerate(exponents)]

    lo, hi = 0.0, 1.0
    if not measured([0.0])[0]:
        hi = 0.0
    steps = 0
    while hi > 0 and steps < STEPS:
        tried = [lo + (hi - lo) * (i + 1) / (TRIED + 1) for i in range(TRIED)]
        flat = measured(tried)
        at = sum(flat)  # flatness falls as the exponent rises
        lo, hi = (tried[at - 1] if at else lo), (tried[at] if at < TRIED else hi)
        steps += (TRIED + 1).bit_length() - 1
    z = some.agg(F.sum(F.pow(share, F.lit(hi))).alias("z")).first()["z"]
    return hi, z, total


def plan(totals: DataFrame, budget: int | None = None, entropy: float | None = None, repetition: float | None = None) -> DataFrame:
    """source, tokens, alpha, weight, epochs, full (whole epochs), rest (tokens of the last one).

    totals: source, tokens; a row for each source. With no budget each source is read
    once at least. With entropy (in nats) given, the exponent meets it as nearly as 0 to 1
    allows; else it is the least at which no source is read more than `repetition` times,
    or, with no budget, than `repetition` times as often as another; see REPETITION for its
    default. A source without tokens has weight 0 and one epoch.
    """
    alpha, z, total = exponent(totals, budget, entropy, repetition)
    share = F.col("tokens") / F.lit(max(total, 1.0))
    weight = F.when(F.col("tokens") > 0, F.pow(share, F.lit(alpha)) / F.lit(z)).otherwise(F.lit(0.0))
    if budget is None:
        most = totals.agg(F.max("tokens").alias("n")).first()["n"] or 0
        size = total * z * (most / total) ** (1 - alpha) if total else 0.0
    else:
        size = float(budget)
    out = totals.select("source", "tokens", F.lit(alpha).alias("alpha"), weight.alias("weight"))
    epochs = F.when(F.col("tokens") > 0, F.col("weight") * F.lit(size) / F.col("tokens")).otherwise(F.lit(1.0))
    # Rounding may leave the least read source a trifle under one.
    out = out.withColumn("epochs", F.round(epochs, 9)).withColumn("full", F.floor("epochs"))
    return out.select("source", "tokens", "alpha", "weight", "epochs", "full", F.round((F.col("epochs") - F.col("full")) * F.col("tokens")).cast("long").alias("rest"))


def _place(id_col: Column, epoch: Column) -> dict[str, Column]:
    """The document's place in the epoch's permutation: block, block within it, hash (60 bits of an MD5)."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), epoch.cast("string")))
    h = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    return {f"{_M}b1": F.pmod(h, F.lit(BLOCKS)), f"{_M}b2": F.pmod(F.shiftright(h, 10), F.lit(BLOCKS)), f"{_M}h": h}


def _ends(base: DataFrame, planned: DataFrame) -> DataFrame:
    """source, e1, e2, eh: the place where the last epoch of each source reaches its budget.

    Blocks' sums come first, then those within the block that the budget ends in, then
    single documents of one of those: no step orders a whole source.
    """
    src = F.col("source").eqNullSafe(F.col("s"))
    rows = base.join(sent(planned.where("rest > 0").select(F.col("source").alias("s"), "full", "rest"), MAX_SENT), src).drop("s")
    rows = rows.withColumns(_place(F.col("id"), F.col("full"))).select("source", "rest", F.col(f"{_M}b1").alias("b1"), F.col(f"{_M}b2").alias("b2"), F.col(f"{_M}h").alias("h"), "tokens")

    def reach(df: DataFrame, left: str, unit: str) -> DataFrame:
        """The first unit at which the running sum goes over what is left, and what is then left for it."""
        sums = df.groupBy("source", unit).agg(F.sum("tokens").alias("n"), F.max(left).alias(left))
        w = Window.partitionBy("source").orderBy(unit).rowsBetween(Window.unboundedPreceding, 0)
        run = sums.withColumn("c", F.sum("n").over(w)).where(F.col("c") > F.col(left))
        return run.groupBy("source").agg(F.min(F.struct(unit, (F.col(left) - F.col("c") + F.col("n")).alias("left"))).alias("m")).select(F.col("source").alias("s"), F.col(f"m.{unit}").alias(f"e_{unit}"), F.col("m.left").alias(f"left_{unit}"))

    one = cut(reach(rows, "rest", "b1"))
    within = rows.join(sent(one, MAX_SENT), src & (F.col("b1") == F.col("e_b1"))).drop("s")
    two = cut(reach(within, "left_b1", "b2"))
    within = within.join(sent(two, MAX_SENT), src & (F.col("b2") == F.col("e_b2"))).drop("s")
    three = reach(within, "left_b2", "h")
    join = one.select("s", F.col("e_b1").alias("e1")).join(two.select(F.col("s").alias("s2"), F.col("e_b2").alias("e2")), F.col("s").eqNullSafe(F.col("s2")), "left").drop("s2")
    return join.join(three.select(F.col("s").alias("s3"), F.col("e_h").alias("eh")), F.col("s").eqNullSafe(F.col("s3")), "left").select(F.col("s").alias("source"), "e1", "e2", "eh")


def _planned(base: DataFrame, budget: int | None, entropy: float | None, repetition: float | None) -> DataFrame:
    """For each source its weight, whole epochs and where its last epoch ends, under names that start with _M."""
    totals = cut(base.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    planned = cut(plan(totals, budget, entropy, repetition))
    ends = _ends(base, planned).withColumnRenamed("source", "s")
    both = planned.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    return sent(cut(both.select(F.col("source").alias(f"{_M}source"), F.col("weight").alias(f"{_M}weight"), *(F.col(c).alias(_M + c) for c in ("full", "rest", "e1", "e2", "eh")))), MAX_SENT)


def _realised(rows: DataFrame, planned: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """Each row as often as its source's plan asks, with epoch, block, sub_block, place (in the sub_block) and weight."""
    c = lambda x: F.col(_M + x)
    rows = rows.join(planned, F.col(source_col).eqNullSafe(c("source")))
    last = c("full") - F.when(c("rest") > 0, F.lit(0)).otherwise(F.lit(1))
    rows = rows.where(last >= 0).withColumn(f"{_M}epoch", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumns(_place(F.col(id_col), c("epoch")))
    before = (c("b1") < c("e1")) | (c("b1") == c("e1")) & ((c("b2") < c("e2")) | (c("b2") == c("e2")) & (c("h") < c("eh")))
    rows = rows.where((c("epoch") < c("full")) | F.coalesce(before, c("e1").isNull()))
    names = {f"{_M}b1": f"{_M}block", f"{_M}b2": f"{_M}sub_block", f"{_M}h": f"{_M}place"}
    return rows.withColumnsRenamed(names).drop(*(_M + x for x in ("source", "full", "rest", "e1", "e2", "eh")))


def _base(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), token_count(text_col).alias("tokens")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, entropy: float | None = None, repetition: float | None = None) -> DataFrame:
    """docs, each row as often as its source's weight asks, with epoch, block, sub_block, place and weight under names that start with _M.

    With no budget every document is there, in epoch 0 at least. A whole epoch has every
    document of the source; the last one those that come before its budget ends in the
    order of its permutation (block, then sub_block, then place). To read a source in that
    order, sort by epoch and those three; rows come in no order of their own. Rows of one
    id stand at the same place and stay or go together; null sources are a source; null
    and empty texts have no tokens and are in whole epochs. An empty table gives no rows.
    Columns of docs must not start with _M. Texts are read twice and not shuffled while
    the plan of up to MAX_SENT sources, which is checked, goes to every task.
    """
    planned = _planned(_base(docs, id_col, text_col, source_col), budget, entropy, repetition)
    return _realised(docs, planned, id_col, source_col)


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, source, epoch, block, sub_block, place, n_tokens, weight (to nine places): a row for each time that a document is read.

    Texts are read once, for their counts.
    """
    base = _base(docs, "doc_id", "text", "source")
    rows = _realised(base, _planned(base, None, None, None), "id", "source")
    return rows.select(F.col("id").alias("doc_id"), "source", *(F.col(_M + c).alias(c) for c in ("epoch", "block", "sub_block", "place")), F.col("tokens").alias("n_tokens"), F.round(f"{_M}weight", 9).alias("weight"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of docs, as they are, each as often as it is read; any names of columns will do."""
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own.values())
    return mixed(plain, own[id_col], own[text_col], own[source_col], **options).select(*own.values()).toDF(*docs.columns)


def oracle() -> str:
    """The query's SQL: the exponent in closed form, and running sums over whole permutations."""
    place = lambda epoch: f"CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || {epoch}), 1, 15) AS BIGINT)"
    least = f"CASE WHEN hi <= lo THEN 0.0 ELSE 1 - ln(least({REPETITION}, sqrt(hi / lo))) / ln(hi / lo) END"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n FROM documents),
    t AS (SELECT source, sum(n)::DOUBLE AS n FROM d GROUP BY source),
    e AS (SELECT sum(n) AS total, min(n) AS lo, max(n) AS hi FROM t WHERE n > 0),
    a AS (SELECT *, {least} AS alpha FROM e),
    z AS (SELECT sum(pow(n / total, alpha)) AS z FROM t, a WHERE n > 0),
    p AS (SELECT source, n, CASE WHEN n > 0 THEN pow(n / total, alpha) / z ELSE 0.0 END AS weight,
            CASE WHEN n > 0 THEN round(pow(n / total, alpha) * total * pow(hi / total, 1 - alpha) / n, 9) ELSE 1.0 END AS epochs FROM t, a, z),
    q AS (SELECT source, weight, floor(epochs)::BIGINT AS whole, round((epochs - floor(epochs)) * n)::BIGINT AS rest FROM p),
    r AS (SELECT d.*, q.weight, q.whole, q.rest FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
    l AS (SELECT *, {place('whole')} AS h FROM r WHERE rest > 0),
    u AS (SELECT source, h, rest, sum(sum(n)) OVER (PARTITION BY source ORDER BY h % {BLOCKS}, (h >> 10) % {BLOCKS}, h) AS run FROM l GROUP BY source, h, rest),
    x AS (SELECT doc_id, source, unnest(range(whole)) AS epoch, n, weight FROM r
          UNION ALL SELECT l.doc_id, l.source, l.whole, l.n, l.weight FROM l JOIN u ON l.source IS NOT DISTINCT FROM u.source AND l.h = u.h WHERE u.run <= u.rest),
    y AS (SELECT *, {place('epoch')} AS h FROM x)
    SELECT doc_id, source, CAST(epoch AS BIGINT) AS epoch, h % {BLOCKS} AS block, (h >> 10) % {BLOCKS} AS sub_block, h AS place, n AS n_tokens, round(weight, 9) AS weight FROM y"""
