"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

A word of length l is cut in two even halves. Of two words one edit apart, the shorter's
one half is in the other unchanged: at its place, or moved by one if the other is longer.
So each word is indexed by its halves, and probed by its own halves for words of its
length, and by the substrings that stand where the halves of a word of one less would. What
meets is compared once, letter by letter.

Words that share a half with very many others are not compared with all of them: within
such a half the other one is left out a letter at a time, at a known place. Two words meet
there only if they are one edit apart, and a group has at most as many words as there are
letters. So a hot half costs each of its words as many rows as it has letters.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, tidy, with_looked_up

#: A run of letters, A-Z lower-cased (fixed value).
RUNS = re.compile("[a-zÀ-ÿ]+")
#: Letters and occurrences that a word has at least; how many times as frequent as a word its form is; of how many runs one loses a letter (fixed values of the query).
LEAST_LENGTH, LEAST_COUNT, FACTOR, MISSPELT = 7, 2, 10, 31
#: Words that share a half up to which they are compared with all that probe it.
COMPARED = 48
#: Distinct words that a task counts before it passes them on.
_HELD = 200_000


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int = MISSPELT) -> DataFrame:
    """word, n: runs of letters of whole texts, A-Z lower-cased, and how often they occur.

    Of the pairs of document and run one in `misspelt` loses a letter, by a checksum of
    both (0: none does); a null id counts as an empty one. Words that are shorter or rarer
    are left out. Tasks pass on partial counts of a bounded number of words; null texts
    have none, repeated rows count each time, and other columns are not read.
    """
    runs = re.compile(f"{RUNS.pattern[:-1]}{{{max(1, least_length)},}}")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found = Counter(runs.findall((text.as_py() or "").encode().lower().decode()))
                if not misspelt:
                    counts.update(found)
                    continue
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in found.items():
                    h = zlib.crc32(word.encode(), start)
                    if h % misspelt == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] += n
                if len(counts) >= _HELD:
                    yield flush()
        if counts:
            yield flush()

    parts = docs.select(docs[id_col].cast("string"), docs[text_col].cast("string")).mapInArrow(run, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _probes(words: DataFrame) -> DataFrame:
    """word, n, its four probes: half (what must be equal, with its place and the indexed word's length), rest, longer (by one than what it looks for), ahead (the rest follows the half)."""
    w = F.col("word")

    def of(length: Column, longer: bool) -> list[Column]:
        first = F.floor(length / 2).cast("int")
        last = (length - first).cast("int")
        key = lambda place, half: F.concat(length.cast("string"), F.lit(place), half)
        rest = lambda half, rest, ahead: F.struct(half.alias("half"), rest.alias("rest"), F.lit(longer).alias("longer"), F.lit(ahead).alias("ahead"))
        size = F.length(w)
        return [rest(key("<", F.left(w, first)), F.right(w, size - first), True), rest(key(">", F.right(w, last)), F.left(w, size - last), False)]

    return words.select("word", "n", F.explode(F.array(*of(F.length(w), False), *of(F.length(w) - 1, True))).alias("p")).select("word", "n", "p.*")


def near_words(words: DataFrame, compared: int = COMPARED) -> DataFrame:
    """a, a_n, b, b_n with a < b: all pairs of words(word, n) that differ by exactly one inserted, deleted or replaced letter, once.

    Rows of words must be unique by word; null words are left out, an empty word meets
    words of one letter, and an empty table gives no rows. A half that more than `compared`
    words share is taken apart letter by letter, so that the work for it grows with its
    words, not with their square; no pair is lost by that.
    """
    words = words.where(F.col("word").isNotNull()).select("word", "n")
    probes = cut(_probes(words))
    place = F.row_number().over(Window.partitionBy("half").orderBy("word"))
    index = probes.where("not longer").withColumn("__i", place).where(F.col("__i") <= compared + 1)
    found = index.groupBy("half").agg(F.collect_list(F.struct(F.col("word").alias("b"), F.col("n").alias("b_n"))).alias("met"))
    found = found.withColumn("met", F.when(F.size("met") <= compared, F.col("met")))
    met = cut(with_looked_up(probes, found, "half"))
    own, pairs = F.struct("a", "a_n"), ("a", "a_n", "b", "b_n")
    # Words of equal length meet from both sides, and are compared from one.
    cold = met.where("met is not null").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "longer", F.explode("met").alias("m")).select("a", "a_n", "longer", "m.*")
    cold = cold.where(F.col("longer") | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1).select(*pairs)
    hot = met.where("met is null").select(F.col("word").alias("a"), F.col("n").alias("a_n"), "half", "rest", "longer")
    gaps = F.transform(F.sequence(F.lit(1), F.length("rest")), lambda i: F.concat(F.col("half"), F.lit("|"), F.when(F.col("longer"), "").otherwise(i.cast("string")), F.lit("|"), F.left("rest", i - 1), F.substr("rest", i + 1)))
    left_out = hot.where(F.length("rest") > 0).select("a", "a_n", "longer", F.explode(F.array_distinct(gaps)).alias("gap"))
    whole = hot.where("not longer").select("a", "a_n", F.concat("half", F.lit("||"), "rest").alias("gap"))
    # Equal length: words equal but for a letter at one place; longer: without a letter equal to a whole word.
    groups = left_out.where("not longer").groupBy("gap").agg(F.collect_list(own).alias("met")).where(F.size("met") > 1)
    same = groups.select(F.explode("met").alias("x"), "met").select("x.*", F.explode("met").alias("m")).select("a", "a_n", F.col("m.a").alias("b"), F.col("m.a_n").alias("b_n")).where("a < b")
    longer = left_out.where("longer").join(whole.select(F.col("a").alias("b"), F.col("a_n").alias("b_n"), "gap"), "gap").select(*pairs)
    both = cold.unionByName(same).unionByName(longer)
    turned = F.col("a") > F.col("b")
    ordered = both.select(*(F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("a_n", "b_n"), ("b", "a"), ("b_n", "a_n"))))
    return ordered.distinct()


def roots(forms: DataFrame, most: int) -> DataFrame:
    """word, root: forms(word, form) followed to the last one, in as many joins as the logarithm of a path of `most` words."""
    up = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(1, most)))):
        nearer = up.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        up = cut(up.join(nearer, F.col("root") == F.col("__w"), "left").select("word", F.coalesce("__r", "root").alias("root")))
    return up


def variants(words: DataFrame, factor: int = FACTOR, compared: int = COMPARED) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words(word, n), which are unique by word.

    form: the near word of largest n, of equal ones the first in code-point order, if its n
    is at least `factor` (2 or more) times the word's; null otherwise. root: the last form
    that follows from the word, itself if none. A chain's counts rise by the factor, so its
    length is bounded by the logarithm of the largest.
    """
    if factor < 2:
        raise ValueError("a form must be more frequent than its word")
    bounded(words.sparkSession)
    words = cut(words.where(F.col("word").isNotNull()).select("word", "n"))
    near = cut(near_words(words, compared))
    turned = near.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n"))
    best = near.unionByName(turned).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    out = words.join(best, F.col("word") == F.col("a"), "left")
    chosen = -F.col("best.less") >= F.lit(factor) * F.col("n")
    out = cut(out.select("word", F.when(chosen, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, -F.col("best.less")).alias("form_n")))
    top = words.agg(F.max("n")).first()[0] or 1
    steps = 1 + int(math.log(max(1, top), factor))
    up = roots(out.where("form is not null"), steps).withColumnRenamed("word", "__w")
    return out.join(up, F.col("word") == F.col("__w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """variants() of the documents' word_counts(), as the query has them."""
    bounded(docs.sparkSession)
    return variants(word_counts(docs, id_col, text_col))
