"""Search by an inverted index: trigrams lead to the few rows that may have the words, and their texts decide.

A row's text, lower-cased and followed by two ends, is known by its runs of three
characters. A posting list holds the places of the rows that have one, in parts of a bounded
number of rows; words of three letters or more are in the rows that all their trigrams
name, shorter ones in those of all trigrams that begin with them. The lists lie sorted by
trigram and the texts in a folder for each part, so that a search reads the lists of its
trigrams and the texts of the parts that have candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions.text import text
from postlake.sources.storage import kept

#: What follows a text, so that its last characters begin a trigram too.
END = "\x00"
#: Rows of a part: the longest posting list, and the rows whose texts are read for one candidate.
PART_ROWS = 1 << 16
#: Candidates up to which they are sent to every reader of texts, which then opens their parts alone.
MAX_SENT = 200_000


def haystack() -> Column:
    """What a posting is searched in."""
    return F.lower(F.concat_ws(" ", text("title"), text("department"), text("university_full"), text("description")))


def _numbered(rows: DataFrame, part_rows: int) -> DataFrame:
    """rows with part and place, where place is below part_rows; tasks number their own rows, so that nothing is gathered."""
    n = F.monotonically_increasing_id()
    return rows.withColumn("__n", n).withColumns({"part": F.floor(F.col("__n") / part_rows).cast("long"), "place": (F.col("__n") % part_rows).cast("int")}).drop("__n")


def build(rows: DataFrame, folder: str, key: str = "id", of: Column | None = None, part_rows: int = PART_ROWS) -> None:
    """Writes the index of rows: folder/texts (key, hay, place by part) and folder/lists (gram, part, places).

    The numbering is kept before it is used twice. Rows with a null key are indexed like
    others; a null text is an empty one. A text's trigrams are made where it is read, each
    once, and lists are formed within a part, so that a trigram that all rows have is as
    many lists as there are parts, none longer than part_rows.
    """
    hay = F.coalesce(of if of is not None else haystack(), F.lit(""))
    texts = kept(_numbered(rows.select(F.col(key).alias("key"), hay.alias("hay")), part_rows))
    texts.repartition("part").sortWithinPartitions("part", "place").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/texts")
    ended = F.concat("hay", F.lit(END * 2))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("hay")), lambda i: F.substring(ended, i, F.lit(3))))
    grams = F.when(F.length("hay") > 0, grams).otherwise(F.array().cast("array<string>"))
    lists = texts.select("part", "place", F.explode(grams).alias("gram")).groupBy("gram", "part").agg(F.sort_array(F.collect_list("place")).alias("places"))
    lists.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part").write.mode("overwrite").parquet(f"{folder}/lists")


def _candidates(lists: DataFrame, words: str) -> DataFrame:
    """part, place of rows that may have the words, which have a letter at least."""
    if len(words) < 3:
        found = lists.where(F.col("gram").startswith(words)).select("part", F.explode("places").alias("place")).distinct()
    else:
        grams = sorted({words[i : i + 3] for i in range(len(words) - 2)})
        every = lists.where(F.col("gram").isin(grams)).groupBy("part").agg(F.collect_list("places").alias("lists")).where(F.size("lists") == len(grams))
        # The shortest list first: what is in all is in it.
        shortest = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))
        both = F.reduce(F.slice(shortest, 2, F.greatest(F.size("lists") - 1, F.lit(0))), F.get(shortest, 0), lambda left, more: F.array_intersect(left, more))
        found = every.select("part", F.explode(both).alias("place"))
    return found


def search(spark: SparkSession, folder: str, words: str) -> DataFrame:
    """key of every row whose text has the words, in any case; all rows for no words.

    Exact: a candidate's text decides. Candidates are counted; up to MAX_SENT they are sent
    to the readers of texts, which open the parts that have one, and beyond that both sides
    are joined by shuffling.
    """
    low = words.lower()
    texts = spark.read.parquet(f"{folder}/texts")
    if not low:
        return texts.select("key")
    lists = spark.read.parquet(f"{folder}/lists")
    found = kept(_candidates(lists, low))
    # The comparison, which always holds, is what lets the parts be pruned by what is sent.
    found = found.where("part >= 0").select("part", "place")
    joined = texts.join(F.broadcast(found) if found.count() <= MAX_SENT else found, ["part", "place"])
    return joined.where(F.contains("hay", F.lit(low))).select("key")
