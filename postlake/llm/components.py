"""Connected components of a graph of long ids, by alternating large and small stars.

Every round is a few joins and aggregations on edges; nodes with very many edges are
summed in parts and their edges are joined where they are, and no list of a component is
ever gathered. Rounds grow with the
logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, narrowed, with_looked_up


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of edges(u, v): the smallest id that can be reached.

    Loops, repeated and turned edges change nothing; edges with a null end are left out;
    no edges give no rows.
    """
    star = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = cut(edges.where("u <> v").select(*star).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen or not state["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        seen = state
        now = narrowed(now, state["n"])
        # Large star: each node's larger neighbours go to the least of it and its neighbours.
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = with_looked_up(now.select(F.col("v").alias("u"), F.col("u").alias("w")), least, "u", state["n"]).select(F.col("w").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: each node and its smaller neighbours go to the least of these.
        large = cut(narrowed(large, state["n"]))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_looked_up(large, least, "u", state["n"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(narrowed(small.union(least.select("u", "m")).distinct(), state["n"]))
