"""Exact top-k by inner product: a ball tree for each shard, branch and bound.

Vectors become shards where they are read, without a shuffle: each run of rows of bounded
size is built into a ball tree once, whose nodes bound the inner product with a query by
their centre and radius, and the trees are kept in the shared folder. Queries go to the
shards in blocks of bounded size. For each query the nodes are opened in the order of
their bounds, until the best that is left falls short of the query's current k-th score.
That score is shared: a task carries it from one of its shards to the next, and shards
are searched in three rounds, a few first, each round starting from the scores of the
ones before. What is shuffled are results alone, at most k of a query and task.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut

#: Results of each query, queries' ids divide by this, and units of a component (fixed values).
TOP, EVERY, UNIT = 10, 100, 1024
#: Vectors of a shard at most and numbers in it, queries of a block, and vectors of a leaf.
SHARD, NUMBERS, BLOCK, LEAF = 16_384, 1 << 20, 8192, 64
#: Shares of the shards that are searched by the end of each round.
ROUNDS = (64, 8, 1)
#: Sums up to which doubles hold integers exactly.
_EXACT = 2.0**52


def usable(vec: str, unit: int = UNIT) -> Column:
    """True for vectors without null or non-finite components; one whose product with unit is no finite double is none either."""
    return F.coalesce(F.col(vec).isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(unit))) < F.lit(float("inf")))), F.lit(False))


def vectors_of(rows: DataFrame, id_col: str, vec_col: str, unit: int = UNIT) -> DataFrame:
    """id, v: the rows that take part, components as doubles."""
    out = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    return out.where(F.col("id").isNotNull() & usable("v", unit))


class BallTree:
    """A binary tree of balls over rows of whole numbers; nodes hold ranges of a permutation of the rows."""

    FIELDS = ("lo", "hi", "left", "centre", "radius", "points", "ids")

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        self.order, self.points = np.arange(len(points)), points
        self.lo, self.hi, self.left, self.centre, self.radius = [], [], [], [], []
        self._grow(leaf)
        self.centre, self.radius = np.array(self.centre).reshape(len(self.lo), -1), np.array(self.radius)
        self.lo, self.hi, self.left = (np.array(x, np.int64) for x in (self.lo, self.hi, self.left))
        self.points, self.ids = points[self.order], np.asarray(ids, np.int64)[self.order]

    def _add(self, lo: int, hi: int) -> int:
        rows = self.points[self.order[lo:hi]]
        c = rows.mean(0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.left.append(-1)
        self.centre.append(c)
        self.radius.append(float(np.sqrt(((rows - c) ** 2).sum(1).max())))
        return len(self.lo) - 1

    def _grow(self, leaf: int) -> None:
        todo = [self._add(0, len(self.points))]
        while todo:
            k = todo.pop()
            lo, hi = self.lo[k], self.hi[k]
            if hi - lo <= leaf or self.radius[k] == 0:
                continue
            rows = self.points[self.order[lo:hi]]
            a = rows[((rows - self.centre[k]) ** 2).sum(1).argmax()]
            b = rows[((rows - a) ** 2).sum(1).argmax()]
            cut_at = (hi - lo) // 2
            part = np.argpartition(rows @ (b - a), cut_at)
            self.order[lo:hi] = self.order[lo:hi][part]
            self.left[k] = self._add(lo, lo + cut_at)
            self._add(lo + cut_at, hi)
            todo += [self.left[k], self.left[k] + 1]

    def packed(self) -> list[bytes]:
        return [np.ascontiguousarray(getattr(self, f)).tobytes() for f in self.FIELDS]

    @classmethod
    def unpacked(cls, size: int, parts: list[bytes]) -> BallTree:
        """The tree of packed(), over vectors of this many components."""
        tree = cls.__new__(cls)
        for f, raw in zip(cls.FIELDS, parts):
            setattr(tree, f, np.frombuffer(raw, np.int64 if f in ("lo", "hi", "left", "ids") else np.float64))
        tree.centre, tree.points = tree.centre.reshape(len(tree.lo), size), tree.points.reshape(len(tree.ids), size)
        return tree

    def exact_with(self, most: float) -> bool:
        """Whether inner products with a query of components up to this size are exact in doubles."""
        return np.abs(self.points).max(initial=0) * most * max(1, self.points.shape[1]) < _EXACT

    def search(self, q: np.ndarray, own: int, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, id) of `best` and the rows but those of id `own`, in order; ties to smaller ids.

        The k-th of `best`, if there are as many, is the score to reach.
        """
        if not self.exact_with(np.abs(q).max(initial=0)):
            whole = [int(x) for x in q]
            rows = ((-sum(int(a) * b for a, b in zip(p, whole)), int(i)) for p, i in zip(self.points, self.ids) if i != own)
            return heapq.nsmallest(k, [*best, *rows])
        size = float(np.sqrt(q @ q))
        slack = 1e-9 * size + 1e-6
        bound = self.centre @ q + self.radius * size * (1 + 1e-12) + slack * (1 + np.abs(self.centre).sum(1) * 1e-9)
        kth = -best[k - 1][0] if len(best) >= k else -np.inf
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < kth:
                break
            child = int(self.left[node])
            if child >= 0:
                for c in (child, child + 1):
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.lo[node], self.hi[node]
            scores, ids = self.points[lo:hi] @ q, self.ids[lo:hi]
            # Rows of the query's own id go before the leaf is cut to k.
            at = np.flatnonzero((scores >= kth) & (ids != own))
            if len(at):
                at = at[np.lexsort((ids[at], -scores[at]))[:k]]
                best = sorted(best + list(zip((-scores[at]).astype(np.int64).tolist(), ids[at].tolist())))[:k]
                if len(best) == k:
                    kth = -best[-1][0]
        return best


_COLUMNS = ("lo", "hi", "at", "centre", "radius", "points", "ids")


def forest(vectors: DataFrame, unit: int = UNIT) -> DataFrame:
    """A row for each shard: its ball tree over floor(unit * component). vectors: id, v. Nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}

        def tree(size: int) -> pa.RecordBatch:
            points, ids = (np.concatenate(x) for x in zip(*held.pop(size)))
            del count[size]
            built = BallTree(points, ids)
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), *(pa.array([x], pa.binary()) for x in built.packed())], ["size", *_COLUMNS])

        for b in batches:
            if not b.num_rows:
                continue
            ids, v = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1)
            sizes = v.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(v.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * unit)
            ends = np.cumsum(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                points = flat[(ends[at, None] - size + np.arange(size)).ravel()].reshape(len(at), size) if size else np.zeros((len(at), 0))
                most = max(1, min(SHARD, NUMBERS // max(1, size)))
                for k in range(0, len(at), most):
                    held.setdefault(size, []).append((points[k : k + most], ids[at[k : k + most]]))
                    count[size] = count.get(size, 0) + len(points[k : k + most])
                    if count[size] >= most:
                        yield tree(size)
        for size in sorted(held):
            yield tree(size)

    return vectors.mapInArrow(run, ", ".join(["size bigint", *(f"{c} binary" for c in _COLUMNS)])).select(F.monotonically_increasing_id().alias("shard"), "*")


def _searched(trees: DataFrame, queries: dict[int, tuple[np.ndarray, np.ndarray]], known: dict[int, list[tuple[int, int]]], k: int) -> DataFrame:
    """query_id, vec_id, score: what the trees add to the results that are known.

    queries: ids and vectors by number of components; known: (-score, id) by query.
    """
    context = trees.sparkSession.sparkContext
    both = context.broadcast((queries, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, before = both.value
        best = {i: list(x) for i, x in before.items()}
        for b in batches:
            for row in b.to_pylist():
                size = row["size"]
                if size in asked:
                    tree = BallTree.unpacked(size, [row[c] for c in _COLUMNS])
                    for i, q in zip(*asked[size]):
                        best[int(i)] = tree.search(q, int(i), k, best.get(int(i), []))
        out = [(i, v, -s) for i, x in best.items() for s, v in x if (s, v) not in before.get(i, ())]
        # A row that is known already may be there again under the same id and score.
        for i, x in best.items():
            for pair in set(before.get(i, ())):
                out += [(i, pair[1], -pair[0])] * max(0, x.count(pair) - before[i].count(pair))
        for i, v, score in out:
            if not -(2**63) <= score < 2**63:
                raise ValueError(f"the score of {i} and {v} does not fit a long: {score}")
        cols = list(zip(*out)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])

    return trees.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = EVERY, unit: int = UNIT) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each query with all other vectors.

    Queries are the rows whose id divides by `every`. Rows without an id, or with a null
    or non-finite component, take no part, nor do those with one whose product with unit
    is no finite double; vectors compare with those of their length. A
    query's own are the rows of its id, and a repeated query counts once (its least
    vector). Other repeated rows are results each for itself. Fewer than k candidates give
    fewer rows, an empty table none. Other columns are not read. Scores
    are exact whole numbers, however large; a result whose score does not fit a long is an error.

    Vectors are read once into trees and the trees once for each block of BLOCK queries
    and round; the results of a block, k for each of its queries, are all that the driver
    holds of it.
    """
    bounded(vectors.sparkSession)
    rows = vectors_of(vectors, id_col, vec_col, unit)
    asked = cut(rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")))
    trees = cut(forest(rows, unit))
    shards, blocks = trees.count(), max(1, -(-asked.count() // BLOCK))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_of = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    place = F.pmod(F.xxhash64("shard"), F.lit(ROUNDS[0]))
    # Of few shards, one stands for a round of a small share.
    first = trees.agg(F.min(F.struct(place, "shard"))).first()[0]
    place = F.when(F.col("shard") == F.lit(first[1] if first else -1), F.lit(0)).otherwise(F.greatest(place, F.lit(1 if shards < ROUNDS[0] else 0)))
    parts = []
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).collect()  # about BLOCK rows
        queries = {}
        for size in {len(r["v"]) for r in mine}:
            some = sorted((r["id"], r["v"]) for r in mine if len(r["v"]) == size)
            queries[size] = np.array([i for i, _ in some], np.int64), np.floor(np.array([v for _, v in some], np.float64).reshape(len(some), size) * unit)
        known: dict[int, list[tuple[int, int]]] = {}
        lower = 0
        for n, share in enumerate(ROUNDS):
            upper = ROUNDS[0] // share
            found = _searched(trees.where((place >= lower) & (place < upper)), queries, known, k)
            if n < len(ROUNDS) - 1:
                for r in best_of(found).collect():  # k rows for each query of the block
                    known.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
                known = {i: sorted(x)[:k] for i, x in known.items()}
            lower = upper
        held = vectors.sparkSession.createDataFrame([(i, v, -s) for i, x in known.items() for s, v in x], "query_id bigint, vec_id bigint, score bigint")
        parts.append(cut(best_of(found.unionByName(held)).select("query_id", "rank", "vec_id", "score")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def oracle() -> str:
    """The query's SQL: every query against all rows."""
    return f"""
    WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    u AS (SELECT id, len(v) AS size, list_transform(v, lambda x: floor({UNIT} * x)) AS w FROM v),
    q AS (SELECT id, len(v) AS size, list_transform(v, lambda x: floor({UNIT} * x)) AS w FROM (SELECT id, min(v) AS v FROM v WHERE id % {EVERY} = 0 GROUP BY id)),
    s AS (SELECT q.id AS query_id, u.id AS vec_id, CAST(CASE WHEN q.size = 0 THEN 0 ELSE list_inner_product(q.w, u.w) END AS BIGINT) AS score FROM q JOIN u ON q.size = u.size AND q.id <> u.id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}"""
