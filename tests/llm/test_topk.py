import math
import random
from collections import Counter

import numpy as np
import pytest

from postlake.llm import topk as K


def brute(rows, k=10, every=100):
    good = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in good:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out += [(q, n + 1, i, -x) for n, (x, i) in enumerate(s)]
    return Counter(out)


def vectors(n, d, seed):
    r = random.Random(seed)
    return [(i, [r.gauss(0, 0.2) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize("shard", [16_384, 97])
def test_like_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(K, "SHARD", shard)
    monkeypatch.setattr(K, "BLOCK", 2)
    rows = vectors(600, 8, 1) + [(700 + i, [0.5] * 8) for i in range(60)] + [(900, None), (1000, [None] + [0.1] * 7), (1100, [math.inf] * 8), (1200, [math.nan] * 8), (1300, [0.1] * 3), (1301, [0.2] * 3), (None, [9.0] * 8), (1400, []), (100, [0.0] * 8), (1500, [3e7] * 8), (1501, [-2.5e7] * 8)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, score int").repartition(3)
    # Rows beyond exact doubles take the way of whole numbers.
    assert Counter(tuple(r) for r in K.top_k(df).collect()) == brute(rows)


def test_floats_and_few(spark):
    df = spark.createDataFrame([(i, v) for i, v in vectors(7, 4, 2)], "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert Counter(tuple(r) for r in K.top_k(df).collect()) == brute(rows)
    assert K.top_k(df.limit(0)).count() == 0


def test_own_rows_beside_close_neighbours():
    own, near = [(100, [10.0, 10.0])] * 20, [(i, [9.0, 9.0 - i % 3]) for i in range(1, 31)]
    far = [(200 + i, [-5.0, float(-i)]) for i in range(200)]
    rows = [*own, *near, *far]
    tree = K.BallTree(np.array([v for _, v in rows]), np.array([i for i, _ in rows]))
    tree = K.BallTree.unpacked(2, tree.packed())
    want = sorted(((sum(10 * x for x in v), i) for i, v in rows if i != 100), key=lambda x: (-x[0], x[1]))[:10]
    assert tree.search(np.array([10.0, 10.0]), 100, 10, []) == [(-int(s), i) for s, i in want]


@pytest.mark.parametrize("shard", [16_384, 16])
def test_sixty_copies_of_the_query(spark, monkeypatch, shard):
    monkeypatch.setattr(K, "SHARD", shard)
    rows = [(0, [0.5, 0.25])] * 60 + [(i, [0.5, 0.25]) for i in range(1, 61)] + [(7, [0.5, 0.25])] * 5 + [(100 * i, [0.1 * i, -0.2]) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert Counter(tuple(r) for r in K.top_k(df).collect()) == brute(rows)


def test_every_shard_shares_the_score(spark, monkeypatch):
    monkeypatch.setattr(K, "SHARD", 10)
    monkeypatch.setattr(K, "BLOCK", 3)
    rows = vectors(1500, 6, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert K.forest(K.vectors_of(df, "vec_id", "embedding")).count() >= 150
    assert Counter(tuple(r) for r in K.top_k(df).collect()) == brute(rows)


def test_very_large_components(spark):
    big = [(0, [3e14, 1.0]), (1, [2e11, 1.0]), (2, [-1.0, 2e11]), (3, [1e306, 0.0]), (4, [1e300, 0.0])]
    rows = lambda *ids: spark.createDataFrame([x for x in big if x[0] in ids], "vec_id long, embedding array<double>")
    # Whole numbers beyond doubles' exactness, with a query whose scores fit a long: exact.
    q = spark.createDataFrame([(0, [3.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in K.top_k(q.unionByName(rows(1, 2, 3))).orderBy("rank").collect()]
    scaled = lambda v: [int(x * 1024) for x in v]
    want = {i: sum(a * b for a, b in zip(scaled([3.0, 1.0]), scaled(v))) for i, v in big if i in (1, 2)}
    # 1e306 times 1024 is no finite double, so that vector takes no part.
    assert got == [(1, want[1]), (2, want[2])]
    with pytest.raises(Exception, match="does not fit a long"):
        K.top_k(rows(0, 1)).collect()
    with pytest.raises(Exception, match="does not fit a long"):
        K.top_k(q.unionByName(rows(4))).collect()
