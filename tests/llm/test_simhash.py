import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from corpus import documents, frame

from postlake.llm import simhash as S
from postlake.llm.components import components


def fingerprint(text, k):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, near):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if near(a, b):
                a1, b1 = find(a), find(b)
                root[max(a1, b1)] = min(a1, b1)
    return {x: find(x) for x in nodes}


def test_query_like_brute_force(spark):
    docs = [d for d in documents() if d[0] is None or d[0] != 2005]
    docs += [(3000 + i, f"tiny {i % 3}", "en", "a", *docs[0][4:]) for i in range(6)]
    fp = {d[0]: fingerprint(d[1], 3) for d in docs}
    want = classes(sorted(x for x in fp if x is not None), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    got = S.components_of_documents(frame(spark, docs)).collect()
    assert len(got) == len(docs)
    for r in got:
        assert int(r.fingerprint, 16) == fp[r.doc_id]
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id]
    assert S.near_duplicates(frame(spark).limit(0)).count() == 0


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
@pytest.mark.parametrize("paired", [64, 1])
def test_links_of_clusters(spark, distance, paired):
    r = random.Random(distance)
    fps = {0}
    for _ in range(6):
        x = r.getrandbits(64)
        for _ in range(12):
            fps.add(x)
            x ^= 1 << r.randrange(64)
            if r.random() < 0.3:
                x ^= 1 << r.randrange(64)
    signed = sorted(S._signed(x) for x in fps)
    want = classes(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= distance)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r.node: r.root for r in components(S.links(df, distance, paired)).collect()}
    assert {x: found.get(x, x) for x in signed} == want


def test_plan_meets_the_principle():
    r = np.random.default_rng(1)
    x = r.integers(0, 2, (500, 64))
    x[:, 1] = x[:, 0]
    together = x.T @ x
    for distance in (1, 2, 3):
        parts = S.plan(500, together, distance)
        assert sum(t + 1 for _, t in parts) == distance + 1
    assert any({0, 1} <= set(p) for p in S.group_bits(500, together, 4))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(50)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
    return " ".join(w)


def test_similar_groups(spark):
    r = random.Random(5)
    docs = [d for d in documents() if d[0] is not None]
    for k in range(25):
        text = " ".join(f"w{r.randrange(4000)}" for _ in range(r.choice([9, 30, 60, 70, 130, 260, 600])))
        for j in range(3):
            docs.append((4000 + 10 * k + j, edited(r, text, max(0, j * len(text.split()) // 110)), "en", "a", *docs[0][4:]))
    sets = {d[0]: shingles(d[1]) for d in docs}
    want = classes(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    got = {r.doc_id: r.component for r in S.similar_groups(frame(spark, docs)).collect()}
    wrong = [x for x in want if got[x] != want[x]]
    assert set(got) == set(want) and len(wrong) <= 1, wrong
    assert all(want[x] <= got[x] for x in got)  # never joins what brute force keeps apart
    kept = S.first_of_groups(frame(spark, docs))
    assert {r.doc_id for r in kept.collect()} == {x for x in got if got[x] == x} and kept.columns == frame(spark).columns


def test_exact_probes_lose_no_pair(spark):
    r = random.Random(15)
    docs = [d for d in documents() if d[0] is not None and d[0] != 2005]
    for k in range(40):
        text = " ".join(f"w{r.randrange(4000)}" for _ in range(r.choice([5, 7, 12, 25, 60, 64, 90, 150, 400])))
        # Edits that leave some of the copies at about the similarity itself.
        for j in range(4):
            docs.append((4000 + 10 * k + j, edited(r, text, max(0, j * len(text.split()) // 70)), "en", "a", *docs[0][4:]))
    sets = {d[0]: shingles(d[1]) for d in docs}
    want = classes(sorted(sets), lambda a, b: similar(sets[a], sets[b]))
    for paired in (64, 3):
        assert {x.doc_id: x.component for x in S.similar_groups(frame(spark, docs), paired=paired, probed=None).collect()} == want
    n = [1, 2, 5, 9, 10, 99, 1000]
    assert [len(S.part_keys(S.np.arange(k, dtype="u8"), 0.8, None)) for k in n] == [1, 1, 2, 2, 3, 20, 201]


def test_fingerprints_are_probed_before_parts(spark, monkeypatch):
    r = random.Random(21)
    texts = []
    for _ in range(20):
        text = " ".join(f"w{r.randrange(10**6)}" for _ in range(1500))
        texts += [text, text + " end", "begin " + text + " at last"]
    texts += [edited(r, texts[0], 40), "one word", "one word more", None]
    sets = [shingles(t) for t in texts]
    prints = [S.majority(S.np.unique(S.shingle_hashes(t, 5))) for t in texts]
    within = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= S.MAX_DISTANCE
    nodes = list(range(len(texts)))
    want = classes(nodes, lambda a, b: within(a, b) and similar(sets[a], sets[b]))
    assert len(set(want.values())) < len(texts) - 10
    docs = frame(spark, [(i, t, "en", "a", *documents(6)[0][4:]) for i, t in enumerate(texts)])
    groups = lambda probed: {x.doc_id: x.component for x in S.similar_groups(docs, probed=probed).collect()}
    planned = []
    plan = S.plan
    monkeypatch.setattr(S, "plan", lambda *a: planned.append(plan(*a)) or planned[-1])
    # No part is probed: what is joined is what fingerprints, by parts of bits and their thresholds, find.
    assert groups(0) == want and sum(t + 1 for _, t in planned[0]) == S.MAX_DISTANCE + 1
    # What they leave apart the parts join, and every link is verified, whatever is met.
    assert groups(S.PROBED) == classes(nodes, lambda a, b: similar(sets[a], sets[b]))
    every = lambda d, *_: d.select(d["fp"].alias("u")).crossJoin(d.select(d["fp"].alias("v"))).where("u < v")
    monkeypatch.setattr(S, "links", every)
    assert groups(0) == classes(nodes, lambda a, b: similar(sets[a], sets[b]))


def test_similar_large_probe(spark):
    r = random.Random(6)
    text = " ".join(f"w{r.randrange(4000)}" for _ in range(200))
    docs = [(i, edited(r, text, 0 if i == 17 else r.randint(1, 3)), "en", "a", *documents(6)[0][4:]) for i in range(120)] + [(None, text, "en", "a", *documents(6)[0][4:])]
    got = S.similar_groups(frame(spark, docs), paired=8).collect()
    assert {r.component for r in got} == {0} and len(got) == 121  # a row without an id takes part
    assert [r.doc_id for r in S.first_of_groups(frame(spark, docs), paired=8).collect()] == [0]
    assert S.first_of_groups(frame(spark).limit(0)).count() == 0


def test_one_row_of_each_group(spark):
    r = random.Random(9)
    rest = documents(6)[0][4:]
    row = lambda i, t: (i, t, "en", "a", *rest)
    a, b, c = (" ".join(f"w{r.randrange(10**6)}" for _ in range(80)) for _ in range(3))
    docs = [row(5, a), row(3, a), row(3, a), row(3, b), row(7, b), row(8, c), row(8, c), row(None, c), row(None, None), row(None, ""), row(9, " "), row(None, "one word"), row(None, "one word")]
    got = sorted(((x.doc_id, x.text) for x in S.first_of_groups(frame(spark, docs)).collect()), key=str)
    # Texts of one id are decided apart, equal rows leave one, and rows without an id come last.
    assert got == sorted([(3, a), (3, b), (8, c), (9, " "), (None, "one word")], key=str)
    clash = frame(spark, docs).withColumnsRenamed({"lang": "__id", "source": "__th", "score": "__own_0"})
    kept = S.first_of_groups(clash)
    assert kept.columns == clash.columns and kept.count() == 5


def groups_of(spark, texts, paired=S.PAIRED):
    docs = [(i, t, "en", "a", *documents(6)[0][4:]) for i, t in enumerate(texts)]
    return {r.doc_id: r.component for r in S.similar_groups(frame(spark, docs), paired=paired).collect()}


def test_similar_with_a_repeated_phrase(spark):
    r = random.Random(7)
    texts = []
    for _ in range(12):
        text = " ".join(f"w{r.randrange(10**6)}" for _ in range(1000))
        cycle = " ".join(f"c{r.randrange(10**6)}" for _ in range(9))
        texts += [text, text + (" " + cycle) * 120]
    got = groups_of(spark, texts)
    assert got == {i: i // 2 * 2 for i in range(24)}


@pytest.mark.parametrize("most", [4096, 40])
def test_similar_group_without_a_centre(spark, monkeypatch, most):
    monkeypatch.setattr(S, "MOST", most)
    monkeypatch.setattr(S, "FEWEST", 8)
    r = random.Random(8)
    text = " ".join(f"w{r.randrange(10**6)}" for _ in range(300))
    texts = [edited(r, text, 5) + " more words" * (i % 2) for i in range(160)]
    sets = [shingles(t) for t in texts]
    want = classes(list(range(len(texts))), lambda a, b: similar(sets[a], sets[b]))
    assert 1 < len(set(want.values())) < 150
    assert groups_of(spark, texts) == want


def test_pairs_without_a_common_original(spark):
    r = random.Random(10)
    common = [f"c{i}" for i in range(36)]
    texts = []
    for _ in range(300):  # every even text is at exactly 0.8 of every other even one, and near its odd one
        own = [f"u{r.randrange(10**9)}" for _ in range(5)]
        texts += [" ".join(common + own[:4]), " ".join(common + own[:3] + own[4:])]
    a, b, c = (shingles(texts[i]) for i in (0, 1, 2))
    assert len(a & b) * 37 == 35 * len(a | b) and len(a & c) * 10 == 8 * len(a | c)
    assert set(groups_of(spark, texts).values()) == {0}


def test_recall_of_probes():
    r = np.random.default_rng(3)
    for n in (6, 12, 33, 65, 129, 300, 1100):
        d = max(k for k in range(n) if (n - k) >= 0.8 * (n + k))
        for _ in range(150):
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            b = np.concatenate([a[d:], r.integers(0, 2**64, d, dtype=np.uint64)])
            assert len(np.intersect1d(S.part_keys(np.unique(a)), S.part_keys(np.unique(b))))
    keys = S.part_keys(np.unique(a))
    assert len(set(keys.tolist())) == len(keys) >= S.PROBED - 4 and len(S.part_keys(np.zeros(0, np.uint64))) == 0


def test_parities_never_hide_a_pair():
    r = np.random.default_rng(2)
    for n in (3, 50, 3000):
        a = np.unique(r.integers(0, 2**32, n, dtype=np.uint32))
        b = np.unique(np.concatenate([a[n // 10 :], r.integers(0, 2**32, n // 10, dtype=np.uint32)]))
        apart = np.bitwise_count(S.parities(a, 512) ^ S.parities(b, 512)).sum()
        assert apart <= len(np.setxor1d(a, b))
