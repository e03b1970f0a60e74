import math
from collections import Counter, defaultdict

import pytest
from corpus import documents, frame

from postlake.llm import mixing as M


def tokens(docs):
    return {i: len((d[1] or "").encode().split()) for i, d in enumerate(docs)}


def weights(totals, alpha):
    z = sum((t / sum(totals.values())) ** alpha for t in totals.values() if t)
    return {s: (t / sum(totals.values())) ** alpha / z if t else 0.0 for s, t in totals.items()}


def planned(spark, totals, **options):
    df = spark.createDataFrame(list(totals.items()), "source string, tokens long")
    return {r.source: r for r in M.plan(df, **options).collect()}


TOTALS = {"a": 9000, "b": 700, "c": 300, None: 1000, "empty": 0}


def test_repetition_limit(spark):
    got = planned(spark, TOTALS, repetition=2.0)
    alpha = got["a"].alpha
    assert math.isclose((9000 / 300) ** (1 - alpha), 2.0, rel_tol=1e-6)
    want = weights(TOTALS, alpha)
    assert all(math.isclose(got[s].weight, want[s], abs_tol=1e-9) for s in TOTALS)
    assert math.isclose(got["a"].epochs, 1) and math.isclose(got["c"].epochs, 2, rel_tol=1e-6) and got["empty"].epochs == 1


def test_the_default_chooses_a_temperature(spark):
    # Sources that are less than four times apart: half way between proportional and even.
    got = planned(spark, {"a": 1500, "b": 1000, "c": 1200})
    assert math.isclose(got["a"].alpha, 0.5, abs_tol=1e-9) and math.isclose(got["b"].epochs, math.sqrt(1.5), rel_tol=1e-6)
    # Further apart: twice as often as the least read source.
    assert math.isclose(planned(spark, TOTALS)["c"].epochs, 2, rel_tol=1e-6)
    assert planned(spark, {"a": 7, "b": 7})["a"].alpha == 0


def test_entropy_and_budget(spark):
    got = planned(spark, TOTALS, entropy=1.0)
    w = [r.weight for r in got.values() if r.weight]
    assert math.isclose(-sum(x * math.log(x) for x in w), 1.0, rel_tol=1e-6)
    got = planned(spark, TOTALS, budget=5000, repetition=3.0)
    assert max(r.epochs for r in got.values()) <= 3.0 + 1e-6 and sum(r.weight for r in got.values()) == pytest.approx(1)
    assert planned(spark, {"a": 5, "b": 5}, repetition=2.0)["a"].alpha == 0
    assert planned(spark, {"a": 0}) and not planned(spark, {})


@pytest.mark.parametrize("blocks", [1024, 4])
def test_epochs_and_budgets(spark, monkeypatch, blocks):
    monkeypatch.setattr(M, "BLOCKS", blocks)
    docs = documents(150)
    docs = [(*d[:3], "c" if i % 17 == 0 else d[3], *d[4:]) for i, d in enumerate(docs)]
    size = tokens(docs)
    totals, of, by_id = Counter(), defaultdict(list), defaultdict(list)
    for i, d in enumerate(docs):
        totals[d[3]] += size[i]
        by_id[d[0], d[3]].append(size[i])
    plan = planned(spark, dict(totals))
    rows = M.mixture(frame(spark, docs)).collect()
    for r in rows:
        of[r.source, r.epoch].append(r)
    for s, p in plan.items():
        for e in range(p.full):
            assert Counter((r.doc_id, r.n_tokens) for r in of[s, e]) == Counter((d[0], size[i]) for i, d in enumerate(docs) if d[3] == s)
        last, rest = of.get((s, p.full), []), p.rest
        used = sum(r.n_tokens for r in last)
        assert used <= rest and (s, p.full + 1) not in of
        # The next document of the permutation would not have fitted.
        left = {k: sum(v) for k, v in by_id.items() if k[1] == s and k[0] not in {r.doc_id for r in last}}
        assert not any(left.values()) or used + max(left.values()) > rest
    assert Counter(r.doc_id for r in M.mixed_documents(frame(spark, docs)).collect()) == Counter(r.doc_id for r in rows)
    assert M.mixed_documents(frame(spark, docs)).columns == frame(spark).columns


def test_permutations_differ_and_empty(spark):
    rows = M.mixture(frame(spark, documents(150)).where("doc_id < 150")).collect()
    place = defaultdict(dict)
    for r in rows:
        place[r.epoch][r.doc_id] = r.block
    assert len(place) == 2 and place[1] and any(place[0][d] != b for d, b in place[1].items())
    assert M.mixture(frame(spark).limit(0)).count() == 0
