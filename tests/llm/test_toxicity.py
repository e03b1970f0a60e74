import random
import zlib

from corpus import documents, frame, words
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import toxicity as X


def corpus(n=400, seed=3):
    r = random.Random(seed)
    docs, labels = [], []
    odd = documents(6)[0][4:]
    for i in range(n):
        text, toxic = words(r, r.randint(20, 120)), i % 6 == 0
        if toxic:
            w = text.split(" ")
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["grumbag", "vexworm", "zornak" + r.choice(["ig", "ung", "or"])]))
            text = " ".join(w)
        docs.append((i, text, "en", "a", *odd))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def fitted(spark):
    docs, labels = corpus()
    labels += [(None, 1, 1), (7, 1, None)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_and_odd_rows(spark):
    docs, labels = fitted(spark)
    df = frame(spark, docs + documents(6)[6:])
    got = X.toxicity(df, labels).collect()
    assert len(got) == len(docs) + len(documents(6)[6:])
    truth = {d[0]: d[0] % 6 == 0 for d in docs}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        if r.doc_id in truth and r.doc_id < 1000 and r.held_out:
            assert r.predicted == truth[r.doc_id]
    model = X.fit(df, labels)
    assert {p for p, _ in model.lexicon} <= {" grumbag", " grumba", " vexworm", " vexwor", " grumbag ", " vexworm "} | {f" {'zornak'[:k]}" for k in range(3, 7)} and len(model.lexicon) <= 6
    # Labels of held-out rows are never read.
    other = labels.withColumn("toxic", X.F.when(X.held_out(), 1 - X.F.col("toxic")).otherwise(X.F.col("toxic")))
    assert X.fit(df, other) == model
    clean = X.clean_documents(df, model)
    assert clean.columns == df.columns and clean.count() == sum(not r.predicted for r in got)
    for t in ("you gr​umbag", "a GRUMB4G!", "vеxwоrm", "(vexw0rm)", "zornakxyz"):
        assert model.score(t) >= 0.3, t
    model.exceptions = ("vexworm farm",)
    model._automaton = None
    assert model.score("the vexworm farm") < 0.3 <= model.score("vexworm by a farm")


def test_least_hashes(spark):
    df = spark.range(5000).withColumn("label", X.F.lit(1)).repartition(7)
    want = [r.id for r in df.orderBy(X.F.xxhash64("id"), "id").limit(200).collect()]
    assert sorted(r.id for r in X._least(df, 200).collect()) == sorted(want)
    assert X._least(df, 4000).count() == 4000 and X._least(df, 9000).count() == 5000


def test_without_labels(spark):
    df, none = frame(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in X.toxicity(df, none).collect()} == {0}
    assert X.toxicity(df.limit(0), none).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80), st.lists(st.text("abc ", min_size=1, max_size=4).filter(str.strip), max_size=6, unique=True))
def test_weights_like_scanning(text, patterns):
    folded = X.fold(text + " abc ab")
    model = X.Model([(f" {p.strip()}", float(i + 1)) for i, p in enumerate(patterns)], ())
    best = {}
    for p, w in model.lexicon:
        for i in range(len(folded)):
            if folded.startswith(p, i):
                best[i] = max(best.get(i, 0), dict(sorted(model.lexicon, key=lambda x: 0)).get(p, w))
    assert model.weigh(folded) == sum(best.values())
