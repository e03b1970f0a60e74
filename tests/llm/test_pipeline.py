"""Every stage against a plain version of it, on what the stage before it really kept."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from corpus import SCHEMA, documents, frame
from test_quality import brute as judged
from test_simhash import classes, shingles, similar
from test_toxicity import corpus

from postlake.llm import stages, toxicity
from postlake.llm.common import table
from postlake.llm.encoding import default_tokenizer
from postlake.llm.packing import END_ID, MAX_LENGTH

LABELS = "doc_id long, quality int, toxic int"


def written(spark, folder, docs, labels):
    frame(spark, docs).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def clean(model, text):
    """The score by looking for every entry at every place."""
    folded, best, spared = toxicity.fold(text), {}, set()
    for phrase in model.exceptions:
        p = f" {' '.join(toxicity.fold(phrase).split())}"
        spared |= {j for i in range(len(folded)) if folded.startswith(p, i) for j in range(i, i + len(p))}
    for p, w in model.lexicon:
        at = folded.find(p)
        while at >= 0:
            best[at] = max(best.get(at, 0), w)
            at = folded.find(p, at + 1)
    weight = sum(w for i, w in best.items() if i not in spared)
    x, y = math.log1p(weight), math.log1p(100 * weight / max(1, folded.count(" ") - 1)) if weight else 0.0
    a, b, c = model.curve
    return 1 / (1 + math.exp(-max(-30, min(30, a + b * x + c * y)))) < toxicity.THRESHOLD


def first_of_each_group(docs):
    """By all pairs: of each class of similar texts the row of the least id, rows without an id last."""
    texts = sorted({d[1] or "" for d in docs})
    sets = [shingles(t) for t in texts]
    of = classes(list(range(len(texts))), lambda a, b: similar(sets[a], sets[b]))
    groups = defaultdict(list)
    for d in docs:
        groups[of[texts.index(d[1] or "")]].append(d)
    return [(min((x[0] is None, x[0]) for x in g)[1], g) for g in groups.values()]


def mixture(docs):
    """How often each row is read: shares, exponent, epochs and the last epoch's budget by the definitions."""
    tokens = [len((d[1] or "").encode().split()) for d in docs]
    total = Counter()
    for d, n in zip(docs, tokens):
        total[d[3]] += n
    some = [n for n in total.values() if n]
    alpha = max(0.0, 1 - math.log(2) / math.log(max(some) / min(some))) if max(some) > 2 * min(some) else 0.0
    weight = {s: (n / sum(some)) ** alpha / sum((m / sum(some)) ** alpha for m in some) if n else 0.0 for s, n in total.items()}
    size = max(n / weight[s] for s, n in total.items() if n)
    out = Counter()
    for s, n in total.items():
        epochs = round(weight[s] * size / n, 6) if n else 1.0
        full = math.floor(epochs)
        mine = [(d, k) for d, k in zip(docs, tokens) if d[3] == s]
        for d, _ in mine:
            out[d] += full
        rest = round((epochs - full) * n)
        if rest:
            h = {d[0]: int(hashlib.md5(f"{'' if d[0] is None else d[0]}:{full}".encode()).hexdigest()[:15], 16) for d, _ in mine}
            order = lambda i: (h[i] % 1024, (h[i] >> 10) % 1024, h[i])
            used = 0
            for i in sorted(h, key=order):
                used += sum(k for d, k in mine if d[0] == i)
                if used > rest:
                    break
                for d, _ in mine:
                    out[d] += d[0] == i
    return +out


def pieces(docs):
    from tokenizers import Tokenizer

    tokenizer, out = Tokenizer.from_file(default_tokenizer()), Counter()
    for d in docs:
        ids = [*tokenizer.encode(d[1] or "", add_special_tokens=False).ids, END_ID]
        start = 0
        while start < len(ids):
            k = min(MAX_LENGTH, 1 << ((len(ids) - start).bit_length() - 1))
            out[d[0], start, k, zlib.crc32(np.array(ids[start : start + k], "<u4").tobytes()), len(ids)] += 1
            start += k
    return out


def test_every_stage_like_a_plain_one(spark, tmp_path):
    docs, labels = corpus(200)
    docs += [(5000 + i, d[1], *d[2:]) for i, d in enumerate(docs[:20])] + [(None if d[0] is None else d[0] + 10_000, *d[1:]) for d in documents(60)]
    written(spark, tmp_path, docs, labels)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"] and corpus_pipeline.ORACLE_SQL is None
    at, kept = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert len(SCHEMA.split(",")) == len(kept.columns)
    for name, stage in corpus_pipeline.STAGES:
        columns, before = kept.columns, rows_of(kept)
        kept = stage(spark, kept, str(tmp_path))
        assert name == "packing" or kept.columns == columns
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        after = at[name] = rows_of(kept)
        if name == "toxicity":
            model = toxicity.fit(table(spark, tmp_path, "documents"), table(spark, tmp_path, "labels"))
            assert Counter(after) == Counter(d for d in before if clean(model, d[1]))
            assert not {d[0] for d in after} & {i for i, _, t in labels if t}
        elif name == "quality":
            good = judged([d[:4] for d in before])
            assert Counter(d[0] for d in after) == Counter(k[0] for k, n in good.items() if k[7] for _ in range(n))
        elif name == "near_duplicates":
            want = first_of_each_group(before)
            assert len(after) == len(want) and Counter(d[0] for d in after) == Counter(i for i, _ in want) and Counter(after) <= Counter(before)
            assert not {d[0] for d in after} & set(range(5000, 5020))
        elif name == "mixing":
            assert Counter(after) == mixture(before) and set(after) == set(before)
        else:
            names = kept.columns
            got = [dict(zip(names, r)) for r in after]
            assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == pieces(before)
            assert len({r["sequence_id"] for r in got}) == len(got) and {r["offset"] for r in got} == {0}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    columns = [c for c in whole.columns if c != "sequence_id"]
    assert Counter(rows_of(whole.select(columns))) == Counter(rows_of(kept.select(columns)))


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_empty_and_odd_tables(spark, tmp_path, rows):
    rest = documents(6)[0][4:]
    docs = [] if rows == "none" else [(i, t, lang, source, *rest) for i, t, lang, source in ((None, None, None, None), (1, "", None, "a"), (None, " ", "en", None), (1, "one", "en", "a"), (1, "one", "en", "a"), (2, "x" * 200_000, "en", "a"), (None, "w " * 50_000, None, None))]
    labels = [] if rows == "none" else [(None, None, None), (1, 1, None), (1, None, 1), (None, 1, 1)]
    frame(spark, docs).withColumnsRenamed({"id": "__id", "score": "__th", "node": "__quality_n_words", "length": "__mix_epoch", "least": "__own_0"}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in stages.STAGES:
        out = stage(spark, whole, str(tmp_path))
        got = out.collect()
        assert rows == "odd" or not got
        assert name == "packing" or out.columns == whole.columns
        if rows == "odd":
            count = {"toxicity": 7, "quality": 0, "near_duplicates": 4, "mixing": None, "packing": None}[name]
            assert len(got) == count if count is not None else len(got) >= 7
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
