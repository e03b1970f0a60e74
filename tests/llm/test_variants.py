import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from postlake.llm import variants as V

from corpus import documents, frame


def near(a, b):
    """One inserted, deleted or replaced letter apart, letter by letter."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain(counts, factor=10):
    links = defaultdict(set)
    by_gap = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            by_gap[w[:i] + w[i + 1 :]].add(w)
    for w in counts:
        for i in range(len(w)):
            for x in by_gap[w[:i] + w[i + 1 :]] | by_gap.get(w, set()):
                if near(w, x):
                    links[w].add(x)
                    links[x].add(w)
        gap = {w[:i] + w[i + 1 :] for i in range(len(w))} & counts.keys()
        for x in gap:
            links[w].add(x)
            links[x].add(w)
    forms = {}
    for w, n in counts.items():
        if links[w]:
            best = min(links[w], key=lambda x: (-counts[x], x))
            if counts[best] >= factor * n:
                forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        out.add((w, forms.get(w), root, n, len(links[w]), counts.get(forms.get(w))))
    return out


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_documents(spark):
    r = random.Random(4)
    rows = documents() + [(5000 + i, " ".join(r.choice(["naïvely", "Naïvely", "naively", "recieving", "receiving", "RECEIVING", "relevantÉ", "straße×÷ab"]) for _ in range(60)), "en", "a", None, *documents()[0][5:]) for i in range(12)]
    docs = frame(spark, rows)
    got = V.document_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(words_of([(x[0], x[1]) for x in rows]))
    assert set(map(tuple, got.collect())) == want and len(want) > 8
    assert V.document_variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("compared", [1, 3, 1000])
def test_hot_halves_lose_nothing(spark, compared):
    r = random.Random(5)
    words = {w: r.choice([1, 2, 30, 400, 9000]) for w in ["".join(r.choice("abé") for _ in range(r.randint(0, 6))) for _ in range(400)] + ["prefix" + "".join(r.choice("xyz") for _ in range(r.randint(5, 7))) for _ in range(300)]}
    df = spark.createDataFrame([*words.items(), (None, 5)], "word string, n long").repartition(3)
    pairs = [tuple(x) for x in V.near_words(df, compared).collect()]
    want = {(a, words[a], b, words[b]) for a in words for b in words if a < b and near(a, b)}
    assert set(pairs) == want and len(pairs) == len(want)
    assert set(map(tuple, V.variants(df, compared=compared).collect())) == plain(words)


def test_chains_and_ties(spark):
    words = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 20000, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "lonely": 7}
    got = {r.word: (r.form, r.root, r.n_near) for r in V.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 1) and got["aaaaabb"] == ("aaaabbb", "aaaabbb", 2)
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 2) and got["lonely"] == (None, "lonely", 0)
    with pytest.raises(ValueError, match="frequent"):
        V.variants(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


def test_nothing_is_misspelt_without_a_rate(spark):
    docs = spark.createDataFrame([(1, "Wording wording WORDING short"), (None, None)], "doc_id long, text string")
    assert [tuple(r) for r in V.word_counts(docs, misspelt=0).collect()] == [("wording", 3)]
    assert {tuple(r) for r in V.word_counts(docs, misspelt=1, least_length=6, least_count=1).collect()} == {(w[: h % 7] + w[h % 7 + 1 :], 3) for w in ["wording"] for h in [zlib.crc32(b"1:wording")]}
