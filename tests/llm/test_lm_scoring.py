import math
import random
from collections import Counter

import numpy as np
import pytest
from corpus import documents, frame

from postlake.llm import lm_scoring as L

SMALL = L.Layout(known=24, single=3, grouped=3, endings=4, word_symbols=3, ending_symbols=2)


def words_of(text):
    return (text or "").encode().lower().split()


def trained(spark, df, layout=SMALL):
    vocab = L.vocabulary(L.word_counts(df, "text"), layout)
    rows = L.encoded(df, vocab, "doc_id", "text").cache()
    return vocab, L.train(L.corpus_sums(rows, vocab))


def plain(texts, net):
    """Scores by the definition, a word at a time, with counts made here."""
    lay, v = net.vocab.layout, net.vocab
    count = Counter(w for t in texts for w in words_of(t))
    top = sorted(count, key=lambda w: (-count[w], L._hash(w)))[: lay.known]
    rank = {w: i for i, w in enumerate(top)}
    ends = Counter()
    for w, n in count.items():
        if w not in rank:
            ends[L.ending(w)] += n
    for w in top:
        ends.setdefault(L.ending(w), 0)
    order = sorted(ends, key=lambda e: (-ends[e], e))[: lay.endings]
    tail_class = lambda w: order.index(L.ending(w)) if L.ending(w) in order else lay.endings
    bounds = lay.bounds()
    word_class = lambda w: max(i for i, lo in enumerate(bounds[:-1]) if lo <= rank[w])

    def symbol(w):
        if w is None:
            return lay.symbols - 1
        if w in rank and rank[w] < lay.word_symbols:
            return rank[w]
        return lay.word_symbols + min(tail_class(w), lay.ending_symbols)

    def log_probability(w, left, right, own):
        a, b = symbol(left), symbol(right)
        if w in rank:
            c = word_class(w)
            members = [x for x in top if word_class(x) == c]
            weight = lambda x: count[x] * math.exp(float(net.word_left[a, rank[x]]) + float(net.word_right[b, rank[x]]))
            return float(net.log_class[a, b, c]) + math.log(weight(w) / sum(map(weight, members)))
        k = tail_class(w)
        members = [x for x in count if x not in rank and tail_class(x) == k]
        weight = lambda x: count[x] - own[x] + L.ADDED
        return float(net.log_class[a, b, lay.single + lay.grouped + k]) + math.log(weight(w) / sum(map(weight, members)))

    out = []
    for t in texts:
        w, own = words_of(t), Counter(words_of(t))
        out.append((len(w), sum(log_probability(x, w[i - 1] if i else None, w[i + 1] if i + 1 < len(w) else None, own) for i, x in enumerate(w))))
    return out, log_probability, count


def rows(n=40, seed=3):
    r = random.Random(seed)
    odd = documents(6)[0][4:]
    pool = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne") for b in ("ing", "ed", "s", "ly", "or")] + ["the", "of", "And"]
    texts = [" ".join(r.choice(pool) if r.random() < 0.7 else f"x{r.randrange(10**6)}{r.choice(['ing', 'ed', 'q'])}" for _ in range(r.randint(1, 60))) for _ in range(n)]
    texts += [texts[0], texts[0], "", None, "one", "  \n", "ß ß é"]
    return [(i, t, "en", "a", *odd) for i, t in enumerate(texts)]


def test_like_the_definition(spark):
    docs = rows()
    vocab, net = trained(spark, frame(spark, docs))
    want, log_probability, count = plain([d[1] for d in docs], net)
    got = {r.doc_id: r for r in L.pseudo_likelihood(frame(spark, docs), layout=SMALL).collect()}
    for d, (n, total) in zip(docs, want):
        r = got[d[0]]
        assert r.n_words == n and math.isclose(r.log_likelihood, total, rel_tol=1e-4, abs_tol=1e-4), d
        assert r.per_word is None if not n else math.isclose(r.per_word, total / n, rel_tol=1e-4)
    # At any masked place the probabilities of all words sum to one.
    own = Counter(words_of(docs[1][1]))
    for left, right in ((None, b"the"), (b"kaing", b"ne"), (b"never", None)):
        assert math.isclose(sum(math.exp(log_probability(w, left, right, own)) for w in count), 1, rel_tol=1e-4)


def test_split_and_repeats(spark):
    df = frame(spark, rows(60))
    one, two = ({r.doc_id: r.log_likelihood for r in L.pseudo_likelihood(df.repartition(n), layout=SMALL).collect()} for n in (1, 7))
    assert one.keys() == two.keys() and all(math.isclose(one[i], two[i], rel_tol=1e-9, abs_tol=1e-9) for i in one)


@pytest.mark.parametrize("layer", ["class", "word"])
def test_gradients_like_differences(layer):
    r = np.random.default_rng(0)
    lay = L.Layout(known=12, single=2, grouped=2, endings=2, word_symbols=2, ending_symbols=1)
    vocab = L.Vocabulary(lay, {}, {}, np.concatenate([np.searchsorted(lay.bounds(), np.arange(12), side="right") - 1, 4 + np.arange(3)]), r.integers(0, lay.symbols - 1, 15), np.ones(3), np.ones(3))
    sums = L.Sums(vocab)
    sums.add(r.integers(0, 15, 400), np.array([0, 100, 101]))
    joint, left, right = sums.parts()
    assert joint.sum() == 400 and left.sum() == right.sum() == joint[:, :, :4].sum()
    net = L.ClassLayer(joint) if layer == "class" else L.WordLayer(joint, left, right, lay.bounds())
    for a in net.arrays():
        a += r.normal(0, 0.3, a.shape)
    for a, g in zip(net.arrays(), net.gradients()):
        for i in np.argsort(-np.abs(g).ravel())[:4]:
            x = a.ravel()[i]
            a.ravel()[i] = x + 1e-5
            up = net.loss()
            a.ravel()[i] = x - 1e-5
            down = net.loss()
            a.ravel()[i] = x
            assert math.isclose((up - down) / 2e-5, g.ravel()[i], rel_tol=1e-3, abs_tol=1e-8)


def test_training_helps_and_odd_rows(spark):
    r = random.Random(1)
    odd = documents(6)[0][4:]
    docs = [(i, " ".join(f"{a} {a}ly then {a}ed" for a in (r.choice(["north", "south", "east", "west"]) for _ in range(150))), "en", "a", *odd) for i in range(150)]
    shuffled = docs[0][1].split()
    r.shuffle(shuffled)
    docs.append((900, " ".join(shuffled), "en", "a", *odd))
    docs += [(901 + k, " ".join(f"unique{k // 2}word{i}" for i in range(100)), "en", "a", *odd) for k in (0, 1, 2)]
    got = {x.doc_id: x for x in L.pseudo_likelihood(frame(spark, docs)).collect()}
    assert got[0].per_word > got[900].per_word + 0.5 and got[0].n_words == got[900].n_words == 600
    # What another document has too is told from what is found once.
    assert got[901].per_word > got[903].per_word + 0.5 and math.isclose(got[901].per_word, got[902].per_word)
    out = L.pseudo_likelihood(frame(spark)).collect()
    assert len(out) == len(documents())
    assert all((x.per_word is None) == (x.n_words == 0) and x.log_likelihood <= 0 for x in out)
    assert L.pseudo_likelihood(frame(spark).limit(0)).count() == 0
    count = {x.h: x.n for x in L.word_counts(frame(spark), "text").collect()}
    assert count == {L._hash(w): n for w, n in Counter(w for d in documents() for w in words_of(d[1])).items()}
