"""Masked pseudo-likelihood scores of documents.

A network predicts each word, masked, from the words on both of its sides; the sum of the
conditional log-probabilities over a text's words scores it. The softmax is hierarchical:
a class given both neighbours, then the word within its class. Frequent words are in
classes of their own or of like frequency, within which a second layer of the network
tells them apart, again by both neighbours. Other words are in classes of their ending,
within which they go by their counts in the other documents: the masked document's own
occurrences are taken out, so that a word that no other document has counts as new.

Counts are of all words of all documents, in a table that grows with the vocabulary and is
joined to the documents' words; no word shares the count of another. The network sees all
documents too: which neighbours' symbols meet which class, and which symbol on each side
meets which frequent word, are sums over the corpus, and from these sums, which are all
that the likelihood and its gradient depend on, it is trained in numpy. So neither counts
nor weights depend on how the input is split.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_words, bounded, cut, tidy


@dataclass(frozen=True)
class Layout:
    """Sizes of the model, all fixed: words that the network knows, and what they are grouped into."""

    known: int = 16_384  # most frequent words, each an output of the network
    single: int = 32  # most frequent ones, each a class
    grouped: int = 32  # classes of the other known words, by frequency
    endings: int = 63  # classes of other words by their most frequent endings; one more has the rest
    word_symbols: int = 40  # most frequent words that neighbours are told apart by
    ending_symbols: int = 22  # most frequent endings that other neighbours are told apart by

    @property
    def classes(self) -> int:
        return self.single + self.grouped + self.endings + 1

    @property
    def symbols(self) -> int:
        """Words, endings, other words, and what is beyond the text's ends."""
        return self.word_symbols + self.ending_symbols + 2

    @property
    def cells(self) -> int:
        """Of the sums: (left, right, class), (left, known word), (right, known word)."""
        return self.symbols**2 * self.classes + 2 * self.symbols * self.known

    def bounds(self) -> list[int]:
        """First ranks of the classes of known words, and the end: single ones, then classes that grow."""
        grow = [round(self.single * (self.known / self.single) ** (i / self.grouped)) for i in range(self.grouped + 1)]
        return [*range(self.single), *grow]


LAYOUT = Layout()
#: What a word that no other document has counts as.
ADDED = 0.5
#: Units and steps of the class layer and of the word layer, and their rate.
HIDDEN, STEPS, WORD_HIDDEN, WORD_STEPS, RATE = 32, 150, 16, 60, 0.03
#: Words that a task counts before it sends them, word forms that a worker keeps, and tokens summed together.
COUNTED, KEPT, SUMMED = 200_000, 1 << 18, 1 << 18
#: Pieces that the sums are sent in, and tasks that pick the known words.
PIECES, PICKERS = 64, 8


def _hash(word: bytes) -> int:
    x = xxhash.xxh64_intdigest(word, 0)
    return x - (1 << 64) if x >> 63 else x


def ending(word: bytes) -> int:
    """The word's last two bytes, as a number."""
    return int.from_bytes(word[-2:], "big")


# --- Counts of all words ----------------------------------------------------------------


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """h, e, n: every word of the corpus by its hash, with its ending and number."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(count)
            out = pa.RecordBatch.from_arrays([pa.array([_hash(w) for w in words], pa.int64()), pa.array([ending(w) for w in words], pa.int32()), pa.array(list(count.values()), pa.int64())], ["h", "e", "n"])
            count.clear()
            return out

        for b in batches:
            for t in b.column(0):
                count.update(ascii_words(t.as_py()))
                if len(count) > COUNTED:
                    yield flush()
        if count:
            yield flush()

    parts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "h bigint, e int, n bigint")
    return parts.groupBy("h", "e").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Known words by rank, and classes and symbols of all."""

    layout: Layout
    rank: dict[int, int]  # hash: rank
    ending_class: dict[int, int]  # ending: place among the most frequent
    class_of: np.ndarray  # of known words, then of the ending classes
    symbol_of: np.ndarray
    tokens: np.ndarray  # of each ending class, without known words
    types: np.ndarray

    def id_of(self, word: bytes) -> int:
        """A known word's rank, or what comes after them for the word's ending."""
        r = self.rank.get(_hash(word)) if len(self.rank) else None
        return r if r is not None else self.layout.known + self.ending_class.get(ending(word), self.layout.endings)


def vocabulary(counts: DataFrame, layout: Layout = LAYOUT) -> Vocabulary:
    """From the corpus' counts: what reaches the driver are the known words and a row for each ending.

    Each task picks its most frequent words and sums its endings, in one pass over the counts.
    """
    known = layout.known

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, sums = np.zeros((0, 3), np.int64), {}
        for b in batches:
            rows = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            codes, at = np.unique(rows[:, 1], return_inverse=True)
            n, k = np.bincount(at, weights=rows[:, 2]), np.bincount(at)
            for e, x, y in zip(codes.tolist(), n.tolist(), k.tolist()):
                old = sums.get(e, (0, 0))
                sums[e] = old[0] + int(x), old[1] + y
            best = np.concatenate([best, rows])
            if len(best) > 4 * known:
                best = best[np.lexsort((best[:, 0], -best[:, 2]))[:known]]
        best = best[np.lexsort((best[:, 0], -best[:, 2]))[:known]]
        cols = [*(best[:, i] for i in range(3)), np.zeros(len(best), np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h", "e", "n", "types"])
        rows = [(e, n, k) for e, (n, k) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], ["h", "e", "n", "types"])

    parts = cut(counts.mapInArrow(run, "h bigint, e bigint, n bigint, types bigint"))
    # Few tasks pick again among all tasks' picks, so that the driver compares a fixed number.
    some = parts.where("h is not null").select("h", "e", "n").repartition(PICKERS)
    top = some.orderBy(F.desc("n"), "h").limit(known).collect()
    tails = {r["e"]: [r["n"], r["types"]] for r in parts.where("h is null").groupBy("e").agg(F.sum("n").alias("n"), F.sum("types").alias("types")).collect()}  # 65,792 rows at most
    for r in top:
        tails[r["e"]][0] -= r["n"]
        tails[r["e"]][1] -= 1
    order = sorted(tails, key=lambda e: (-tails[e][0], e))[: layout.endings]
    place = {e: i for i, e in enumerate(order)}
    tokens, types = np.zeros(layout.endings + 1), np.zeros(layout.endings + 1)
    for e, (n, k) in tails.items():
        tokens[place.get(e, layout.endings)] += n
        types[place.get(e, layout.endings)] += k
    class_of = np.concatenate([np.searchsorted(layout.bounds(), np.arange(known), side="right") - 1, layout.single + layout.grouped + np.arange(layout.endings + 1)])
    by_ending = lambda i: layout.word_symbols + min(i, layout.ending_symbols)
    symbol = [i if i < layout.word_symbols else by_ending(place.get(r["e"], layout.endings)) for i, r in enumerate(top)]
    symbol += [0] * (known - len(top)) + [by_ending(i) for i in range(layout.endings + 1)]
    return Vocabulary(layout, {r["h"]: i for i, r in enumerate(top)}, place, class_of, np.array(symbol), tokens, types)


class _Ids(dict):
    """Ids of words, a bounded number of them kept."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: bytes) -> int:
        i = self.vocab.id_of(word)
        if len(word) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[word] = i
        return i


# --- The corpus in ids, and its sums ------------------------------------------------------


def _neighbours(ids: np.ndarray, starts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Symbols to the left and right of each word of texts that follow one another; starts: first words of the texts."""
    symbol, beyond = vocab.symbol_of[ids], vocab.layout.symbols - 1
    left, right = np.empty_like(symbol), np.empty_like(symbol)
    left[1:], right[:-1] = symbol[:-1], symbol[1:]
    left[starts], right[np.append(starts[1:], len(ids)) - 1] = beyond, beyond
    return left, right


class Sums:
    """What the network is trained on: neighbours' symbols with classes and with known words."""

    def __init__(self, vocab: Vocabulary):
        self.vocab, self.flat = vocab, np.zeros(vocab.layout.cells, np.int64)

    def add(self, ids: np.ndarray, starts: np.ndarray) -> None:
        lay, v = self.vocab.layout, self.vocab
        left, right = _neighbours(ids, starts, v)
        at = lay.symbols**2 * lay.classes
        self.flat[:at] += np.bincount((left * lay.symbols + right) * lay.classes + v.class_of[ids], minlength=at)
        near = np.flatnonzero(ids < lay.known)
        for side in (left, right):
            self.flat[at : at + lay.symbols * lay.known] += np.bincount(side[near] * lay.known + ids[near], minlength=lay.symbols * lay.known)
            at += lay.symbols * lay.known

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, class), (left, word), (right, word)."""
        lay = self.vocab.layout
        s, k, c = lay.symbols, lay.known, lay.classes
        a, b = s * s * c, s * s * c + s * k
        return self.flat[:a].reshape(s, s, c), self.flat[a:b].reshape(s, k), self.flat[b:].reshape(s, k)


def encoded(docs: DataFrame, vocab: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """A row for each document: row (unique), id, ids (unsigned 16-bit), tails and owns (its other words' hashes and
    numbers); and for each task, in rows with a piece, its sums."""
    context, kind = docs.sparkSession.sparkContext, docs.schema[id_col].dataType.simpleString()
    shared = context.broadcast(vocab)
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    names = ["row", "id", "ids", "tails", "owns", "piece", "sums"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        forms, sums, known = _Ids(vocab), Sums(vocab), vocab.layout.known
        row = TaskContext.get().partitionId() << 36
        held: list[np.ndarray] = []
        size = 0
        id_type = pa.null()

        def add() -> None:
            nonlocal held, size
            some = [x for x in held if len(x)]
            if some:
                lengths = np.array([len(x) for x in some])
                sums.add(np.concatenate(some).astype(np.int64), np.cumsum(lengths) - lengths)
            held, size = [], 0

        for b in batches:
            id_type = b.column(0).type
            ids, tails, owns = [], [], []
            for t in b.column(1):
                words = ascii_words(t.as_py())
                x = np.fromiter(map(forms.__getitem__, words), np.uint16, len(words))
                own = Counter(compress(words, (x >= known).tolist()))
                tails.append([_hash(w) for w in own])
                owns.append(list(own.values()))
                ids.append(x.tobytes())
                held.append(x)
                size += len(x)
                if size >= SUMMED:
                    add()
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(row, row + n), pa.int64()), b.column(0), pa.array(ids, pa.binary()), pa.array(tails, longs), pa.array(owns, ints), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
            row += n
        add()
        if sums.flat.any():
            cuts = np.array_split(sums.flat, PIECES)
            yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, pa.int64()), pa.nulls(PIECES, id_type), pa.nulls(PIECES, pa.binary()), pa.nulls(PIECES, longs), pa.nulls(PIECES, ints), pa.array(range(PIECES), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in cuts], pa.binary())], names)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"row bigint, id {kind}, ids binary, tails array<bigint>, owns array<int>, piece int, sums binary")


def corpus_sums(rows: DataFrame, vocab: Vocabulary) -> Sums:
    """The tasks' sums, added up a piece at a time as they come; Layout.cells numbers reach the driver."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(zlib.decompress(raw.as_py()), np.int64)
                total[p] = total[p] + x if p in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], ["piece", "sums"])

    out = Sums(vocab)
    for r in rows.where("piece is not null").select("piece", "sums").repartition(PIECES, "piece").mapInArrow(run, "piece int, sums binary").collect():
        np.array_split(out.flat, PIECES)[r["piece"]][...] += np.frombuffer(zlib.decompress(bytes(r["sums"])), np.int64)
    return out


# --- The network --------------------------------------------------------------------------


def _adam(arrays: list[np.ndarray], gradients, steps: int, rate: float) -> None:
    first, second = ([np.zeros_like(a) for a in arrays] for _ in range(2))
    for t in range(1, steps + 1):
        scale = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for a, g, m, v in zip(arrays, gradients(), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= scale * m / (np.sqrt(v) + 1e-8)


class ClassLayer:
    """Symbols on both sides -> tanh units -> softmax over the classes that the corpus has."""

    def __init__(self, joint: np.ndarray, seed: int = 0):
        symbols, _, classes = joint.shape
        r = np.random.default_rng(seed)
        self.joint, totals = joint, joint.sum((0, 1))
        self.bias = np.log(np.maximum(totals, 1e-300)) - np.log(max(1, totals.sum()))
        self.there = totals > 0
        self.left, self.right = (r.standard_normal((symbols, HIDDEN)) * 0.1 for _ in range(2))
        self.unit_bias, self.out = np.zeros(HIDDEN), r.standard_normal((HIDDEN, classes)) * 0.05

    def arrays(self) -> list[np.ndarray]:
        return [self.left, self.right, self.unit_bias, self.out, self.bias]

    def log_probabilities(self) -> np.ndarray:
        """Of every class for every pair of symbols; a class that the corpus lacks has none."""
        return self._forward()[1]

    def _forward(self) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(self.left[:, None, :] + self.right[None, :, :] + self.unit_bias)
        z = np.where(self.there, h @ self.out + self.bias, -np.inf)
        z -= z.max(2, keepdims=True) if self.there.any() else 0
        return h, z - np.log(np.exp(z).sum(2, keepdims=True))

    def loss(self) -> float:
        return float(-(self.joint * np.where(self.there, self.log_probabilities(), 0)).sum() / max(1, self.joint.sum()))

    def gradients(self) -> list[np.ndarray]:
        """Of the mean cross-entropy over the corpus, in the order of arrays()."""
        h, p = self._forward()
        n = self.joint.sum(2, keepdims=True)
        d = (np.exp(p) * n - self.joint) / max(1, n.sum())
        back = (d @ self.out.T) * (1 - h * h)
        return [back.sum(1), back.sum(0), back.sum((0, 1)), np.einsum("lrh,lrc->hc", h, d), d.sum((0, 1))]


class WordLayer:
    """Known words within their class: units of both neighbours' symbols, added, times the word's own, and its bias."""

    def __init__(self, joint: np.ndarray, by_left: np.ndarray, by_right: np.ndarray, bounds: list[int], seed: int = 1):
        r = np.random.default_rng(seed)
        symbols, known = by_left.shape
        counts = by_left.sum(0)
        self.joint, self.by_left, self.by_right = joint, by_left, by_right
        self.slices = [(c, lo, hi) for c, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if counts[lo:hi].any()]
        self.share = np.where(counts > 0, counts, 0).astype(float)  # exp of the bias: words that the corpus lacks have none
        self.left, self.right = (r.standard_normal((symbols, WORD_HIDDEN)) * 0.1 for _ in range(2))
        self.words = r.standard_normal((known, WORD_HIDDEN)) * 0.1

    def arrays(self) -> list[np.ndarray]:
        return [self.left, self.right, self.words]

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, word), (right, word), and the logarithm of what they are normalised by (left, right, class)."""
        a, b = self.left @ self.words.T, self.right @ self.words.T
        norm = np.zeros(self.joint.shape[:2] + (len(self.joint[0, 0]),))
        for c, lo, hi in self.slices:
            norm[:, :, c] = np.log((np.exp(a[:, lo:hi]) * self.share[lo:hi]) @ np.exp(b[:, lo:hi]).T)
        return a, b, norm

    def loss(self) -> float:
        a, b, norm = self.scores()
        some = sum(self.joint[:, :, c].sum() for c, _, _ in self.slices)
        bias = np.log(np.maximum(self.share, 1e-300))
        own = (self.by_left * (a + bias)).sum() + (self.by_right * b).sum()
        return float(-(own - sum((self.joint[:, :, c] * norm[:, :, c]).sum() for c, _, _ in self.slices)) / max(1, some))

    def gradients(self) -> list[np.ndarray]:
        """Of the mean cross-entropy: expected less observed numbers of words beside symbols."""
        a, b = self.left @ self.words.T, self.right @ self.words.T
        da, db, some = np.zeros_like(a), np.zeros_like(b), 0
        for c, lo, hi in self.slices:
            x, y, n = np.exp(a[:, lo:hi]) * self.share[lo:hi], np.exp(b[:, lo:hi]), self.joint[:, :, c]
            q = n / (x @ y.T)
            da[:, lo:hi] = x * (q @ y) - self.by_left[:, lo:hi]
            db[:, lo:hi] = y * (q.T @ x) - self.by_right[:, lo:hi]
            some += n.sum()
        da, db = da / max(1, some), db / max(1, some)
        return [da @ self.words, db @ self.words, da.T @ self.left + db.T @ self.right]


@dataclass
class Network:
    """A trained model as tables, which is all that scoring reads."""

    vocab: Vocabulary
    log_class: np.ndarray
    word_left: np.ndarray
    word_right: np.ndarray
    word_bias: np.ndarray
    word_norm: np.ndarray

    def known_part(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log-probability of each word's class, and of the word within it if it is known."""
        v = self.vocab
        left, right = _neighbours(ids, starts, v)
        c = v.class_of[ids]
        out = self.log_class[left, right, c].astype(np.float64)
        at = np.flatnonzero(ids < v.layout.known)
        w, lt, rt = ids[at], left[at], right[at]
        out[at] += self.word_left[lt, w].astype(np.float64) + self.word_right[rt, w] + self.word_bias[w] - self.word_norm[lt, rt, c[at]]
        return out

    def other_norms(self, ids: np.ndarray) -> float:
        """What a text's other words are divided by: its ending classes' counts in the other documents, as a sum of logarithms."""
        v = self.vocab
        own = np.bincount(ids[ids >= v.layout.known] - v.layout.known, minlength=v.layout.endings + 1)
        at = np.flatnonzero(own)
        return float((own[at] * np.log(v.tokens[at] - own[at] + ADDED * v.types[at])).sum())


def train(sums: Sums) -> Network:
    """Both layers by full steps over the corpus' sums; the same for the same sums."""
    joint, by_left, by_right = sums.parts()
    classes, words = ClassLayer(joint), WordLayer(joint, by_left, by_right, sums.vocab.layout.bounds())
    if joint.any():
        _adam(classes.arrays(), classes.gradients, STEPS, RATE)
        _adam(words.arrays(), words.gradients, WORD_STEPS, RATE)
    a, b, norm = words.scores()
    small = lambda x: np.ascontiguousarray(x, np.float32)
    log_class = classes.log_probabilities() if joint.any() else np.zeros(joint.shape)
    return Network(sums.vocab, small(log_class), small(a), small(b), np.log(np.maximum(words.share, 1e-300)), small(norm))


# --- Scores -------------------------------------------------------------------------------


def scores(rows: DataFrame, network: Network) -> DataFrame:
    """id, n_words, log_likelihood, per_word of every encoded document."""
    shared, kind = rows.sparkSession.sparkContext.broadcast(network), rows.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            texts = [np.frombuffer(x.as_buffer(), np.uint16).astype(np.int64) for x in b.column(2)]
            n = np.array([len(x) for x in texts], np.int64)
            out, i = np.zeros(len(texts)), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + n[j] <= SUMMED):
                    size += n[j]
                    j += 1
                some = np.arange(i, j)[n[i:j] > 0]
                if len(some):
                    ends = np.cumsum(n[some])
                    p = net.known_part(np.concatenate([texts[k] for k in some]), ends - n[some])
                    out[some] = np.add.reduceat(p, ends - n[some]) - [net.other_norms(texts[k]) for k in some]
                i = j
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(out)], ["row", "id", "n_words", "part"])

    docs = rows.where("row is not null")
    parts = docs.select("row", "id", "ids").mapInArrow(run, f"row bigint, id {kind}, n_words bigint, part double")
    # A word's number in the corpus meets the documents that have it, which it is shuffled by.
    tails = docs.where(F.size("tails") > 0).select("row", "owns", F.posexplode("tails").alias("i", "h")).select("row", "h", F.get("owns", F.col("i")).alias("own"))
    others = F.sum("own").over(Window.partitionBy("h")) - F.col("own")
    by_row = tails.select("row", (F.col("own") * F.log(others + F.lit(ADDED))).alias("x")).groupBy("row").agg(F.sum("x").alias("x"))
    total = F.col("part") + F.coalesce("x", F.lit(0.0))
    return parts.join(by_row, "row", "left").select("id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout = LAYOUT) -> DataFrame:
    """id, n_words, log_likelihood, per_word of every document, by a network trained on all of them.

    Whole texts. Null and empty texts have no words, likelihood 0 and a null per_word.
    Rows are documents of their own: of repeated ones, each has the others' words in the
    corpus. Other columns are not read, and an empty table gives no rows.

    Texts are read twice, to count and to encode; ids and other words' hashes are kept in
    the shared folder, and only the latter are shuffled.
    """
    bounded(docs.sparkSession)
    vocab = vocabulary(word_counts(docs, text_col), layout)
    rows = cut(encoded(docs, vocab, id_col, text_col))
    return scores(rows, train(corpus_sums(rows, vocab))).withColumnRenamed("id", id_col)
