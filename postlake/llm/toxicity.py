"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, undoes homoglyphs and digit substitutions, drops invisible
characters and turns marks and white space into single separators, so that a pattern
that starts with a space starts a word. The lexicon holds words and word beginnings with
their log-odds, learned from labelled rows; phrases on the exception list cancel what
they cover. The sum of the hits' weights, alone and by length, gives the score through a
logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, tidy

#: Labelled rows that the lexicon and curve are fitted on at most, taken in the order of a hash of their id.
MAX_LABELLED = 20_000
#: Toxic rows that have a pattern at least; and of these rows either a share, or evidence: how unlikely the pattern's rows
#: would be if it told nothing (a likelihood ratio, as a logarithm), which asks for no more rows as labels grow.
LEAST_ROWS, LEAST_SHARE, LEAST_EVIDENCE = 3, 0.01, 12.0
#: A score from which a document counts as toxic.
THRESHOLD = 0.3
#: Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown car")
#: Look-alike letters and what they stand for (fixed values).
HOMOGLYPHS = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j", "к": "k", "м": "m", "т": "t", "н": "h", "ԁ": "d", "ο": "o", "α": "a", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "κ": "k", "υ": "u", "ı": "i"}
#: Digits and signs that stand for letters (fixed values).
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Characters without a shape (fixed values).
INVISIBLE = "­​‌‍⁠﻿"
_SEPARATORS = " \t\n\x0b\x0c\r\x85\xa0  　!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~«»“”‘’…–—¡¿"
_FOLD = str.maketrans({**{c: " " for c in _SEPARATORS}, **{c: None for c in INVISIBLE}, **HOMOGLYPHS, **SUBSTITUTES, **{chr(0xFF41 + i): chr(97 + i) for i in range(26)}})
_SHORT, _LONG, _WHOLE = 3, 8, 24
_FLUSH, _COPY_HASHES = 200_000, 3


def fold(text: str | None) -> str:
    """The text between separators; a separator alone for null."""
    return f" {(text or '').lower().translate(_FOLD)} "


def features(folded: str) -> set[str]:
    """Patterns that the text has: its words, and beginnings of _SHORT to _LONG characters of longer ones."""
    out = set()
    for w in set(folded.split(" ")):
        if _SHORT <= len(w) <= _WHOLE:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(_SHORT, min(_LONG, len(w) - 1) + 1))
    return out


def _copy_key(folded: str) -> int:
    """The least of three hashes each of the text's three-word runs, together: near copies mostly share it, and texts that
    have but a passage in common do not."""
    w = folded.split()
    runs = {" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass") for i in range(max(1, len(w) - 2))}
    least = [min((xxhash.xxh64_intdigest(r, seed) for r in runs), default=0) for seed in range(_COPY_HASHES)]
    x = xxhash.xxh64_intdigest(repr(least).encode(), 0)
    return x - (1 << 64) if x >> 63 else x


@dataclass
class Model:
    """A fitted lexicon and curve; small enough to go with each task."""

    lexicon: list[tuple[str, float]] = field(default_factory=list)
    exceptions: Sequence[str] = EXCEPTIONS
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {**self.__dict__, "_automaton": None}

    def _matcher(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for pattern, weight in self.lexicon:
                a.add_word(pattern, (len(pattern), weight))
            for phrase in self.exceptions:
                p = f" {' '.join(fold(phrase).split())}"
                a.add_word(p, (len(p), -1.0))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def weigh(self, folded: str) -> float:
        """The sum, over words that start a match, of the largest weight; none within an exception."""
        matcher = self._matcher()
        if not len(matcher):
            return 0.0
        best, spared = {}, []
        for end, (size, weight) in matcher.iter(folded):
            start = end - size + 1
            if weight < 0:
                spared.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        if spared:
            return sum(w for s, w in best.items() if not any(a <= s < b for a, b in spared))
        return sum(best.values())

    def inputs(self, folded: str) -> tuple[float, float]:
        """What the curve reads: the weight, and the weight by length."""
        weight = self.weigh(folded)
        return math.log1p(weight), math.log1p(100 * weight / max(1, folded.count(" ") - 1)) if weight else 0.0

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.inputs(fold(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 by 4; such rows' labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _prune(rows: list[tuple[str, int, int]], toxic: int, clean: int) -> list[tuple[str, float]]:
    """Of patterns that extend one another, the longest without loss of support, and none that another already covers."""
    odds = {f: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)) for f, t, c in rows}
    support, pure = {f: t for f, t, _ in rows}, {f: t / (t + c) for f, t, c in rows}
    kept: list[str] = []
    longer: dict[str, int] = {}  # the best support among the extensions of each beginning
    for f, t, _ in rows:
        for k in range(_SHORT + 1, len(f)):
            longer[f[:k]] = max(longer.get(f[:k], 0), t)
    chosen = {f for f in odds if longer.get(f, 0) < 0.95 * support[f]}
    for f in sorted(chosen, key=lambda f: (len(f), f)):
        heads = [f[:k] for k in range(_SHORT + 1, len(f)) if f[:k] in chosen]
        if not any(pure[h] >= pure[f] - 0.02 for h in heads):
            kept.append(f)
    return sorted((f, round(odds[f], 6)) for f in kept)


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton's steps, with a small penalty on the slopes."""
    if not len(y):
        return Model().curve
    z = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(3), np.diag([1e-3, 1.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(round(float(v), 9) for v in w)


def _least(labelled: DataFrame, most: int) -> DataFrame:
    """The first `most` rows in the order of a hash of the id.

    Of many more rows those are compared whose hash is in the range that twice as many
    fall into, so that tasks do not send `most` rows each.
    """
    h, n = F.xxhash64("id"), labelled.count()
    if n > 2 * most:
        some = labelled.where(h < F.lit(-(1 << 63) + (1 << 64) * 2 * most // n))
        labelled = some if some.count() >= most else labelled
    return labelled.orderBy(h, "id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_labelled: int = MAX_LABELLED, exceptions: Sequence[str] = EXCEPTIONS) -> Model:
    """A model of at most max_labelled labelled rows that are not held out.

    Near copies among them mostly count once. A label that is null, or of a null id, is left
    out; of several labels of an id the largest counts. Without rows of both labels the
    model has no lexicon and gives every text the same low score.
    """
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("label"))
    chosen = _least(cut(chosen), max_labelled)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "label")

    @tidy
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([_copy_key(fold(t.as_py())) for t in b.column(0)], pa.int64())], ["text", "label", "key"])

    rows = cut(rows.mapInArrow(keyed, "text string, label int, key bigint").dropDuplicates(["label", "key"]))
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic or not clean:
        return Model(exceptions=tuple(exceptions))

    @tidy
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[Counter, Counter] = (Counter(), Counter())

        def flush():
            names = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([found[k][n] for n in names], pa.int64()) for k in (1, 0))], ["feature", "t", "c"])
            found[0].clear()
            found[1].clear()
            return out

        for b in batches:
            for text, label in zip(b.column(0), b.column(1)):
                found[label.as_py()].update(features(fold(text.as_py())))
                if len(found[0]) + len(found[1]) > _FLUSH:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(counted, "feature string, t bigint, c bigint").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    t, c, share = F.col("t"), F.col("c"), toxic / (toxic + clean)
    pure = (t * clean > 7 * c * toxic) & (t > c)
    # Rows of the two kinds, against those that chance would give it.
    evidence = t * F.log(t / ((t + c) * share)) + F.when(c > 0, c * F.log(c / ((t + c) * (1 - share)))).otherwise(0.0)
    told = (t >= int(LEAST_SHARE * toxic)) | (evidence >= LEAST_EVIDENCE)
    best = counts.where((t >= LEAST_ROWS) & pure & told)  # patterns of max_labelled rows at most
    model = Model(_prune([(r["feature"], r["t"], r["c"]) for r in best.collect()], toxic, clean), tuple(exceptions))

    @tidy
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [model.inputs(fold(t.as_py())) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in got], pa.float64()), pa.array([y for _, y in got], pa.float64()), b.column(1)], ["x", "y", "label"])

    seen = rows.mapInArrow(measured, "x double, y double, label int").toPandas().sort_values(["x", "y", "label"])  # max_labelled rows at most
    model.curve = _curve(seen[["x", "y"]].to_numpy(float), seen["label"].to_numpy(float))
    return model


def toxicity_scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score for every row of docs, without a shuffle.

    Whole texts are read; null and empty ones score as a text without hits. Repeated
    rows score alike, other columns are not read, and an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], ["id", "score"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def clean_documents(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, as they are, whose text scores under the threshold; nothing is shuffled."""
    at = docs.columns.index(text_col)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by a model of the rows that are not held out."""
    out = toxicity_scores(docs, fit(docs, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
