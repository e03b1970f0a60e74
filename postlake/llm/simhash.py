"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within t differing bits must, for any split of the bits into m parts with
thresholds that sum to t - m + 1, be within the threshold of some part. Bits that go
together are put in the same part, and dynamic programming gives each part its threshold
(-1: not probed) so that the estimated probes and candidates are fewest. A part within
threshold k is probed by k wildcards: fingerprints meet that agree on all its other bits.
Candidates are verified on all bits.

A probe that very many distinct fingerprints share is not turned into pairs. Its members
meet at the fingerprints between them instead: two are within t bits exactly if some
value is within t / 2 bits of both, so that linking each to the least of those that
reach a value gives the same components, with a fixed number of rows for each member.

Texts that share a given part of their shingles are linked in two steps. Those whose
fingerprints link as above are compared first. The others may differ in so many of 64 bits
that every part would meet every other, so that for what is not joined by then shingles are
dealt into parts by their hash, and each part has a fingerprint of its own: an edit changes
few parts and leaves the others equal. Which parts these are must not hang on the data:
unless as many are probed as shingles may differ, a choice of those where few texts meet
is one of those where the similar ones do not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, cut, give_back, sent, tidy, with_looked_up
from .components import components

BITS, SEED = 64, 42
#: Words to a shingle, and differing bits up to which fingerprints link, in the query (fixed values).
SHINGLE, MAX_DISTANCE = 3, 2
#: Members of a probe up to which they are compared in pairs.
PAIRED = 64
#: What a candidate costs beside a probe's row.
PAIR_COST = 2.0

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACES = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of the text's shingles in order, repeats included; of the whole sequence if it is shorter; none without words."""
    words = ascii_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACES
    counts = np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return int(np.packbits((2 * counts > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """id, fp (signed) of every row; whole texts, nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_signed(majority(shingle_hashes(t.as_py(), size))) for t in b.column(1)], pa.int64())], ["id", "fp"])

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, fp bigint")


# --- The plan: parts and thresholds ---------------------------------------------------


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have each pair of bits set: sums over all rows, 64 x 64 numbers."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        n = 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (x.T @ x).astype(np.int64)
            n += len(x)
        i = np.arange(BITS * BITS + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.append(total.ravel(), n))], ["i", "n"])

    rows = distinct.select("fp").mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(BITS * BITS + 1, np.int64)
    for r in rows:
        flat[r["i"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in parts of like size; each part grows by the bit that goes most with those it has."""
    p = np.diag(together) / max(1, n)
    cov = together / max(1, n) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(tie, 0)
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        first = max(sorted(left), key=lambda b: tie[b, sorted(left)].sum())
        part = [first]
        left.discard(first)
        while len(part) < size:
            best = max(sorted(left), key=lambda b: tie[b, part].sum())
            part.append(best)
            left.discard(best)
        out.append(sorted(part))
    return out


def _near(agree: np.ndarray, most: int) -> list[float]:
    """Chances that two fingerprints differ in at most 0..most of the bits, from each bit's chance to agree."""
    at = np.zeros(most + 1)
    at[0] = 1.0
    for a in agree:
        at[1:] = at[1:] * a + at[:-1] * (1 - a)
        at[0] *= a
    return np.cumsum(at).tolist()


def allocate(n: int, together: np.ndarray, parts: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """The least estimated cost, and each part's threshold, with (threshold + 1) summing to distance + 1."""
    p = np.diag(together) / max(1, n)
    agree = p * p + (1 - p) ** 2
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in parts:
        near = _near(agree[part], distance)
        cost = [0.0] + [n * math.comb(len(part), t) + PAIR_COST * n * n / 2 * near[t] for t in range(min(distance, len(part)) + 1)]
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, more in enumerate(cost, -1):
                k = used + t + 1
                if k <= distance + 1 and (k not in step or c + more < step[k][0]):
                    step[k] = (c + more, [*chosen, t])
        best = step
    return best.get(distance + 1, (math.inf, []))


def plan(n: int, together: np.ndarray, distance: int) -> list[tuple[list[int], int]]:
    """The parts with their thresholds, of the number of parts that costs least."""
    options = []
    for m in range(1, distance + 3):
        parts = group_bits(n, together, m)
        cost, thresholds = allocate(n, together, parts, distance)
        options.append((cost, m, [(b, t) for b, t in zip(parts, thresholds) if t >= 0]))
    return min(options, key=lambda x: x[:2])[2]


def _masks(planned: list[tuple[list[int], int]]) -> list[int]:
    """For each part, the bits that must agree, once for each choice of wildcards."""
    out = []
    for bits, t in planned:
        whole = sum(1 << b for b in bits)
        out += [whole & ~sum(1 << b for b in free) for free in combinations(bits, t)]
    return out


# --- Probe and verify ------------------------------------------------------------------


def links(distinct: DataFrame, distance: int = MAX_DISTANCE, paired: int = PAIRED) -> DataFrame:
    """u, v: edges between distinct fingerprints (fp) whose components are those of all pairs within distance.

    Both ends of each edge are within distance. Up to `paired` members of a probe are
    compared in pairs; members of larger ones meet at the values between them.
    """
    if distance <= 0:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where("u <> v")
    masks = _masks(plan(*bit_statistics(distinct), distance))
    keys = distinct.select("fp", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("x")) for k, m in enumerate(masks)))).alias("p")).select("fp", "p.k", "p.x")
    # Kept apart, so that the join is of plain shuffles, whose hot keys Spark splits.
    shared = cut(keys.groupBy("k", "x").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(keys.join(shared, ["k", "x"]))
    cold = met.where(F.col("n") <= paired).select("k", "x", "fp")
    pairs = cold.select("k", "x", F.col("fp").alias("u")).join(cold.select("k", "x", F.col("fp").alias("v")), ["k", "x"]).where("u < v")
    pairs = pairs.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance).select("u", "v")
    hot = met.where(F.col("n") > paired).select("fp").distinct()
    return pairs.union(between(hot, distance))


def between(distinct: DataFrame, distance: int) -> DataFrame:
    """u, v: stars around the values that fingerprints within distance have in common."""
    half = [sum(1 << b for b in c) for k in range(distance // 2 + 1) for c in combinations(range(BITS), k)]
    free = [1 << b for b in range(BITS)] if distance % 2 else [0]
    values = F.explode(F.array(*(F.lit(_signed(x)) for x in half))).alias("turn")
    rows = distinct.select("fp", values)
    if distance % 2:
        rows = rows.select("fp", "turn", F.explode(F.array(*(F.lit(_signed(b)) for b in free))).alias("free"))
    else:
        rows = rows.withColumn("free", F.lit(0).cast("bigint"))
    at = F.col("fp").bitwiseXOR(F.col("turn")).bitwiseAND(F.bitwise_not("free")).alias("at")
    rows = rows.select("fp", "free", at)
    least = rows.groupBy("free", "at").agg(F.min("fp").alias("u"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(least, ["free", "at"]).where("fp <> u").select("u", F.col("fp").alias("v"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """id, fp (signed), component for every row: the least id among all that links of fingerprints reach.

    Rows of one fingerprint are one node, so copies cost a row each. Null and empty texts
    have the fingerprint zero and link like any other. Repeated rows get the same class.
    A null id gets a class but names one only if no other id is there. Other columns are
    not read; an empty table gives no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, size))
    least = cut(prints.groupBy("fp").agg(F.min("id").alias("least")))
    found = components(links(least, distance))
    linked = cut(least.join(found, least["fp"] == found["node"], "left").select(least["fp"], "least", F.coalesce("root", least["fp"]).alias("root")))
    names = linked.groupBy("root").agg(F.min("least").alias("component"))
    classes = cut(with_looked_up(linked, names, "root").select("fp", "component"))
    return with_looked_up(prints, classes, "fp").select(F.col("id").alias(id_col), "fp", "component")


def components_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every document."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# --- Similarity of shingle sets: parts of shingles, a fingerprint each -------------------

#: Words to a shingle and the Jaccard similarity from which documents are near-duplicates.
SIMILAR_SHINGLE, SIMILARITY = 5, 0.8
#: Parts probed of each document (threshold 0; the others have -1). At the similarity above, two
#: sets share none of them with a probability of some 1e-7; None probes the exact way instead.
PROBED = 32
#: Longs of a set's parity sketch.
SKETCH = 8
#: Members of a large probe that all its members are compared with first.
LEADERS = 4
#: Members of a block of a large probe, least and most, and shingles that a block has about.
FEWEST, MOST, CELLS = 64, 4096, 1 << 20


def _parts(n: float) -> int:
    """Parts, a power of two, among which n shingles are dealt: one to four shingles each."""
    return 1 << max(0, math.ceil(math.log2(n / (2 if n < 64 else 4)))) if n > 0 else 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def part_keys(distinct: np.ndarray, similarity: float = SIMILARITY, probed: int | None = PROBED) -> np.ndarray:
    """A key (signed) for each probed part that has shingles: of the number of parts, the part's place and its fingerprint.

    With no number of probed parts, each shingle is a part and the parts go by their hashes:
    of two similar sets one shingle at least is among the first of both, as many as may
    differ and one more. That loses no pair, at a key for every fifth shingle.

    Else parts double with length. A text also counts as one of the longest length that is
    still similar, so that similar texts on both sides of a step share a count of parts.
    """
    n, out = len(distinct), [np.zeros(0, np.uint64)]
    if probed is None:
        least = math.ceil(similarity * n - 1e-9)
        return np.sort(distinct)[: n - least + 1].astype("<u8").view("<i8")
    for m in sorted({_parts(n), _parts(n / similarity)}):
        place = distinct & np.uint64(m - 1)
        own = np.flatnonzero(place < probed)
        own = own[np.argsort(place[own], kind="stable")]
        if not len(own):
            continue
        place = place[own]
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        bits = np.unpackbits(distinct[own].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        sizes = np.diff(np.append(first, len(own)))
        prints = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
        out.append(_mixed(prints ^ _mixed(place[first] + np.uint64(m << 8))))
    return np.concatenate(out).astype("<u8").view("<i8")


def parities(values: np.ndarray, bits: int) -> np.ndarray:
    """For each of `bits` slots (a power of two), whether an odd number of the values falls there, as longs.

    Two sets' sketches differ in no more bits than the sets have values apart.
    """
    odd = np.bincount((values & np.asarray(bits - 1, values.dtype)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, th (a hash of the text), text: rows of one id and text are the same document."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _profile(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, probed: int | None = PROBED) -> DataFrame:
    """id, th, node (digest of the shingle set), fp (signed), sketch, n, keys of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    longs = pa.list_(pa.int64())

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(2):
                d = np.unique(shingle_hashes(t.as_py(), size))
                rows.append((_digest(d), _signed(majority(d)), parities(d >> np.uint64(32), 64 * SKETCH).view("<i8"), len(d), part_keys(d, similarity, probed)))
            cols = list(zip(*rows)) or [[], [], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), longs, pa.int64(), longs)))], ["id", "th", "node", "fp", "sketch", "n", "keys"])

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"id {kind}, th bigint, node bigint, fp bigint, sketch array<bigint>, n bigint, keys array<bigint>")


def _digest(distinct: np.ndarray) -> int:
    return _signed(xxhash.xxh64_intdigest(distinct.tobytes(), SEED))


def _print_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """u, v: nodes (node, fp) whose fingerprints link within distance; of nodes of one fingerprint, each with the least."""
    least = cut(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    same = with_looked_up(nodes.select("node", "fp"), least, "fp").where("node <> least").select("node", "least")
    end = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias("node_" + c))
    near = links(least.select("fp"), distance).distinct().join(end("u"), "u").join(end("v"), "v").select("node_u", "node_v")
    return same.union(near).toDF("u", "v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    """node: the ends of pairs (u, v)."""
    return pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()


def _not_joined(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs (u, v) whose ends are not in one group of found (node, root), which is read twice."""
    found = sent(found)
    end = lambda c: found.select(F.col("node").alias(c), F.col("root").alias("root_" + c))
    return pairs.join(end("u"), "u", "left").join(end("v"), "v", "left").where("root_u is null or root_v is null or root_u <> root_v").select("u", "v")


def _met(nodes: DataFrame) -> DataFrame:
    """x, node, c: nodes at each probe that c > 1 of them share."""
    keys = nodes.select("node", F.explode("keys").alias("x"))
    # Kept apart, so that the join is of plain shuffles, whose hot keys Spark splits.
    shared = cut(keys.groupBy("x").agg(F.count("*").alias("c")).where("c > 1"))
    return keys.join(shared, "x")


def _candidates(cold: DataFrame, similarity: float) -> DataFrame:
    """u, v: distinct nodes that share a probe, but those whose lengths or sketches show that they are less similar.

    Sets of similarity s are (1 - s) / (1 + s) of both their lengths apart at most.
    """
    side = lambda s: cold.select("x", *(F.col(c).alias(c + s) for c in ("node", "sketch", "n")))
    apart = sum((F.bit_count(F.col("sketch_u")[k].bitwiseXOR(F.col("sketch_v")[k])) for k in range(SKETCH)), F.lit(0))
    pairs = side("_u").join(side("_v"), "x").where("node_u < node_v")
    near = pairs.where((F.least("n_u", "n_v") >= similarity * F.greatest("n_u", "n_v")) & (apart * (1 + similarity) <= (1 - similarity) * (F.col("n_u") + F.col("n_v")) + 1e-6))
    return near.select(F.col("node_u").alias("u"), F.col("node_v").alias("v")).distinct()


def _stars(hot: DataFrame, similarity: float) -> DataFrame:
    """u, v: members of each large probe (x, node, sketch, n) with its leaders, but pairs that lengths or sketches rule out.

    Leaders are the least members by LEADERS hashes. Links with them join most of a group
    of copies, so that few members are left to compare with all others.
    """
    least = (F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "sketch")) for k in range(LEADERS))
    leaders = hot.groupBy("x").agg(F.array(*least).alias("leaders"))
    apart = lambda m: sum((F.bit_count(F.col("sketch")[k].bitwiseXOR(m["sketch"][k])) for k in range(SKETCH)), F.lit(0))
    like = lambda m: (m["node"] != F.col("node")) & (F.least("n", m["n"]) >= similarity * F.greatest("n", m["n"])) & (apart(m) * (1 + similarity) <= (1 - similarity) * (F.col("n") + m["n"]) + 1e-6)
    pairs = hot.join(sent(cut(leaders), row_bytes=LEADERS * (64 + 8 * SKETCH)), "x").select("node", F.explode(F.transform(F.filter("leaders", like), lambda m: m["node"])).alias("m"))
    return pairs.select(F.least("node", "m").alias("u"), F.greatest("node", "m").alias("v")).distinct()


def _alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(p, q, assume_unique=True))
    return both >= similarity * (len(p) + len(q) - both)


def block_links(sets: list[np.ndarray], left: int, similarity: float, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of similar sets that join all that are joined by any pair: of all sets if left is 0, else of the first `left` with the others.

    Every pair is compared by parity sketches as wide as the sets need and, unless these
    show that it is not similar or links have joined it before, by the sets. joined:
    groups that are joined already, by number.
    """
    n = np.array([len(x) for x in sets], np.int64)
    bits = 64 * SKETCH
    while bits < 2 * n.max(initial=0):
        bits *= 2
    sketch = np.array([parities(x, bits) for x in sets])
    group, out = np.arange(len(sets)) if joined is None else joined.copy(), []
    for i in range(left or len(sets)):
        first = left or i + 1
        at = first + np.flatnonzero(group[first:] != group[i])
        least, most = np.minimum(n[at], n[i]), np.maximum(n[at], n[i])
        at = at[least >= similarity * most]
        apart = np.zeros(len(at), np.int64)
        for k in range(0, len(at), 1024):
            apart[k : k + 1024] = np.bitwise_count(sketch[at[k : k + 1024]] ^ sketch[i]).sum(1, dtype=np.int64)
        for j in at[apart * (1 + similarity) <= (1 - similarity) * (n[at] + n[i]) + 1e-6].tolist():
            if group[j] != group[i] and _alike(sets[i], sets[j], similarity):
                group[group == group[j]] = group[i]
                out.append((i, j))
    return out


def _hot_links(hot: DataFrame, members: DataFrame, found: DataFrame, similarity: float) -> DataFrame:
    """u, v: links among the members (x, node, n) of large probes, which with those found before join all that any pair's similarity joins.

    found: node, root of the components so far. Members of a probe's largest component
    need not meet one another; the others meet all. Probes of one largest component are
    worked on together, so that members that share many probes meet once. Members are dealt into classes of
    length, of which only the same and the next can be similar, and these into blocks by
    a hash of the node. Each pair of blocks is one group, which two blocks bound.
    """
    width = math.log(1 / similarity) * (1 + 1e-9) + 1e-9
    hot = cut(hot.join(found, "node", "left").select("x", "node", "n", F.coalesce("root", "node").alias("root"), F.floor(F.log(F.col("n").cast("double")) / width).alias("kind")))
    roots = hot.groupBy("x", "root").agg(F.count("*").alias("c")).groupBy("x").agg(F.max(F.struct("c", "root")).alias("m"), F.count("*").alias("roots"))
    mains = sent(cut(roots.where("roots > 1").select("x", F.col("m.root").alias("main"))))
    hot = cut(hot.join(mains, "x").select(F.col("main").alias("x"), "node", "n", "root", "kind", (F.col("root") == F.col("main")).alias("inner")).distinct())
    room = F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(F.lit(CELLS) / F.max("n"))))
    sizes = cut(hot.groupBy("x", "kind").agg(*(F.ceil(F.count_if(of) / room).cast("int").alias(name) for name, of in (("o", ~F.col("inner")), ("i", F.col("inner"))))))
    beside = lambda by, tail: sizes.select("x", (F.col("kind") + by).alias("kind"), *(F.col(c).alias(c + tail) for c in "oi"))
    sizes = cut(sizes.join(beside(1, "_under"), ["x", "kind"], "left").join(beside(-1, "_over"), ["x", "kind"], "left").fillna(0))
    rows = hot.select("x", "node", "kind", "root", "inner").join(sent(sizes), ["x", "kind"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(F.col("inner"), F.col("i")).otherwise(F.col("o"))).cast("int"))

    def meet(lo, hi, side: int, kind, step: int):
        """The pairs of blocks of a member: the left block's place, the right one's, and the classes."""
        other = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
        a, b = (lambda k: F.col("own"), lambda k: k) if side == 0 else (lambda k: k, lambda k: F.col("own"))
        return F.transform(other, lambda k: F.struct(kind.alias("a_kind"), F.lit(step).alias("step"), a(k).alias("a"), b(k).alias("b"), F.lit(side).alias("side")))

    none, kind = F.lit(0), F.col("kind")
    # Steps 0 and 1: others with others of the same and the next class; 2 to 4: others with inner ones of the same, next and last class.
    outer = F.concat(
        meet(F.col("own"), F.col("o") - 1, 0, kind, 0), meet(none, F.col("own") - 1, 1, kind, 0),
        meet(none, F.col("o_over") - 1, 0, kind, 1), meet(none, F.col("o_under") - 1, 1, kind - 1, 1),
        meet(none, F.col("i") - 1, 0, kind, 2), meet(none, F.col("i_over") - 1, 0, kind, 3), meet(none, F.col("i_under") - 1, 0, kind, 4),
    )
    inner = F.concat(meet(none, F.col("o") - 1, 1, kind, 2), meet(none, F.col("o_under") - 1, 1, kind - 1, 3), meet(none, F.col("o_over") - 1, 1, kind + 1, 4))
    turns = F.when(F.col("inner"), inner).otherwise(outer)
    rows = rows.select("x", "node", "root", F.explode(turns).alias("t")).join(members, "node").select("x", "t.*", "node", "root", "set")

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by([("side", "ascending"), ("node", "ascending")])
        side, node = block["side"].to_numpy(), block["node"].to_numpy()
        # Only a block that meets itself has no right side of its own.
        itself = not block["step"][0].as_py() and block["a"][0].as_py() == block["b"][0].as_py()
        left = 0 if itself else int((side == 0).sum())
        joined = np.unique(block["root"].to_numpy(), return_inverse=True)[1]
        found = block_links([np.frombuffer(s.as_buffer(), "<u8") for s in block["set"]], left, similarity, joined) if itself or 0 < left < len(side) else []
        out = pa.table({"u": pa.array([int(node[i]) for i, _ in found], pa.int64()), "v": pa.array([int(node[j]) for _, j in found], pa.int64())})
        if len(node) >= FEWEST:
            del block
            give_back()
        return out

    return rows.groupBy("x", "a_kind", "step", "a", "b").applyInArrow(run, "u bigint, v bigint")


def _verified(pairs: DataFrame, members: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets (members: node, set) are similar."""

    @tidy
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [_alike(*(np.frombuffer(s.as_buffer(), "<u8") for s in x), similarity) for x in zip(b.column(2), b.column(3))]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = pairs.join(members.select(F.col("node").alias("u"), F.col("set").alias("su")), "u")
    two = one.join(members.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v").select("u", "v", "su", "sv")
    return cut(two.mapInArrow(verified, "u bigint, v bigint"))


def _classified(docs: DataFrame, id_col: str, text_col: str, size: int, similarity: float, paired: int, probed: int | None) -> DataFrame:
    """id, th, root of every row: the group of similar documents that it is in."""
    prof = cut(_profile(docs, id_col, text_col, size, similarity, probed))
    # One row stands for a shingle set: that of the least id, then of the least text hash.
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th", "fp", "sketch", "n", "keys")).alias("r")
    nodes = cut(prof.groupBy("node").agg(one).select("node", "r.*").drop("no_id"))
    near = cut(_print_pairs(nodes, MAX_DISTANCE))
    met = cut(_met(nodes))
    # What tells that a pair is not similar comes to the probes' members alone.
    cold, hot = (met.where(c).select("x", "node").join(nodes.select("node", "sketch", "n"), "node") for c in (F.col("c") <= paired, F.col("c") > paired))
    hot = cut(hot)
    pairs = cut(_candidates(cold, similarity).union(_stars(hot, similarity)).distinct())
    ends = _ends(pairs.union(near)).union(hot.select("node")).distinct()
    wanted = cut(nodes.join(ends, "node", "left_semi").select(F.col("id").alias("__id"), F.col("th").alias("__th")))
    rows = _keyed(docs, id_col, text_col)
    texts = rows.join(sent(wanted), F.col("id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left_semi")

    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.unique(shingle_hashes(t.as_py(), size)) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(d) for d in found], pa.int64()), pa.array([d.tobytes() for d in found], pa.binary())], ["node", "set"])

    members = cut(texts.select("text").mapInArrow(sets, "node bigint, set binary").dropDuplicates(["node"]))

    # Of the sets, only the few that these pairs have are moved.
    links = _verified(near, members.join(sent(cut(_ends(near))), "node", "left_semi"), similarity)
    # Each time the groups so far go on as stars, which join what their links joined and need fewer rounds.
    found = cut(components(links))
    rest = _not_joined(pairs.join(near, ["u", "v"], "left_anti"), found)
    found = components(found.toDF("u", "v").union(_verified(rest, members, similarity)))
    if not hot.isEmpty():
        found = cut(found)
        found = components(found.toDF("u", "v").union(_hot_links(hot.select("x", "node", "n"), members, found, similarity)))
    linked = cut(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root")))
    return cut(with_looked_up(prof.select("id", "th", "node"), linked, "node").select("id", "th", "root"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, paired: int = PAIRED, probed: int | None = PROBED) -> DataFrame:
    """id, component of every row: the least id that links of similar shingle sets reach, or null where no row of the group has one.

    Candidates are those whose fingerprints link (links), and of what these leave apart those
    that share the fingerprint of a part; a link is verified by the Jaccard
    similarity of the whole shingle sets, as 64-bit hashes. Texts of one set, null, empty
    and blank ones too, are one node. Pairs of a probe of more than `paired` members are
    compared in blocks; none is left out that links have not joined. probed: parts of a text
    that are probed; None for the exact way (part_keys). Repeated rows get the same class, other columns are not read, and an empty table gives no rows.
    """
    rows = _classified(docs, id_col, text_col, size, similarity, paired, probed)
    names = cut(rows.groupBy("root").agg(F.min("id").alias("component")))
    return with_looked_up(rows, names, "root").select(F.col("id").alias(id_col), "component")


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, paired: int = PAIRED, probed: int | None = PROBED) -> DataFrame:
    """The rows of docs, as they are, one for each group of similar documents.

    It is the row of the least id, rows without an id coming last, then of the least hash
    of its text; of equal rows one stays. So null, empty and blank texts, which are one
    group, leave one row. Rows of one id with texts that are not similar are decided each
    for itself. Any names of columns will do; an empty table stays empty.
    """
    rows = _classified(docs, id_col, text_col, size, similarity, paired, probed)
    groups = rows.groupBy("root").agg(F.count("*").alias("n"), F.min(F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id0"), F.col("th").alias("th0"))).alias("w"))
    several = cut(groups.where("n > 1").select("root", "w.id0", "w.th0"))
    first = F.col("id").eqNullSafe(F.col("id0")) & (F.col("th") == F.col("th0"))
    decided = cut(with_looked_up(rows, several, "root").groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(F.bool_or(first).alias("first"), F.count("*").alias("n")))
    gone, again = (cut(decided.where(c).select("__id", "__th")) for c in ("not first or n > 1", "first and n > 1"))
    # Whatever docs' columns are called, they must not clash with those that are joined.
    own = {c: f"__own_{i}" for i, c in enumerate(docs.columns)}
    keyed = docs.toDF(*own.values()).withColumn("__hash", F.xxhash64(F.col(own[text_col]).cast("string")))
    same = F.col(own[id_col]).eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__th"))
    left = keyed.join(sent(gone), same, "left_anti").drop("__hash")
    if not again.isEmpty():
        # Of rows that are the first of their group more than once, one.
        left = left.unionByName(keyed.join(sent(again), same, "left_semi").dropDuplicates([own[id_col], "__hash"]).drop("__hash"))
    return left.toDF(*docs.columns)
