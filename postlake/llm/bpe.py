"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

The leaves of a tree are the ranks of a piece's adjacent symbol pairs. Its root is the
lowest rank, and the way down that keeps to the left where both sides have it leads to the
leftmost such pair. A merge changes three leaves and what is above them, so that a piece of
n bytes takes n log n steps, however long it is. Merging ends when the root is no rank.

A worker keeps the ids of a bounded number of pieces, as most recur.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy
from .encoding import byte_symbols

#: Pieces kept by a worker in each of two generations, and the longest that is kept.
KEPT, KEPT_CHARS = 1 << 19, 48
#: How a text is split into pieces (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Before these characters, unless white space of any kind is before them, a piece ends (fixed value).
CUT = re.compile(r"(?<=\S)(?=[\x20\x09-\x0D])")
#: From here on, characters may be classed otherwise by another Unicode version; the tokenizer's own splitter decides.
OTHER_VERSIONS = re.compile("[Ԁ-\U0010ffff]")
#: No rank, and bytes from which a piece's numbers are kept as arrays.
_NONE, _LONG = 2**31 - 1, 1 << 15
#: Characters that are split at a time, and pieces that are looked up together.
_BLOCK, _TOGETHER = 1 << 20, 1 << 18


def default_tokenizer() -> str:
    """The public byte-level vocabulary's place; a parameter of every function that encodes."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteLevelBpe(dict):
    """Maps pieces of text to their ids as native unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, splitter, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec.get("normalizer") or splitter.get("type") != "ByteLevel" or splitter.get("add_prefix_space") or not splitter.get("use_regex", True) or any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"no plain byte-level BPE: {path}")
        vocabulary, symbols = model["vocab"], byte_symbols()
        self.kept, self.before = kept, {}
        self.first = [vocabulary[c] for c in symbols]
        self.width = max(vocabulary.values()) + 1
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.rank.setdefault(vocabulary[a] * self.width + vocabulary[b], r)
            self.made.append(vocabulary[a + b])
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocabulary.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if added else None
        order = sorted(self.rank)
        self.pairs, self.pair_ranks = np.array(order, np.int64), np.array([self.rank[p] for p in order], np.int64)
        self.first_ids, self.made_ids = np.array(self.first, np.int64), np.array(self.made, np.int64)
        self.pieces, self.split = regex.compile(PIECES).findall, Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

    def merged(self, data: bytes) -> list[int]:
        """The ids of one piece, which has a byte at least."""
        n, first, rank, width, made = len(data), self.first, self.rank.get, self.width, self.made
        ids = [first[b] for b in data]
        if n == 1:
            return ids
        # A leaf is its pair's rank and, below it, its place: the least leaf is the leftmost of the lowest rank.
        bits = (n - 2).bit_length()
        size, top = 1 << bits, _NONE << bits
        leaves = [rank(a * width + b, _NONE) << bits | i for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False))]
        levels = [leaves + [top] * (size - n + 1)]
        while len(levels[-1]) > 1:
            levels.append(list(map(min, levels[-1][::2], levels[-1][1::2])))
        tree = [top, *(x for level in reversed(levels) for x in level)]
        later, earlier = list(range(1, n + 1)), list(range(-1, n - 1))
        if n >= _LONG:
            ids, tree, later, earlier = array("i", ids), array("q", tree), array("i", later), array("i", earlier)
        while (least := tree[1]) < top:
            left = least & (size - 1)
            gone = later[left]
            after, before = later[gone], earlier[left]
            new = ids[left] = made[least >> bits]
            ids[gone], later[left], value = -1, after, top
            if after < n:
                earlier[after] = left
                value = rank(new * width + ids[after], _NONE) << bits | left
            changed = [(left, value)]
            if gone < n - 1 and tree[size + gone] < top:
                changed.append((gone, top))
            if before >= 0:
                value = rank(ids[before] * width + new, _NONE) << bits | before
                if value != tree[size + before]:
                    changed.append((before, value))
            for leaf, value in changed:
                i = size + leaf
                tree[i] = value
                while i > 1:
                    other = tree[i ^ 1]
                    if other < value:
                        value = other
                    i >>= 1
                    if tree[i] == value:
                        break
                    tree[i] = value
        return [i for i in ids if i >= 0]

    def merged_together(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many short pieces, as merged() has them: a tree for each, and a merge in every tree at a time."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids, ends = self.first_ids[np.frombuffer(b"".join(pieces), np.uint8)], np.cumsum(lengths)
        out: list[bytes] = [b""] * len(pieces)
        for bits in range(int(lengths.max(initial=1)).bit_length() + 1):
            size = 1 << bits
            rows = np.flatnonzero((lengths <= size + 1) & (lengths > (size >> 1) + 1 if bits else lengths > 0))
            if len(rows):
                n, column = lengths[rows], np.arange(size + 1)
                own = np.where(column < n[:, None], ids[np.minimum((ends[rows] - n)[:, None] + column, len(ids) - 1)], -1)
                self._merge_rows(own, n, bits)
                stays = own >= 0
                flat, stops = own[stays].astype("<u4").tobytes(), np.cumsum(4 * stays.sum(1)).tolist()
                for row, start, stop in zip(rows.tolist(), [0, *stops], stops, strict=False):
                    out[row] = flat[start:stop]
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        wanted = a * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where((self.pairs[at] == wanted) & (a >= 0) & (b >= 0), self.pair_ranks[at], _NONE)

    def _merge_rows(self, ids: np.ndarray, n: np.ndarray, bits: int) -> None:
        """Merges each row of ids, of n symbols and -1 after them, until it has no mergeable pair; merged-away places become -1."""
        size, top = 1 << bits, _NONE << bits
        tree = np.full((len(ids), 2 * size), top, np.int64)
        ranks = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, size:] = np.where(ranks < _NONE, ranks << bits | np.arange(size), top)
        for level in range(bits - 1, -1, -1):
            below = tree[:, 2 << level : 4 << level]
            tree[:, 1 << level : 2 << level] = np.minimum(below[:, ::2], below[:, 1::2])
        # Places beyond the last symbol are -1, as are places before the first.
        later = np.where(np.arange(1, size + 2) < n[:, None], np.arange(1, size + 2), -1)
        earlier = np.tile(np.arange(-1, size), (len(ids), 1))
        live = np.flatnonzero(tree[:, 1] < top)
        while len(live):
            least = tree[live, 1]
            left = least & (size - 1)
            gone = later[live, left]
            after, before = later[live, gone], earlier[live, left]
            new = self.made_ids[least >> bits]
            ids[live, left], ids[live, gone], later[live, left] = new, -1, after
            some = after >= 0
            earlier[live[some], after[some]] = left[some]
            right = self._ranks(new, np.where(some, ids[live, after], -1))
            value = self._ranks(np.where(before >= 0, ids[live, before], -1), new)
            leaf = np.concatenate([np.minimum(gone, size - 1), left, np.maximum(before, 0)])
            old = tree[live, size]
            put = np.concatenate([np.where(gone < size, top, tree[live, 2 * size - 1]), np.where(right < _NONE, right << bits | left, top), np.where(before < 0, old, np.where(value < _NONE, value << bits | before, top))])
            # Where there is no pair before, the first leaf is written as it is, and before the others.
            row, at, count = np.tile(live, 3), size + leaf, len(live)
            for part in (slice(2 * count, None), slice(0, count), slice(count, 2 * count)):
                tree[row[part], at[part]] = put[part]
            for _ in range(bits):
                at = at >> 1
                tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            live = live[tree[live, 1] < top]

    def __missing__(self, piece: str) -> bytes:
        return self.special.get(piece) or array("I", self.merged(piece.encode())).tobytes()

    def _learn(self, pieces: set[str]) -> None:
        """Puts the ids of pieces into the memory, the short ones."""
        if len(self) >= self.kept:
            # Pieces in use are taken over from the full generation as they are met again.
            self.before = dict(self)
            self.clear()
        new = [p for p in pieces if p not in self and len(p) <= KEPT_CHARS and p not in self.special]
        known = self.before
        self.update((p, known[p]) for p in new if p in known)
        new = [p for p in new if p not in known]
        if new:
            self.update(zip(new, self.merged_together([p.encode() for p in new]), strict=True))

    def _pieces(self, text: str) -> list[str]:
        if not OTHER_VERSIONS.search(text):
            return self.pieces(text)
        return [p for s in CUT.split(text) for p in ([s[a:b] for _, (a, b) in self.split(s)] if OTHER_VERSIONS.search(s) else self.pieces(s))]

    def _blocks(self, text: str) -> Iterator[list[str]]:
        """The pieces of a text, special tokens' strings among them, some at a time."""
        for k, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if k % 2:
                yield [part]
                continue
            start = 0
            while start < len(part):
                cut = CUT.search(part, start + _BLOCK)
                end = cut.start() if cut else len(part)
                yield self._pieces(part[start:end])
                start = end

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts as native unsigned 32-bit bytes; none for null."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0

        def done() -> None:
            self._learn({p for _, pieces in waiting for p in pieces})
            for k, pieces in waiting:
                out[k].append(b"".join(map(self.__getitem__, pieces)))
            waiting.clear()

        for k, text in enumerate(texts):
            for pieces in self._blocks(text or ""):
                waiting.append((k, pieces))
                held += len(pieces)
                if held >= _TOGETHER:
                    done()
                    held = 0
        done()
        return [b"".join(parts) for parts in out]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_coders: dict[str, ByteLevelBpe] = {}


def coder(path: str) -> ByteLevelBpe:
    """This worker's encoder and decoder."""
    if path not in _coders:
        _coders[path] = ByteLevelBpe(path)
    return _coders[path]


def _mapped(docs: DataFrame, id_col: str, of: str, kind: str, schema: str, columns) -> DataFrame:
    """docs' id and the columns, named in schema, that columns(values) gives for a batch of its column `of`."""
    names = ["id", *(c.split()[0] for c in schema.split(", "))]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(b.column(1).to_pylist())], names)

    of_id = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col], docs[of].cast(kind)).mapInArrow(run, f"id {of_id}, {schema}").withColumnRenamed("id", id_col)


def _id_columns(ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The id column, n_tokens and ids (unsigned 32-bit, little-endian) of every whole text, where it is read.

    Null and empty texts have no ids. Special tokens' strings in a text become the special
    ids, as the library has it by default; none are added. Repeated rows are encoded each
    for itself, a null id stays null, other columns are not read, and an empty table gives
    no rows. A worker holds a batch of bounded bytes, or one longer text, and its ids.
    """
    path = tokenizer or default_tokenizer()
    return _mapped(docs, id_col, text_col, "string", "n_tokens bigint, ids binary", lambda texts: _id_columns(coder(path).encode_all(texts)))


def decoded(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The id column and text of ids as encoded() has them; empty for null. An id that the vocabulary lacks is an error."""
    path = tokenizer or default_tokenizer()
    return _mapped(tokens, id_col, ids_col, "binary", "text string", lambda all_ids: [pa.array([coder(path).decode(x or b"") for x in all_ids], pa.string())])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """encoded() and, beside the ids, the text that they decode to, in one pass over docs."""
    path = tokenizer or default_tokenizer()

    def columns(texts):
        ids = coder(path).encode_all(texts)
        return [*_id_columns(ids), pa.array([coder(path).decode(x) for x in ids], pa.string())]

    return _mapped(docs, id_col, text_col, "string", "n_tokens bigint, ids binary, decoded string", columns)


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """round_trip()'s rows with SHA-256 sums in place of ids and text."""
    return tokens.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
