"""Alignment of two tokenizers over texts, a distinct segment at a time.

A text is cut before runs of white space that begin with a character which, by both
vocabularies, no token has after anything but white space: there no merge can cross, and
both tokenizers give a segment the same tokens alone as within its text. Segments recur, so
each distinct one of the corpus is tokenised and aligned once.

Texts become blocks: the segments that a block has, each once, and a sequence of their
numbers for every text. The blocks' segments, of which there are far fewer than occurrences,
meet sorted, so that equal ones are aligned once, and go back to their blocks with their
alignment in packed form. A block's texts are composed from these, first to count in how
many texts a pair is linked, then, with the corpus' counts of the block's pairs, for the
result. No key has more rows than there are blocks.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import default_tokenizer as default_a
from .common import SPACES, bounded, give_back, stored, tidy
from .encoding import byte_symbols

#: Bytes of text from which a block is full, and characters that are cut, or segments that are hashed, at a time.
BLOCK_BYTES, _AT_ONCE = 16 << 20, 1 << 20
#: What appended to a serialised model of the second kind turns its own leading space off (fixed value).
_NO_PREFIX = b"\x1a\x02\x18\x00"
_MARK = "▁"
#: Bytes of packed alignments that a task holds, and links of a group from which tokens are counted before they are paired.
_PACKED, _MANY = 16 << 20, 1 << 16
#: Segments whose alignments are read at a time, and what stands between their numbers.
_READ, _BLANKS = 1 << 15, bytes.maketrans(b",|;\n", b"    ")


def default_b() -> str:
    """The public piece vocabulary's place; a parameter, as default_a() is."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def safe_cuts(*vocabularies: Iterable[str]) -> str:
    """White space before which a text may be cut: no token has it after a character that is not white space."""
    inside = {c for tokens in vocabularies for t in tokens for c in re.findall(r"\S([\x20\x09-\x0D])", t)}
    return "".join(c for c in SPACES if c not in inside)


class Tokenizers:
    """Both tokenizers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = {c: b for b, c in enumerate(byte_symbols())}
        vocabulary = {i: t for t, i in self.a.get_vocab(with_added_tokens=False).items()}
        # An id without a token has no bytes, and what it is in is not given back whole.
        self.bytes_a = [bytes(byte_of[c] for c in vocabulary.get(i, "")) for i in range(self.a.get_vocab_size() + 1)]
        with open(path_b, "rb") as file:
            model = file.read()
        # The texts' leading space is put there before they are cut.
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model + _NO_PREFIX)
        shown = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(shown)]
        # A part of a character counts as one that is not white space.
        cuts = safe_cuts((t.decode("utf-8", "replace") for t in self.bytes_a), (p.replace(_MARK, " ") for p in shown))
        self.cut = re.compile(rf"(?<=\S)(?=[{re.escape(cuts)}])") if cuts else re.compile(r"(?!)")

    def segments(self, text: str) -> Iterator[list[str]]:
        """The segments of a text with its leading space, some at a time."""
        text, start = f" {text}", 0
        while start < len(text):
            found = self.cut.search(text, start + _AT_ONCE)
            end = found.start() if found else len(text)
            yield self.cut.split(text[start:end])
            start = end

    def aligned(self, segments: list[str]) -> Iterator[str]:
        """Each segment's groups as text; empty where a tokenizer does not give back its bytes."""
        bytes_a, bytes_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        for segment, first, b in zip(segments, self.a.encode_batch(segments, add_special_tokens=False), self.b.encode(segments), strict=True):
            a, whole = first.ids, segment.encode()
            parts_a, parts_b = list(map(bytes_a, a)), list(map(bytes_b, b))
            if b"".join(parts_a) == whole == b"".join(parts_b):
                yield _grouped(a, list(map(len, parts_a)), b, list(map(len, parts_b)))
            else:
                yield ""


def _grouped(a: list[int], sizes_a: list[int], b: list[int], sizes_b: list[int]) -> str:
    """The groups between places where tokens of both end: a1,a2|b1;a3|b2,b3."""
    groups = []
    j = from_a = from_b = at_a = at_b = 0
    for i, size in enumerate(sizes_a, 1):
        at_a += size
        while at_b < at_a:
            at_b += sizes_b[j]
            j += 1
        if at_a == at_b:
            groups.append(f"{','.join(map(str, a[from_a:i]))}|{','.join(map(str, b[from_b:j]))}")
            from_a, from_b = i, j
    return ";".join(groups)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    """This worker's tokenizers."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


class _Numbers(dict):
    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        return n


def _pack(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two kinds. Texts, some in a row: block, ids, sizes (segments of each), codes (the segments' numbers within the block, in order, packed). Segments: block, code, segment."""
    kind = docs.schema[id_col].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        both, block, held, numbers = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 33, 0, _Numbers()
        names = ["block", "ids", "sizes", "codes", "code", "segment"]

        def of_segments(of_ids):
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([block] * n, pa.int64()), pa.nulls(n, of_ids), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(list(numbers), pa.string())], names)

        of_ids = None
        for b in batches:
            of_ids, codes, sizes = pa.list_(b.schema.field(0).type), array("I"), []
            for text in b.column(1):
                before = len(codes)
                for some in both.segments(text.as_py()) if text.as_py() else ():
                    codes.extend(map(numbers.__getitem__, some))
                sizes.append(len(codes) - before)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), ids.cast(of_ids), pa.array([sizes], pa.list_(pa.int64())), pa.array([_pack(codes.tobytes())], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string())], names)
            held += b.nbytes
            if held >= BLOCK_BYTES:
                yield of_segments(of_ids)
                numbers.clear()
                block, held = block + 1, 0
        if numbers:
            yield of_segments(of_ids)

    return docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"block bigint, ids array<{kind}>, sizes array<bigint>, codes binary, code int, segment string")


def align_segments(words: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """block, codes, groups (both packed): the alignments of words(block, code, segment), which are sorted by segment within tasks.

    A run of equal segments is tokenised and aligned once.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, last, held = tokenizers(path_a, path_b), {}, 0
        waiting: dict[int, tuple[array, list[str]]] = {}

        def flush():
            codes, groups = [_pack(c.tobytes()) for c, _ in waiting.values()], [_pack("".join(g).encode()) for _, g in waiting.values()]
            out = pa.RecordBatch.from_arrays([pa.array(list(waiting), pa.int64()), pa.array(codes, pa.binary()), pa.array(groups, pa.binary())], ["block", "codes", "groups"])
            waiting.clear()
            return out

        for b in batches:
            segments = b.column(2).to_pylist()
            new = [s for s in dict.fromkeys(segments) if s not in last]
            known = last | dict(zip(new, both.aligned(new), strict=True))
            last = {segments[-1]: known[segments[-1]]} if segments else last
            for block, code, segment in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), segments, strict=True):
                if block not in waiting:
                    waiting[block] = array("I"), []
                codes, groups = waiting[block]
                codes.append(code)
                groups.append(known[segment] + "\n")
                held += len(groups[-1]) + 4
            if held >= _PACKED:
                yield flush()
                held = 0
        if waiting:
            yield flush()

    return words.mapInArrow(run, "block bigint, codes binary, groups binary")


class _Block:
    """A block's segments by their numbers: which are aligned, their groups, and their links."""

    def __init__(self, packed: pa.Table):
        codes, lines = [], []
        for c, g in zip(packed["codes"], packed["groups"], strict=True):
            codes.append(np.frombuffer(_unpack(c.as_py()), "<u4"))
            lines += _unpack(g.as_py()).split(b"\n")[:-1]
        order = np.argsort(np.concatenate(codes), kind="stable") if codes else np.zeros(0, np.int64)
        self.groups = [lines[i] for i in order.tolist()]
        self.n = len(self.groups)
        self.ok = np.fromiter(map(bool, self.groups), bool, self.n)
        self.sums = {name: np.zeros(self.n, np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        links: list[tuple] = [(np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start in range(0, self.n, _READ):
            links += self._read(start, self.groups[start : start + _READ])
        #: Links: their segment, pair and how often; in no order.
        self.segment, self.pair, self.times = (np.concatenate(x) for x in zip(*links, strict=True))

    def _read(self, first: int, lines: list[bytes]) -> Iterator[tuple]:
        """Numbers and what follows each: , another of its side, | B's side, ; the next group, a line end the next segment."""
        aligned = np.flatnonzero(self.ok[first : first + len(lines)])
        if not len(aligned):
            return
        text = b"\n".join(filter(None, lines)) + b"\n"
        signs = np.frombuffer(text, np.uint8)
        signs = signs[(signs < ord("0")) | (signs > ord("9"))]
        ids = np.fromstring(text.translate(_BLANKS), np.int64, sep=" ")
        ends_group = (signs == ord(";")) | (signs == ord("\n"))
        group = np.cumsum(ends_group) - ends_group
        n_groups = int(group[-1]) + 1
        # A number is B's if its group's bar came before it.
        of_b = np.cumsum(signs == ord("|")) - (signs == ord("|")) > group
        segment = (first + aligned[(np.cumsum(signs == ord("\n")) - (signs == ord("\n")))[ends_group]]).astype(np.int32)
        n_a, n_b = np.bincount(group[~of_b], minlength=n_groups), np.bincount(group[of_b], minlength=n_groups)
        start, links = np.cumsum(n_a + n_b) - (n_a + n_b), n_a * n_b
        for name, x in (("n_a", n_a), ("n_b", n_b), ("n_groups", np.ones(n_groups, np.int64)), ("n_links", links)):
            np.add.at(self.sums[name], segment, x)
        few = links <= _MANY
        n, at_a, at_b = links[few], start[few], (start + n_a)[few]
        k, width = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), np.repeat(n_b[few], n)
        yield np.repeat(segment[few], n), ids[np.repeat(at_a, n) + k // width] << 32 | ids[np.repeat(at_b, n) + k % width], np.ones(len(k), np.int64)
        for g in np.flatnonzero(~few):
            x, k = np.unique(ids[start[g] : start[g] + n_a[g]], return_counts=True)
            y, m = np.unique(ids[start[g] + n_a[g] : start[g] + n_a[g] + n_b[g]], return_counts=True)
            pairs = (x[:, None] << 32 | y).ravel()
            yield np.full(len(pairs), segment[g], np.int32), pairs, (k[:, None] * m).ravel()

    def texts(self, texts: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
        """Each text's id and the numbers of its segments; none if one of them is not aligned."""
        for ids, sizes, codes in zip(texts["ids"] if "ids" in texts.column_names else texts["sizes"], texts["sizes"], texts["codes"], strict=True):
            own, at = np.frombuffer(_unpack(codes.as_py()), "<u4"), 0
            for i, n in zip(ids.as_py(), sizes.as_py(), strict=True):
                some = own[at : at + n]
                at += n
                yield i, some if n and self.ok[some].all() else some[:0]


def _pairs_of_block(texts: pa.Table, packed: pa.Table) -> pa.Table:
    """Each linked pair of a block with the number of its texts that link it."""
    block = _Block(packed)
    known, pair = np.unique(block.pair, return_inverse=True)
    # Each pair of a segment once, in the order of segments.
    once = np.unique(block.segment.astype(np.int64) * max(1, len(known)) + pair)
    segment, pair = np.divmod(once, max(1, len(known)))
    sizes = np.bincount(segment, minlength=block.n)
    starts, total, waiting, held = np.cumsum(sizes) - sizes, np.zeros(len(known), np.int64), [], 0
    for _, codes in block.texts(texts):
        if not len(codes):
            continue
        own = np.unique(codes)
        n = sizes[own]
        ends = np.cumsum(n)
        waiting.append(np.unique(pair[np.repeat(starts[own] - (ends - n), n) + np.arange(ends[-1])]))
        held += len(waiting[-1])
        if held >= _AT_ONCE:
            total += np.bincount(np.concatenate(waiting), minlength=len(known))
            waiting, held = [], 0
    if waiting:
        total += np.bincount(np.concatenate(waiting), minlength=len(known))
    met = np.flatnonzero(total)
    out = pa.table({"block": pa.array(np.full(len(met), packed["in_block"][0].as_py() if len(packed) else 0), pa.int64()), "pair": pa.array(known[met], pa.int64()), "n": pa.array(total[met], pa.int64())})
    give_back()
    return out


#: What a text's row sums over its segments.
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def _texts_of_block(texts: pa.Table, rows: pa.Table) -> pa.Table:
    """A row for each text of a block, composed from its segments' alignments and its pairs' counts."""
    kind = texts.schema.field("ids").type.value_type
    counts = rows.filter(rows["pair"].is_valid())
    block = _Block(rows.filter(rows["pair"].is_null()))
    pair = counts["pair"].to_numpy()
    order = np.argsort(pair)
    # A link that no whole text has is without a count, and in no text's sum.
    pair = np.append(pair[order], -1)
    at = np.searchsorted(pair[:-1], block.pair)
    there = pair[at] == block.pair
    for name, values in (("n_best", counts["top"].to_numpy(zero_copy_only=False)), ("count_sum", counts["n"].to_numpy())):
        value = np.append(values.astype(np.int64)[order], 0)[at] * there * block.times
        block.sums[name] = np.zeros(block.n, np.int64)
        np.add.at(block.sums[name], block.segment, value)
    numbers = np.array([block.sums[c] for c in SUMS]).reshape(len(SUMS), block.n)
    ids, sums, digests = [], [], []
    for i, own in block.texts(texts):
        ids.append(i)
        total, digest = np.zeros(len(SUMS), np.int64), hashlib.sha256()
        for start in range(0, len(own), _AT_ONCE):
            some = own[start : start + _AT_ONCE]
            total += numbers[:, some].sum(1)
            digest.update(b";" * (start > 0) + b";".join(map(block.groups.__getitem__, some.tolist())))
        sums.append(total)
        digests.append(digest.hexdigest() if len(own) else "")
    columns = np.array(sums, np.int64).reshape(-1, len(SUMS)).T
    out = pa.table({"id": pa.array(ids, kind), **{c: pa.array(x, pa.int64()) for c, x in zip(SUMS, columns, strict=True)}, "groups_sha256": pa.array(digests, pa.string())})
    give_back()
    return out


def _cogrouped(texts: DataFrame, rows: DataFrame, of_block, schema: str) -> DataFrame:
    return texts.groupBy("block").cogroup(rows.groupBy("in_block")).applyInArrow(of_block, schema)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """For each row of docs its id and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts are encoded with a leading space and without special tokens, whose strings are
    plain text. Groups lie between byte offsets where tokens of both end. All pairs of
    tokens within a group are links; a pair's count is the number of rows that link it;
    n_best are links whose count is the highest of their A id, count_sum sums the counts.
    Null and empty texts, and those that either tokenizer does not give back whole, have
    no tokens: zeros, and an empty checksum. Repeated rows count each for itself, null ids
    stay, other columns are not read, and an empty table gives no rows.

    A task holds a block, which is BLOCK_BYTES of texts or one longer text, with the
    alignments of its distinct segments.
    """
    bounded(docs.sparkSession)
    path_a, path_b = path_a or default_a(), path_b or default_b()
    parts = stored(blocks(docs, path_a, path_b, id_col, text_col))
    texts, words = parts.where("segment is null").select("block", "ids", "sizes", "codes"), parts.where("segment is not null").select("block", "code", "segment")
    packed = stored(align_segments(words.repartition("segment").sortWithinPartitions("segment"), path_a, path_b)).select(F.col("block").alias("in_block"), "codes", "groups")

    of_blocks = stored(_cogrouped(texts.drop("ids"), packed, _pairs_of_block, "block bigint, pair bigint, n bigint"))
    counts = of_blocks.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = stored(counts)
    # One row for each id of the first vocabulary at most.
    best = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(F.broadcast(best), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("top"))
    pairs = of_blocks.select(F.col("block").alias("in_block"), "pair").join(counts, "pair")

    empty = lambda kind: F.lit(None).cast(kind)
    rows = packed.select("in_block", "codes", "groups", empty("bigint").alias("pair"), empty("bigint").alias("n"), empty("boolean").alias("top"))
    rows = rows.unionByName(pairs.select("in_block", empty("binary").alias("codes"), empty("binary").alias("groups"), "pair", "n", "top"))
    of_id = docs.schema[id_col].dataType.simpleString()
    return _cogrouped(texts, rows, _texts_of_block, f"id {of_id}, {', '.join(f'{c} bigint' for c in SUMS)}, groups_sha256 string").withColumnRenamed("id", id_col)
