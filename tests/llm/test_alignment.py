import bisect
import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from postlake.llm import alignment as A
from postlake.llm.encoding import byte_symbols

from corpus import frame

ODD = ["a\r\n b\r c", "x▁y z", " lead", "trail  ", "\n\n\tfoo", "<|endoftext|> <s> </s> <0x0A>", "漢字 😀 naïve  ǘ́", "\x00 \x1c a", "ﬁ　x\xa0 y", ");\r\n foo", None, "", " ", "\n", "x" * 5000, "don't stop's 123 456", "a \xa0 \xa0 b"]


def whole(text):
    """Groups of a whole text by both libraries, or None."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    byte_of = {c: i for i, c in enumerate(byte_symbols())}

    def of(text):
        if not text:
            return None
        data = f" {text}".encode()
        a, b = first.encode(f" {text}", add_special_tokens=False), second.encode(text)
        parts_a = [bytes(byte_of[c] for c in t) for t in a.tokens]
        parts_b = [bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(parts_a) != data or b"".join(parts_b) != data:
            return None
        ends_a, ends_b = ([sum(map(len, p[: i + 1])) for i in range(len(p))] if len(p) < 500 else _ends(p) for p in (parts_a, parts_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups = defaultdict(lambda: ([], []))
        for side, found, ends in ((0, a.ids, ends_a), (1, b, ends_b)):
            for i, e in zip(found, ends, strict=True):
                groups[bisect.bisect_left(both, e)][side].append(i)
        return [groups[i] for i in range(len(both))]

    def _ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    return of(text)


def plain(rows):
    groups = {t: whole(t) for t in {t for _, t in rows}}
    links = {t: [(x, y) for a, b in g for x in a for y in b] if g else [] for t, g in groups.items()}
    counts = Counter(p for _, t in rows for p in set(links[t]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, t in rows:
        g = groups[t]
        if g is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g)
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links[t]), sum(counts[p] == best[p[0]] for p in links[t]), sum(counts[p] for p in links[t]), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(docs):
    out = A.align(docs)
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(map(tuple, out.collect()), key=str)


@pytest.mark.parametrize("block, many", [(A.BLOCK_BYTES, A._MANY), (1, 0)])
def test_odd_texts(spark, monkeypatch, block, many):
    rows = [*enumerate(ODD), (None, "a b"), (3, "trail  "), (40, "a b a b")]
    monkeypatch.setattr(A, "_MANY", many)
    monkeypatch.setattr(A, "BLOCK_BYTES", block)
    assert got(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)) == plain(rows)


def test_documents(spark):
    docs = frame(spark).where("doc_id is null or doc_id not in (2003, 2005)")
    assert got(docs) == plain([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_no_texts(spark):
    docs = frame(spark)
    assert got(docs.limit(0)) == []
    assert got(docs.where("doc_id in (2000, 2001)")) == plain([(2000, None), (2001, "")])


def test_long_texts_and_links_are_counted(spark, monkeypatch):
    monkeypatch.setattr(A, "_AT_ONCE", 50)
    rows = [(1, "one two  three\n" * 40), (2, "x" * 3000 + " end"), (3, "one two")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_where_texts_are_cut():
    assert A.safe_cuts(["a b", "\n\n x"], ["c", "\td"]) == "\t\n\x0b\x0c\r"
    both = A.tokenizers(A.default_a(), A.default_b())
    assert [s for some in both.segments("a  b\n\nc\r d") for s in some] == [" a", "  b", "\n\nc\r d"]
    with_cr = [both.b.id_to_piece(i) for i in range(both.b.get_piece_size()) if ";\r" in both.b.id_to_piece(i)]
    assert with_cr  # why there is no cut before a carriage return
    assert list(both.aligned([" ▁x", " a"]))[0] == ""


def test_equal_segments_are_aligned_once(spark, monkeypatch):
    seen = []
    aligned = A.Tokenizers.aligned
    monkeypatch.setattr(A.Tokenizers, "aligned", lambda self, segments: seen.extend(segments) or aligned(self, segments))
    import pyarrow as pa

    class Frame:
        def mapInArrow(self, run, schema):
            batches = [pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(s)], ["block", "code", "segment"]) for b, c, s in (([0, 1], [0, 0], [" a", " a"]), ([2, 0], [0, 1], [" a", " b"]))]
            return list(run(iter(batches)))

    out = A.align_segments(Frame(), A.default_a(), A.default_b())
    assert seen == [" a", " b"] and sum(b.num_rows for b in out) == 3
