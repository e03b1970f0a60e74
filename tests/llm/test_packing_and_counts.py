import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import documents, frame
from hypothesis import given, settings
from hypothesis import strategies as st

from postlake.llm import encoding, packing, token_counts


@pytest.fixture(scope="module")
def coder():
    return encoding.Encoder(encoding.default_tokenizer(), kept=500)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(list("abcdefghtion ABÀéß0'.,!-\n\t#$<|>")) , max_size=60) | st.text(max_size=40))
def test_ids_are_the_library_s(text):
    coder = encoding.encoder(encoding.default_tokenizer())
    assert coder.encode(text) == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_strings_and_full_memory(coder):
    for t in ["a <|endoftext|> b", "it's we'll <|startoftext|>", "x" * 500, " ".join(str(i) + "word" for i in range(2000))]:
        assert coder.encode(t) == np.array(coder.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(coder) <= 501 and coder.encode(None) == b""


@pytest.mark.parametrize("n", [1, 2, 3, 4095, 4096, 4097, 10_000])
def test_piece_lengths(n):
    k = packing.piece_lengths(n)
    assert sum(k) == n and all(x & (x - 1) == 0 and x <= 4096 for x in k) and k == sorted(k, reverse=True)


def test_round_trip(spark, coder, tmp_path):
    pieces = packing.pack_documents(frame(spark))
    rows = pieces.collect()
    by = defaultdict(list)
    for r in rows:
        assert r.length == 2**r.bucket and r.offset == 0
        by[r.doc_id].append(r)
    wanted = defaultdict(list)
    for d in documents():
        wanted[d[0]].append(coder.encode(d[1]) + np.array([2], "<u4").tobytes())
    assert len({r.sequence_id for r in rows}) == len(rows)
    for d, whole in wanted.items():
        got = sorted(by[d], key=lambda r: (r.sequence_id >> 33, r.sequence_id))
        assert b"".join(bytes(r.ids) for r in got) == b"".join(whole)
        assert {r.doc_tokens for r in got} == {len(w) // 4 for w in whole}
    digest = {(r.doc_id, r.start): r.ids_crc32 for r in packing.piece_digests(pieces).collect()}
    assert all(digest[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) for r in rows)
    packing.write_buckets(pieces.where("length <= 8"), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {f"bucket={r.bucket}" for r in rows if r.length <= 8}
    assert packing.pack_documents(frame(spark).limit(0)).count() == 0


def test_counts(spark, coder, monkeypatch):
    monkeypatch.setattr(token_counts, "BLOCK", 64)
    lengths = [len(coder.encode(d[1])) // 4 for d in documents()]
    sums = token_counts.token_counts(frame(spark))
    got = {r.length: r for r in sums.collect()}
    assert set(got) == set(lengths) and {k: r.n_docs for k, r in got.items()} == Counter(lengths)
    for k, r in got.items():
        assert (r.docs_at_least, r.tokens_at_least, r.truncated_total, r.docs_at_most, r.total_tokens) == (sum(x >= k for x in lengths), sum(x for x in lengths if x >= k), sum(min(x, k) for x in lengths), sum(x <= k for x in lengths), sum(lengths))
    cuts = {r.context_limit: r.truncated_total for r in token_counts.truncated_totals(sums, [0, 1, 77, 10**7]).collect()}
    assert cuts == {k: sum(min(x, k) for x in lengths) for k in (0, 1, 77, 10**7)}
    q = {r.share: r.length for r in token_counts.length_quantiles(sums, [0.0, 0.5, 1.0]).collect()}
    assert q[0.5] == sorted(lengths)[-(-len(lengths) // 2) - 1] and q[1.0] == max(lengths) and q[0.0] == min(lengths)
    assert token_counts.token_counts(frame(spark).limit(0)).count() == 0


def test_a_piece_is_met_in_one_case_and_ids_are_the_tokenizers():
    coder = encoding.Encoder(encoding.default_tokenizer())
    assert coder.encode("Word word WORD wOrd") == coder.encode("word word word word") and list(coder) == ["word"]
    letters = "".join(map(chr, range(0xA0, 0x180)))
    texts = [
        *letters, letters, " ".join(letters), "STRASSE Straße ÀÍÞŸÿ ÀÍÞÿ. Ça, ÑANDÚ! µ ª º × ÷ ¡Él! x²", "İ I ı ΣΑΣ ΟΔΟΣ. ÉCOLE", "DON'T WE'LL It's IT'S",
        "A <|STARTOFTEXT|> B <|startoftext|> C", "<|EndOfText|>", "ÉCOLE école", " A  \x85B\x1fC \tD\r\nE", "", " ", "NAÏVE " * 50,
    ]
    for t in texts:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == coder.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
