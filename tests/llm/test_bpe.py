import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer

from postlake.llm import bpe

from corpus import frame

POOL = ["a", "b", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|endof", "é", "ß", "1", "23", "٣", "漢字", "😀", "'s", "'ll", "!", "...", "hello", " world", "՘", "　", "▁", "\x00", "ﬁ", "Ⅷ", "\U00010940", "'"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


def ids(data):
    return list(array("I", data))


def test_any_text_as_the_library_has_it(library):
    r, own = random.Random(1), bpe.ByteLevelBpe(bpe.default_tokenizer())
    texts = ["".join(r.choice(POOL) for _ in range(r.randint(0, 30))) for _ in range(4000)] + ["x" * 50_000, "", None, "".join(r.choice("abcdefg ") for _ in range(50_000))]
    for text, got in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids(got) == want
        assert own.decode(got) == library.decode(want, skip_special_tokens=False)


def test_one_tree_and_many_give_the_same():
    r, own = random.Random(2), bpe.ByteLevelBpe(bpe.default_tokenizer())
    pieces = ["".join(r.choice("abcdeé tionering") for _ in range(r.randint(1, 40))).encode() for _ in range(2000)] + [b"a", b"ab", b"\xff\xfe", b"the" * 30]
    assert [ids(x) for x in own.merged_together(pieces)] == [own.merged(p) for p in pieces]
    assert own.merged_together([]) == []


def test_lowest_rank_first_then_leftmost():
    own = bpe.ByteLevelBpe(bpe.default_tokenizer())
    # Plain merging, looking through all pairs each time.
    for piece in (b"aaaaaaa", b"internationalisation", " façade".encode(), b"hhehehe"):
        left = [own.first[b] for b in piece]
        while True:
            ranks = [(own.rank[a * own.width + b], i) for i, (a, b) in enumerate(zip(left, left[1:], strict=False)) if a * own.width + b in own.rank]
            if not ranks:
                break
            rank, i = min(ranks)
            left[i : i + 2] = [own.made[rank]]
        assert own.merged(piece) == left


def test_memory_is_bounded(library):
    own = bpe.ByteLevelBpe(bpe.default_tokenizer(), kept=50)
    for k in range(20):
        text = " ".join(f"word{k}x{i}" for i in range(40)) + " the same"
        assert ids(own.encode_all([text])[0]) == library.encode(text, add_special_tokens=False).ids
        assert len(own) <= 50 + 150


def test_blocks_of_a_long_text(monkeypatch, library):
    monkeypatch.setattr(bpe, "_BLOCK", 100)
    monkeypatch.setattr(bpe, "_TOGETHER", 10)
    r, own = random.Random(3), bpe.ByteLevelBpe(bpe.default_tokenizer())
    texts = ["".join(r.choice(POOL) for _ in range(400)) for _ in range(5)]
    assert [ids(x) for x in own.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_documents(spark, library):
    docs = frame(spark)
    rows = docs.select("doc_id", "text").collect()
    want = []
    for doc_id, text in rows:
        found = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(found, skip_special_tokens=False)
        want.append((doc_id, len(found), hashlib.sha256(array("I", found).tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    got = bpe.digests(bpe.round_trip(docs))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    tokens = bpe.encoded(docs)
    texts = {(r.doc_id, r.text) for r in bpe.decoded(tokens).collect()}
    assert texts == {(i, t or "") for i, t in rows}
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_another_kind_of_vocabulary_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        bpe.ByteLevelBpe(public_tokenizers.path("word_bpe_49k.json"))
