"""Token ids of whole texts, a word at a time.

The default tokenizer drops white space and lower-cases before it merges, so the ids of a
text are those of its space- and newline-separated pieces in order. Pieces recur; each
worker keeps the ids of a bounded number of them, and starts that memory anew when it is
full, taking over what is met again. Texts of Latin-1 characters, whose lower case is
the same character by character everywhere, are lower-cased first, so that a piece is met
in one case only. A word of Latin letters goes straight to the tokenizer's model, any
other piece through the whole tokenizer. A tokenizer of another build encodes whole texts.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np

#: Pieces kept by a worker in each of two generations, and the longest that is kept.
KEPT, KEPT_CHARS = 1 << 18, 48
#: What a tokenizer must be made of for its texts to be encoded a piece at a time (fixed values).
_STEPS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_tokenizer() -> str:
    """The public word-level vocabulary's place; a parameter of every operator that encodes."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder(dict):
    """Maps pieces of text to their ids as native unsigned 32-bit bytes."""

    def __init__(self, path: str, kept: int = KEPT):
        from tokenizers import Tokenizer

        super().__init__()
        self.before: dict[str, bytes] = {}
        self.tokenizer, self.kept = Tokenizer.from_file(path), kept
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_piece = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges")
            and [s["type"] for s in steps] == _STEPS and len(parts) == 2
            and parts[0].get("pattern") == {"Regex": _SPLIT} and parts[1]["type"] == "ByteLevel"
        )
        if self.by_piece:
            # Bytes of lower-cased Latin letters are their own symbols, but for these.
            symbols, letters = byte_symbols(), {b for c in range(0xC0, 0x100) for b in chr(c).lower().encode()}
            self.spelled = [(chr(b), symbols[b]) for b in sorted(letters) if symbols[b] != chr(b)]
            # Special tokens are found in texts as they are written.
            self.named = [a["content"].lower() for a in spec.get("added_tokens") or []]
            self.merge = self.tokenizer.model.tokenize
            self.plain = re.compile(r"([a-zA-ZÀ-ÖØ-öø-ÿ]+)([.,;:!?#$%&*|()\-]*)").fullmatch

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = self._encoded(piece)
        if len(piece) <= KEPT_CHARS:
            if len(self) >= self.kept:
                # Pieces in use are taken over from the full generation as they are met again.
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids

    def _encoded(self, piece: str) -> bytes:
        found = self.plain(piece) if len(piece) <= KEPT_CHARS else None
        if not found:
            return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if found[2]:
            return self[found[1]] + self[found[2]]
        # Letters alone need no normalising or splitting: the model merges their byte symbols.
        letters = piece.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1")
            for byte, symbol in self.spelled:
                letters = letters.replace(byte, symbol)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _lowered(self, text: str) -> str:
        """The text in lower case, or as it is where that might give other ids."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(name in low for name in self.named) else low

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit bytes; none for null."""
        if not text:
            return b""
        if not self.by_piece:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self._lowered(text).replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
