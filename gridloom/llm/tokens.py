"""Token ids of whole texts by the ``tokenizers`` library.

The tokenizers used here split a text into pieces (a word with its leading space, a run of
digits, of signs or of white space) and encode each piece on its own. So each worker encodes a
piece once and keeps its ids, packed as little-endian unsigned 32-bit integers, in a bounded
cache; a text is then the joined bytes of its pieces. A text for which the split could differ
from the library's (rare white space, text not in composed form, the vocabulary's own special
strings) goes to the library whole.

Where pieces keep their leading space, a single space always begins a piece, so what stands
between two single spaces (a word with its signs) is kept as one entry of a second cache and the
text is cut by ``str.split``. A text with white space beside a space is cut by the pattern.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from array import array

CACHE_PIECES, CACHE_WORDS = 600_000, 1_000_000

_LETTERS, _DIGITS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾"
# The public split patterns of the two tokenizers, with the character classes left open.
_SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^\s{L}{N}]+|\s+(?!\S)|\s+"
_FOLDED = r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[{L}]+|[{N}]|[^\s{L}{N}]+"
# Rare white space, and the start of the vocabulary's own strings. U+0130 is the one sign whose lower case has two signs; the second belongs to what follows.
_ODD_SIGNS = ["<|", *map(chr, (0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x130))]


def _byte_spelling() -> dict[int, str]:
    """The public byte-level spelling: printable Latin-1 signs stand for themselves, other bytes for the signs from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or (161 <= b and b != 173)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(rest)}


def _little(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


class _BesideBlank(Exception):
    """White space beside a space: the text has to be cut as a whole."""


class _Words(dict):
    """What stands between two spaces and the packed ids of it and the space before."""

    def __init__(self, pieces: Encoder):
        super().__init__()
        self.of = pieces

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _BesideBlank
        if word.isalpha():  # one piece, kept here only
            packed = self.of.packed(" " + word)
        else:
            packed = b"".join([self[p[1:]] if p[0] == " " and p[1:].isalpha() else self.of[p] for p in self.of.pieces(" " + word)])
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = packed
        return packed


class Encoder(dict):
    """Pieces and their packed ids; a missing piece is encoded by the library."""

    def __init__(self, path: str):
        super().__init__()
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.folds = self.tokenizer.normalizer is not None
        spelling = _byte_spelling()
        self.spelling = [spelling.get(b, chr(b)) for b in range(256)]
        self.model = self.tokenizer.model
        pattern = _FOLDED if self.folds else _SPACED
        self.latin = re.compile(pattern.replace("{L}", _LETTERS).replace("{N}", _DIGITS))
        self.any = regex.compile(pattern.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}"))
        self.words = _Words(self)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def packed(self, piece: str) -> bytes:
        """Ids of one piece, not kept."""
        try:
            # The library's model takes a piece as it stands after its own folding and byte spelling.
            if piece.isascii() and piece.isprintable():  # stands for itself, but for the space
                spelled = (piece.lower() if self.folds else piece).replace(" ", self.spelling[32])
            else:
                piece.encode("latin-1")
                spelled = "".join(map(self.spelling.__getitem__, (piece.lower() if self.folds else piece).encode()))
            return _little([t.id for t in self.model.tokenize(spelled)])
        except UnicodeEncodeError:
            return self.whole(piece)

    def __missing__(self, piece: str) -> bytes:
        packed = self.packed(piece)
        if len(self) >= CACHE_PIECES:
            self.clear()
        self[piece] = packed
        return packed

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin.findall(text)
        try:
            text.encode("latin-1")
            return self.latin.findall(text)
        except UnicodeEncodeError:
            return self.any.findall(text)

    def pack(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if any(sign in text for sign in _ODD_SIGNS) or not unicodedata.is_normalized("NFC", text):
            return self.whole(text)
        if not self.folds:
            first, *rest = text.split(" ")
            if not first[-1:].isspace():
                try:
                    return b"".join(map(self.__getitem__, self.pieces(first))) + b"".join(map(self.words.__getitem__, rest))
                except _BesideBlank:
                    pass
        return b"".join(map(self.__getitem__, self.pieces(text)))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
