"""Exact, cached encoding with a tokenizers model.

A text of plain characters (ASCII and the letters of Western Europe) is cut to pre-tokens by a regular expression
and each is looked up in a dictionary of bounded size, so that a worker asks the model once for a word. Other
texts are cut at single spaces and line feeds between two non-space characters, where no pre-token crosses, and
the pieces that hold other characters go through the library. A text that holds the string of a special token
is the library's whole.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np

_LETTER = "A-Za-zÀ-ÖØ-öø-ÿŒœ"
#: A character that the patterns below may judge differently from the library.
_ODD = re.compile(rf"[^\t\n\r -~{_LETTER}]").search
#: Pre-tokens of plain characters: of models that keep a word's leading space, and of models that drop white space.
_SPACED = re.compile(rf" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s{_LETTER}0-9]+|\s+(?!\S)|\s+").findall
_BARE = re.compile(rf"[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTER}0-9]+").findall
_LINE = re.compile(r"(?<=\S)\n(?=\S)")
_GAP = re.compile(r"(?<=\S) (?=\S)")


#: Words that an encoder keeps in either generation.
WORDS = 400_000


class _Cache(dict):
    """Piece -> little-endian ids. At ``size`` entries the older generation is dropped; long pieces are not kept."""

    def __init__(self, make, size: int, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, piece):
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = got
        return got


class Encoder:
    """``encode(text)`` gives the ids of ``Tokenizer.encode(text, add_special_tokens=False)``.

    Fits byte-level models (with or without a normaliser) whose pre-tokens never span a white-space character
    followed by a non-space character except as its leading space. ``cache`` bounds either generation of words, each of
    some 200 bytes.
    """

    def __init__(self, path: str, cache: int = WORDS):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.wide = self.t.get_vocab_size() > 65_536
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.code = "I" if self.wide else "H"
        self.special = [a.content for a in self.t.get_added_tokens_decoder().values()]
        self.drops_space = not len(self._plain("a b")) > 2 * self.dtype.itemsize and self._plain("a b") == self._plain("a\nb")
        self.newline = b"" if self.drops_space else self._plain("\n")
        self.alphabet = {c: "".join(p for p, _ in self.t.pre_tokenizer.pre_tokenize_str(chr(c))) for c in [*range(256), *map(ord, "Œœ")]}
        self.blank = self.alphabet[32]
        self.words, self.odd = _Cache(self._word, cache), _Cache(self._text, cache // 4)
        self.cut = (lambda text: _BARE(text.lower())) if self.drops_space else _SPACED

    def _plain(self, text: str) -> bytes:
        return array(self.code, self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, token: str) -> bytes:
        """Ids of one pre-token of plain characters, which only needs the model's alphabet of bytes."""
        same = token.isascii() and token.isprintable()  # but for the blank
        return array(self.code, [x.id for x in self.t.model.tokenize(token.replace(" ", self.blank) if same else token.translate(self.alphabet))]).tobytes()

    def _text(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        if self.t.normalizer is not None:
            text = self.t.normalizer.normalize_str(text)
        return array(self.code, [x.id for p, _ in self.t.pre_tokenizer.pre_tokenize_str(text) for x in self.t.model.tokenize(p)]).tobytes()

    def _piece(self, piece: str, lead: str) -> bytes:
        return self.odd[lead + piece] if _ODD(piece) else b"".join(map(self.words.__getitem__, self.cut(lead + piece)))

    def _line(self, line: str) -> bytes:
        if not _ODD(line):
            return b"".join(map(self.words.__getitem__, self.cut(line)))
        first, *rest = _GAP.split(line)
        return b"".join([self._piece(first, ""), *(self._piece(x, " ") for x in rest)])

    def encode(self, text: str | None) -> bytes:
        """The ids as packed little-endian integers of ``dtype``."""
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._plain(text)
        if not _ODD(text):
            return b"".join(map(self.words.__getitem__, self.cut(text)))
        return self.newline.join([self._line(x) for x in _LINE.split(text)])


_encoders: dict[str, Encoder] = {}


def encoder(path: str, words: int = WORDS) -> Encoder:
    """One per worker process: another vocabulary or size takes the place of the last."""
    if path not in _encoders or _encoders[path].words.size != words:
        _encoders.clear()
        _encoders[path] = Encoder(path, words)
    return _encoders[path]


def crc_of(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
