"""Token ids of whole texts by a public tokenizer, with a bounded cache of the pieces met lately.

Both tokenizer files used here pre-split a text by a pattern and spell each piece by itself, so a text's
ids are those of its pieces in a row. Text in Latin letters is split by that pattern written out for
them; any other text is cut at its spaces, chunk by chunk, and a chunk outside Latin script goes
through the tokenizer whole, as does a text whose spaces stand beside other white space or that holds a
special token. Pieces are spelled by the tokenizer's own model; the cache never decides a result.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import regex

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: How the two files pre-split text, as their own "pre_tokenizer" entries say.
SPACED_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
DROPPED_SPACE_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

LATIN_END = "ɐ"
#: Classes of the characters below LATIN_END and of the common punctuation beyond, which is neither.
LETTERS, NUMBERS, SPACES = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", "\\t-\\r \\x85\\xa0"
NOT_LATIN = re.compile("[^\\0-ɏ‐-‧‰-⁞€™]").search
SPACED_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
DROPPED_SPACE_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+").findall
SPACE_FIRST, SPACE_LAST, ENDS_IN_SPACE = (regex.compile(p).search for p in (r"\A\s", r"\s\Z", r"\A\s|\s\Z"))
#: Bytes of a cache entry besides its characters and ids, about.
ENTRY = 190


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow
    from U+0100 on in byte order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Recent(dict):
    """What ``make`` gave for the keys met lately: two generations of about ``room`` bytes each. When
    the newer is full it becomes the older one, whose values move up when they are met again."""

    def __init__(self, make: Callable[[str], bytes], room: int):
        super().__init__()
        self.make, self.room = make, room
        self.held, self.older = 0, {}

    def __missing__(self, key: str) -> bytes:
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        cost = ENTRY + len(key) + len(got)
        if cost > self.room >> 6:
            return got
        if self.held + cost > self.room:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = got
        self.held += cost
        return got


class TokenIds:
    """Ids of texts as little-endian unsigned 32-bit integers. ``room``: bytes for the pieces of each of
    their two generations."""

    def __init__(self, path: str, room: int = 96 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.spaced = self.tokenizer.normalizer is None
        self.lead = " " if self.spaced else ""
        self.split, self.latin = (SPACED_PIECES.findall, SPACED_LATIN) if self.spaced else (DROPPED_SPACE_PIECES.findall, DROPPED_SPACE_LATIN)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, special)) or "(?!)").search
        self.pieces = Recent(self._piece, room)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            spelled = piece.replace(" ", self.letters[32])
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special(text):
            return self.whole(text)
        plain = text if self.spaced else text.lower()
        if NOT_LATIN(plain):
            return self._by_chunk(text)
        return b"".join(map(self.pieces.__getitem__, self.latin(plain)))

    def _by_chunk(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not self.spaced:
            return b"".join(self._chunk(x, "") for x in (first, *rest))
        if not rest:
            return self._chunk(first, "")
        # The text's own ends have no space beyond them.
        last = rest.pop()
        if not last or SPACE_LAST(first) or SPACE_FIRST(last) or not all(rest) or any(map(ENDS_IN_SPACE, rest)):
            return self.whole(text)
        return self._chunk(first, "") + b"".join(self._chunk(x, " ") for x in (*rest, last))

    def _chunk(self, chunk: str, lead: str) -> bytes:
        """Ids of one chunk behind ``lead`` (a space or nothing)."""
        if max(chunk, default="") >= LATIN_END:
            return self.whole(lead + chunk)
        if not self.spaced:
            chunk = unicodedata.normalize("NFC", chunk).lower()
        return b"".join(map(self.pieces.__getitem__, self.split(lead + chunk)))


_LOADED: dict[str, TokenIds] = {}


def load(path: str) -> TokenIds:
    """One cache for each worker process and tokenizer file."""
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]
