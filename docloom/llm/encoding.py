"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

Case: a lone surrogate, which no UTF-8 text holds, is an error of the library.

Both vocabularies split a text at white space before they merge, so that the ids of a text are those of its words (with the
space before them, where the vocabulary keeps it) in a row. Texts with white space other than the six ASCII
characters, or with the literal of a special token, are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

#: Bytes, about, of the words that a worker remembers, and of a remembered word beside its letters and ids. There are two
#: generations of half as much; a full one becomes the older one, from which words that come again are taken over.
CACHE_BYTES, WORD_BYTES = 160 << 20, 160

#: White space beyond the six ASCII characters, as Python or the vocabularies' patterns see it.
_ODD = tuple("\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_SPACED = re.compile(r" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+").findall
_MIXED = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c")
#: A word of Latin letters, with the space before it and one mark after it; the vocabularies split it there.
_SIMPLE = re.compile("( ?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)").fullmatch
_encoders: dict[str, Encoder] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next
    letter from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


class Known(dict):
    """Ids of words, made when a word is first met; `before` is put in front of each word."""

    def __init__(self, made, before: str, most: int, older: Known | None = None):
        self.made, self.before, self.most = made, before, most
        self.older, self.size = older, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) if self.older else None
        if ids is None:
            ids = self.made(self.before + word)
        self[word] = ids
        self.size += WORD_BYTES + len(word) + len(ids)
        return ids

    def next(self) -> Known:
        """This generation, or once it is full an empty one that takes over words which come again."""
        if self.size <= self.most // 2:
            return self
        self.older = None
        return Known(self.made, self.before, self.most, self)


class Encoder:
    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.spaced = said["pre_tokenizer"]["type"] == "ByteLevel"
        self.lower = "Lowercase" in json.dumps(said["normalizer"])
        self.letters = byte_letters()
        self.marks = {c: self._model(c) if c else b"" for c in ("", *".,;:!?")}
        self.special = [t["content"] for t in said["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size()
        self.cache_bytes = cache_bytes
        # words after a space are many, those that begin a line few
        small = cache_bytes // 4 if self.spaced else cache_bytes
        self.bare, self.after_space = Known(self._word, "", small), Known(self._word, " ", cache_bytes - small)
        self.line = self._word("\n") if self.spaced else b""

    def _model(self, word: str) -> bytes:
        """The merges alone, for a word that needs no further splitting."""
        return array("I", [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word of the split; simple ones go to the merges without the library's normaliser and splitter."""
        found = _SIMPLE(word)
        if not found:
            return self._ids([word])[0]
        space, core, mark = found.groups()
        if self.lower:
            core = core.lower()
        if not core.isascii():
            core = "".join([self.letters[b] for b in core.encode()])
        return self._model(self.letters[32] + core if space else core) + self.marks[mark]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _odd(self, text: str) -> bool:
        return any(c in text for c in (_ODD[:4] if text.isascii() else _ODD)) or any(s in text for s in self.special)

    def _text(self, text: str) -> bytes:
        self.bare, self.after_space = self.bare.next(), self.after_space.next()
        bare = self.bare.__getitem__
        if not self.spaced:
            return b"".join(map(bare, text.split()))
        if any(s in text for s in _MIXED):
            return b"".join(map(bare, _SPACED(text)))
        # one space or one line end between words
        after, lines = self.after_space.__getitem__, []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(bare(first) + b"".join(map(after, rest)))
        return self.line.join(lines)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text (none for null) as bytes: little-endian unsigned 32-bit integers."""
        return [b"" if not x else self._ids([x])[0] if self._odd(x) else self._text(x) for x in texts]


def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """The worker's own encoder; it outlives a task. A worker holds one at a time."""
    if _encoders.get(path, None) is None or _encoders[path].cache_bytes != cache_bytes:
        _encoders.clear()
        _encoders[path] = Encoder(path, cache_bytes)
    return _encoders[path]
