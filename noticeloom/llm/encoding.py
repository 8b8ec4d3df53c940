"""Token ids of whole texts, from a tokenizers file, with a cache of white-space chunks.

Where the tokenizer lowers letters, drops white space and never joins across it, the ids of a
text are the ids of its chunks in order. Most chunks repeat; each task keeps the bytes of their
ids. A tokenizer that answers PROBES otherwise gets whole texts.
"""

from __future__ import annotations

import os
import re
from array import array

#: Chunks in a generation of a Python worker's cache; two are kept, about 110 MB.
CACHE_CHUNKS = 250_000

#: Lower-case ASCII words; Latin words of letters that stay as they are when composed; words before marks.
ASCII_WORD = re.compile(rb"[a-z]+")
LATIN_WORD = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
MARKS = frozenset(bytes([b]) for b in b".,!?%*$&#;:|")
ENDED = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([.,!?%*$&#;:|]+)")

#: Texts whose ids must be those of their chunks.
PROBES = ["Hello World a b", " two  blanks\nand a\tline ", "DON'T stop!! now... x1 2y z.", "É é ß Ärger ça und øre", "e\u0301 \u0301 İ Σσς", "日本 1234 a-b_c (d) #e @f", "word,", "a.b,c;d", "the The THE tHe"]

_kept: dict = {}


class Chunks(dict):
    """Ids of chunks, worked out when first asked for. What an older generation knows moves here."""

    def __init__(self, tokenizer, letters: dict[int, str], older: dict):
        self.tokenize, self.encode = tokenizer.model.tokenize, tokenizer.encode
        self.letters, self.older = letters, older

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.older.get(chunk)
        if found is None:
            found = self.learn(chunk)
        self[chunk] = found
        return found

    def learn(self, chunk: bytes) -> bytes:
        if ASCII_WORD.fullmatch(chunk):  # such words are what the model is given, as they stand
            return array("I", [t.id for t in self.tokenize(chunk.decode())]).tobytes()
        if chunk[-1:] in MARKS:
            parts = ENDED.fullmatch(chunk)
            if parts:  # a word of letters is split from the marks after it, as the tokenizer does
                return self[parts[1]] + self[parts[2]]
        text = chunk.decode()
        if LATIN_WORD.fullmatch(text):
            return array("I", [t.id for t in self.tokenize(text.translate(self.letters))]).tobytes()
        return array("I", self.encode(text, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Little-endian unsigned 32-bit ids of a text, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters: dict = {}
        if self.tokenizer.pre_tokenizer and self.tokenizer.normalizer:
            spelt, plain = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.tokenizer.normalizer.normalize_str
            # How the model spells each letter of Latin words, as the tokenizer's own first steps give it.
            self.letters = {ord(c): parts[0][0] for c in map(chr, range(256)) if LATIN_WORD.fullmatch(c) and (parts := spelt(plain(c)))}
        self.chunks = Chunks(self.tokenizer, self.letters, {})
        self.by_chunk = bool(self.letters)
        probes = [p.encode() for p in PROBES]
        self.by_chunk = self.by_chunk and self.encode(probes) == [self.whole(p) for p in probes]

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One per worker process and file: later tasks find a warm cache."""
        if path not in _kept:
            _kept[path] = cls(path)
        return _kept[path]

    def whole(self, text: bytes) -> bytes:
        """Ids of a text from the tokenizer itself."""
        return array("I", self.tokenizer.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list) -> list[bytes]:
        """`texts`: UTF-8 bytes or None; None counts as empty. Whole texts, any length."""
        out: list = []
        for t in texts:
            if len(self.chunks) > CACHE_CHUNKS:
                self.chunks.older = {}
                self.chunks = Chunks(self.tokenizer, self.letters, self.chunks)
            if not t:
                out.append(b"")
            elif not self.by_chunk or b"<|" in t:  # special tokens are found by case, before white space counts: such texts go whole
                out.append(self.whole(t))
            else:
                out.append(b"".join(map(self.chunks.__getitem__, t.lower().replace(b"\n", b" ").split(b" "))))
        return out
