"""Byte-level BPE ids, from the tokenizers library, a distinct word at a time.

A text is split by the file's own rule; every distinct word is encoded once per worker by the
library's model and kept as bytes. Texts with characters whose class depends on the Unicode
version, or with special tokens, go to the library whole. Ids are little-endian unsigned 32-bit.
"""

from __future__ import annotations

import array
import json
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache
from operator import attrgetter
from pathlib import Path

import pyarrow as pa
from tokenizers import Tokenizer

from hearsay.llm.bpe_rounds import byte_signs


def _word_rule() -> re.Pattern:
    """The splitting rule of byte-level files (contractions, letters, numbers, other signs, white space), with
    its classes spelled out for the characters that are not ``_RARE``. Numbers are digits, superscripts
    and vulgar fractions. Words come first, as nothing else can begin where they do."""
    known = [chr(c) for c in range(0x250)]
    letter = "".join(c for c in known if c.isalpha())
    number, space = "0-9²³¹¼½¾", "\\t-\\r \x85\xa0"
    return re.compile(f" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{number}{letter}]+"
                      f"|[{space}]+(?![^{space}])|[{space}]+")


#: Python breaks lines at 1C to 1F and the library does not; classes are fixed up to U+024F.
_RARE = re.compile("[^\\x00-\\x1b\\x20-\u024f\u2010-\u2027]")
_WORD = _word_rule()
_ID = attrgetter("id")
#: Words a worker keeps before it starts anew with the last ones at hand, and the longest of them.
KEPT, LONGEST = 600_000, 64
#: Characters of texts that are encoded together.
TOGETHER = 1 << 22


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe(dict):
    """A byte-level tokenizers file; maps a word to the bytes of its ids."""

    def __init__(self, path: str):
        super().__init__()
        self.before: dict[str, bytes] = {}  # words kept before the worker last started anew
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        self.signs = str.maketrans({chr(b): sign for b, sign in enumerate(byte_signs())})
        self.space = byte_signs()[ord(" ")]

    def __missing__(self, word: str) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if word.isascii() and word.isprintable():  # of these signs only the space has another one
                signs = word.replace(" ", self.space)
            else:
                signs = word.encode("utf-8").decode("latin-1").translate(self.signs)
            ids = _as_bytes(map(_ID, self.model.tokenize(signs)))
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.before = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text, as the library's ``encode`` gives them."""
        if _RARE.search(text) or (self.special and self.special.search(text)):
            return _as_bytes(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids)
        return b"".join(map(self.__getitem__, _WORD.findall(text)))


def _as_bytes(ids: Iterable[int]) -> bytes:
    held = array.array("I", ids)
    if sys.byteorder != "little":
        held.byteswap()
    return held.tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    """One per worker process and file."""
    return ByteBpe(path)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Names and texts of a batch (null: empty) in runs of about ``TOGETHER`` characters."""
    names, texts, size = [], [], 0
    for name, text in zip(batch.column(0), batch.column(1)):
        names.append(name.as_py())
        texts.append(text.as_py() or "")
        size += len(texts[-1])
        if size >= TOGETHER:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts
