"""How often the words of given lists occur in texts, counted over the bytes of a whole batch.

Lower-casing and the question what a letter is stay with Spark's functions. An Arrow UDF then finds the
runs of letters of all texts of a slice at once, looks up those that begin like a listed word, and
returns one number per list. A slice is about ``SLICE`` bytes, which bounds the arrays.
"""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are looked at together; a longer text is a slice of its own.
SLICE = 1 << 18
#: Bytes of a word that are compared at once.
HEAD = 8
ODD_SEPARATOR = r"[^\x00-\x7F\p{L}]+"
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(HEAD + 1)], "u8")


def count_listed(text: Column, lists: Sequence[Collection[str]]) -> Column:
    """Array of int: for every list the number of words of the text that are in it, repeats included.
    Words are the runs of letters of the lower-case text; NULL has none."""
    known = sorted({w.encode() for words in lists for w in words} - {b""})
    place = {w: i for i, w in enumerate(known)}
    owned = [sorted({place[w.encode()] for w in words if w}) for words in lists]

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        finder = Finder(known)
        for texts in batches:
            each = finder.counts(texts)
            found = np.stack([each[:, own].sum(1, dtype="i4") for own in owned], 1)
            ends = np.arange(len(texts) + 1, dtype="i4") * found.shape[1]
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))

    return run(letters_apart(text))


def letters_apart(text: Column) -> Column:
    """The lower-case text with a space for all beyond ASCII that is no letter."""
    def clean(low: Column) -> Column:
        return F.when(F.octet_length(low) == F.length(low), low).otherwise(
            F.regexp_replace(low, F.lit(ODD_SEPARATOR), F.lit(" ")))

    return F.element_at(F.transform(F.array(F.lower(text)), clean), 1)  # lower-cased once


class Finder:
    """Finds given words (bytes, sorted) in Arrow arrays of texts."""

    def __init__(self, known: Sequence[bytes]):
        self.known, self.longest = {w: i for i, w in enumerate(known)}, max(map(len, known), default=0)
        heads = np.array([int.from_bytes(w[:HEAD], "little") for w in known], "u8")
        self.heads, self.word = np.unique(heads, return_index=True)
        self.begins = np.zeros(1 << 16, bool)
        self.begins[(heads & np.uint64(0xFFFF)).astype("i8")] = True

    def counts(self, texts: pa.Array) -> np.ndarray:
        """A row per text, a column per word."""
        texts = texts.fill_null("").cast(pa.large_binary())
        out = np.zeros((len(texts), len(self.known)), "i4")
        if not len(texts) or not len(self.known):
            return out
        _, ends, data = texts.buffers()
        ends = np.frombuffer(ends, "i8")[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
            row, word = self._found(data[ends[at]:ends[to]], ends[at:to + 1] - ends[at])
            out[at:to] = np.bincount(row * out.shape[1] + word, minlength=(to - at) * out.shape[1]).reshape(to - at, -1)
            at = to
        return out

    def _found(self, raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of every listed word in ``raw``, whose texts end where ``ends`` says."""
        # beyond ASCII ``letters_apart`` leaves nothing but letters
        inside = ((raw | 0x20) - ord("a") < 26) | (raw >= 0x80)
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        cuts = ends[(ends > 0) & (ends < len(raw))]  # a word never goes on in the next text
        begin[cuts] = inside[cuts]
        end[cuts - 1] = inside[cuts - 1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        padded = np.append(raw, np.zeros(HEAD, "u1"))
        eight = np.ndarray(len(raw), "<u8", padded, strides=(1,))
        size = end - begin
        # a one-letter word has a zero as its second byte
        head = eight[begin] & _MASKS[np.minimum(size, HEAD)]
        some = np.flatnonzero(self.begins[(head & np.uint64(0xFFFF)).astype("i8")] & (size <= self.longest))
        head, size, begin = head[some], size[some], begin[some]
        spot = np.minimum(np.searchsorted(self.heads, head), len(self.heads) - 1)
        same = self.heads[spot] == head
        spot, size, begin = spot[same], size[same], begin[same]
        word = self.word[spot]
        for i in np.flatnonzero(size >= HEAD).tolist():
            word[i] = self.known.get(raw[begin[i]:begin[i] + size[i]].tobytes(), -1)
        row = np.searchsorted(ends, begin, "right") - 1
        return row[word >= 0], word[word >= 0]
