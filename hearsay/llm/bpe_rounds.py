"""BPE encoding and decoding by batched merge rounds in numpy.

The distinct words of a batch of texts lie one after another in one flat array of symbols. A
round looks up every neighbouring pair of a word by binary search in the sorted pair keys, takes
each word's lowest rank, and merges that pair wherever the word holds it. Words that have nothing
left to merge leave the array. Texts are then put together from the words' ids. There is no
shuffle; memory follows one batch.

The tokenizer is read from a tokenizers JSON file: NFC, white space to one space, lower case,
a split into letters, single digits and other signs, bytes as symbols, word ends marked.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex

from pyspark.sql import DataFrame, functions as F, types as T
from tokenizers import Tokenizer

#: Fixed value: white space as the file's normalizer understands it.
_SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD_SPACE = regex.compile("[\\x1c-\\x1f]")  # str.split() breaks here, the tokenizer does not
#: Beyond Latin letters, character classes follow the Unicode version of the library, whose own
#: normalizer and splitter are then asked.
_RARE = regex.compile("[^\\x00-\u024f\u2010-\u2027]")
#: Most characters of distinct words that one merge array holds.
ARRAY = 1 << 18
#: Distinct chunks whose ids a worker keeps.
KEPT = 200_000
#: Bytes of a word from which on it is merged alone.
LONG = 512


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next
    free one from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in kept else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.base = max([*vocab.values(), *self.special.values()]) + 1
        self.names = [""] * self.base
        for name, at in (vocab | self.special).items():
            self.names[at] = name
        signs = byte_signs()
        self.inner = np.array([vocab[s] for s in signs])
        self.last = np.array([vocab[s + self.suffix] for s in signs])
        pairs = [(vocab[x] * self.base + vocab[y], rank, vocab[x + y])
                 for rank, (x, y) in enumerate(model["merges"])]
        keys, ranks, made = np.array(pairs, "i8").T
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], ranks[order], made[order]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
                     if p["type"] == "Split")
        self.split = regex.compile(split)
        self.known: dict[str | int, bytes] = {}
        self.byte_of = {s: b for b, s in enumerate(signs)}
        self.path = path
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, read only once a text needs it."""
        return Tokenizer.from_file(self.path)

    def chunks(self, text: str) -> list[str | int]:
        """A text as normalized runs of other than white space, and ids of special tokens."""
        if "<|" in text:
            out: list[str | int] = []
            for part in self.cut.split(text):
                out += [self.special[part]] if part in self.special else self._runs(part)
            return out
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        if _RARE.search(text):
            return [x for x in self.library.normalizer.normalize_str(text).split(" ") if x]
        text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: a capital sigma has one small form, wherever it stands
        text = text.replace("Σ", "σ").lower()
        if _ODD_SPACE.search(text):
            return [x for x in _SPACE.split(text) if x]
        return text.split()

    def words(self, chunk: str) -> list[bytes]:
        """The words of a normalized chunk as bytes."""
        if _RARE.search(chunk):
            return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in
                    self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        return [w.encode() for w in self.split.findall(chunk)]

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word. Words of more than ``LONG`` bytes go one by one, as their many rounds would
        pass over all others."""
        long = {i: self._merge_long(w) for i, w in enumerate(words) if len(w) > LONG}
        if long:
            short = iter(self.encode_words([w for w in words if len(w) <= LONG]))
            return [long[i] if i in long else next(short) for i in range(len(words))]
        out: list[np.ndarray] = []
        at = 0
        while at < len(words):
            end, size = at, 0
            while end < len(words) and (end == at or size + len(words[end]) <= ARRAY):
                size += len(words[end])
                end += 1
            out += self._merge(words[at:end])
            at = end
        return out

    def _merge(self, words: list[bytes]) -> list[np.ndarray]:
        length = np.fromiter(map(len, words), "i8", len(words))
        raw = np.frombuffer(b"".join(words), "u1")
        symbol = self.inner[raw]
        symbol[np.cumsum(length) - 1] = self.last[raw[np.cumsum(length) - 1]]
        word = np.repeat(np.arange(len(words)), length)
        ready_word, ready_symbol, none = [], [], np.iinfo("i8").max
        while len(symbol):
            joined = word[:-1] == word[1:]
            key = symbol[:-1] * self.base + symbol[1:]
            spot = np.searchsorted(self.keys, key)
            spot[spot == len(self.keys)] = 0
            rank = np.where(joined & (self.keys[spot] == key), self.ranks[spot], none)
            rank, spot = np.append(rank, none), np.append(spot, 0)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, first)
            counts = np.diff(np.append(first, len(word)))
            lowest = np.repeat(least, counts)
            idle = lowest == none
            if idle.any():
                ready_word.append(word[idle])
                ready_symbol.append(symbol[idle])
            hit = (rank == lowest) & ~idle
            hit &= ~self._overlapped(hit)
            symbol = np.where(hit, self.made[spot], symbol)
            keep = ~idle & ~np.append(False, hit[:-1])
            symbol, word = symbol[keep], word[keep]
        word, symbol = np.concatenate(ready_word), np.concatenate(ready_symbol)
        order = np.argsort(word, kind="stable")
        return np.split(symbol[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """The same rounds for one word, but a round only touches the places where its pair stands and
        their neighbours: places wait under the rank of their pair, and symbols are linked."""
        raw = np.frombuffer(word, "u1")
        symbol = self.inner[raw]
        symbol[-1] = self.last[raw[-1]]
        n = len(symbol)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def pairs(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """The places whose pair can merge, and where its key stands."""
            at = at[(at >= 0) & alive[at]]
            at = at[after[at] < n]
            key = symbol[at] * self.base + symbol[after[at]]
            spot = np.searchsorted(self.keys, key)
            spot[spot == len(self.keys)] = 0
            known = self.keys[spot] == key
            return at[known], spot[known]

        def wait(at: np.ndarray) -> None:
            at, spot = pairs(at)
            order = np.argsort(self.ranks[spot], kind="stable")
            at, rank = at[order], self.ranks[spot][order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, held in zip(rank[np.append(0, cuts)].tolist() if len(rank) else (), np.split(at, cuts)):
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(held)

        wait(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at, spot = pairs(np.unique(np.concatenate(waiting.pop(r))))
            at, spot = at[self.ranks[spot] == r], spot[self.ranks[spot] == r]
            if not len(at):
                continue
            # of a run of overlapping pairs, as in aaa, every second one merges
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(np.append(True, after[at[:-1]] != at[1:]), place, 0))
            taken = (place - start) % 2 == 0
            at, spot = at[taken], spot[taken]
            gone = after[at]
            symbol[at], alive[gone] = self.made[spot], False
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at][inside]] = at[inside]
            wait(np.concatenate([before[at], at]))
        return symbol[alive]

    @staticmethod
    def _overlapped(hit: np.ndarray) -> np.ndarray:
        """Every second one of a run of hits: as in aaa, where only the first pair can merge."""
        at = np.arange(len(hit))
        start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), at, -1))
        return hit & ((at - start) % 2 == 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; the ids of distinct chunks are kept for the texts to come."""
        rows = [self.chunks(t) for t in texts]
        if len(self.known) > KEPT:
            self.known.clear()
        new = list(set().union(*rows) - self.known.keys())
        words: dict[bytes, int] = {}
        parts = [c if isinstance(c, int) else [words.setdefault(w, len(words)) for w in self.words(c)]
                 for c in new]
        ids = [i.astype("<u4").tobytes() for i in self.encode_words(list(words))]
        for chunk, part in zip(new, parts):
            self.known[chunk] = (struct.pack("<I", part) if isinstance(part, int)
                                 else b"".join(map(ids.__getitem__, part)))
        find = self.known.__getitem__
        return [np.frombuffer(b"".join(map(find, r)), "<u4") for r in rows]

    def decode(self, ids: np.ndarray) -> str:
        """The file has no decoder: tokens are joined by spaces, word ends and all."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    """One encoder per worker process and file."""
    return WordBpe(path)


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``ids`` (array<int>) and ``decoded`` (the ids as text again).

    ``path`` is a file every executor can read. Null and empty texts give no ids and an empty
    text. Repeated rows are kept; other columns are ignored; special tokens written in a text
    become their ids; an empty table gives an empty result.
    """
    return _each(docs, path, keep, "ids array<int>, decoded string", lambda bpe, ids: (
        [i.astype("i4") for i in ids], [bpe.decode(i) for i in ids]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row of ``docs``: the digests of what
    ``encode`` returns, without moving ids and texts out of the tasks."""
    def digest(bpe: WordBpe, ids: list[np.ndarray]):
        return ([len(i) for i in ids], [hashlib.sha256(i.tobytes()).hexdigest() for i in ids],
                [hashlib.sha256(bpe.decode(i).encode()).hexdigest() for i in ids])

    return _each(docs, path, ("doc_id",), "n_tokens long, ids_sha256 string, decoded_sha256 string", digest)


#: Characters encoded together: bounds the arrays of a task.
TOGETHER = 1 << 19


def _each(docs, path, keep, made, result) -> DataFrame:
    narrow = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], "text")
    schema = narrow.drop("text").schema
    new = T.StructType.fromDDL(made)
    for field in new:
        schema = schema.add(field)
    names, types, file = schema.names, [f.dataType.simpleString() for f in schema.fields[len(keep):]], path
    kinds = [{"array<int>": pa.list_(pa.int32()), "string": pa.string(), "bigint": pa.int64()}[t] for t in types]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file or default_file())
        for b in batches:
            texts, at = b.column(b.num_columns - 1), 0
            while at < b.num_rows:
                part, size = [], 0
                while at + len(part) < b.num_rows and (not part or size < TOGETHER):
                    part.append(texts[at + len(part)].as_py() or "")
                    size += len(part[-1])
                rows = b.slice(at, len(part))
                columns = [pa.array(c, k) for c, k in zip(result(bpe, bpe.encode(part)), kinds)]
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names)
                at += len(part)
            pa.default_memory_pool().release_unused()

    out = narrow.mapInArrow(each, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)],
                      *new.names)
