"""Fill-in-middle by secondary sort: a text's pieces are keyed by document and output position.

A text is cut into units (lines) and three spans; the spans travel as pieces of whole units, of
about ``PIECE`` bytes, that know where they stand in the output. One shuffle by document and a sort
inside the partitions (what ``repartitionAndSortWithinPartitions`` does, on DataFrames) puts every
document together. A streaming pass digests the output, tells the spans apart by the markers in it,
and hands the pieces to a second sort inside the same partitions, in the order of the original; no
second shuffle. No task holds more than a batch of pieces, however long a document is.

Documents are told apart by a hash of id and text and by where they were read. Equal rows of a batch
travel once, with their number. Null text is empty; a null id hashes as an empty string. Other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The spans as they stand in each form of output.
ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Place of a marker's span in the original.
PLACE = {PREFIX: 0, MIDDLE: 1, SUFFIX: 2}
#: Most bytes of a piece, unless a single unit is cut.
PIECE = 1 << 14
ROWS = 2048

KEY = "key long, part int, row int"
HEAD = "head struct<n:long,form:string,prefix_chars:long,middle_chars:long,copies:int>"
_HEAD = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                   ("middle_chars", pa.int64()), ("copies", pa.int32())])


@dataclass(frozen=True)
class Rule:
    """Which documents are turned (percent), which of them suffix first, and the seed."""

    seed: int = 7
    turned: int = 100
    suffix_first: int = 50


def cuts(name: int | None, text: bytes, rule: Rule) -> tuple[str, int, list[int], int, int]:
    """(form, number of units, where units end, units before the middle and up to its end)."""
    found = np.flatnonzero(np.frombuffer(text, "u1") == 10) + 1
    ends = found.tolist()
    if text and (not ends or ends[-1] < len(text)):
        ends.append(len(text))
    n = len(ends)
    digest = hashlib.sha256(f"{rule.seed}:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rule.turned:
        return "plain", n, ends, first, last
    return ("spm" if h4 % 100 < rule.suffix_first else "psm"), n, ends, first, last


def _chars(text: bytes) -> int:
    """Code points of UTF-8 text."""
    return int(np.count_nonzero((np.frombuffer(text, "u1") & 0xC0) != 0x80))


def _span(text: bytes, ends: list[int], i: int, j: int, mark: bytes) -> Iterator[bytes]:
    """Units i to j - 1 as pieces, the first of them after ``mark``."""
    at = ends[i - 1] if i else 0
    stop = ends[j - 1] if j else 0
    held = mark
    while at < stop:
        # whole units while they fit; a unit longer than a piece is cut
        k = int(np.searchsorted(ends, at + PIECE, "right"))
        to = ends[min(k, j) - 1] if k and ends[min(k, j) - 1] > at else min(at + PIECE, stop)
        yield held + text[at:to]
        held, at = b"", to
    if held:
        yield held


def pieces(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(key, part, row, doc_id, at, chunk, head): the output of every document in pieces; the
    first piece carries ``head``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, out = TaskContext.get().partitionId(), 0, Rows([*KEY_TYPES, pa.int64(), pa.int32(), pa.binary(), _HEAD],
                                                                  ["key", "part", "row", "doc_id", "at", "chunk", "head"])
        for batch in batches:
            rows = Counter(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for (name, text), copies in rows.items():
                text = text or b""
                form, n, ends, first, last = cuts(name, text, rule)
                key = xxhash.xxh64_intdigest(text, name or 0) - (1 << 63)
                spans = {PREFIX: (0, first), MIDDLE: (first, last), SUFFIX: (last, n)}
                if form == "plain":
                    head, found = (n, form, None, None, copies), _span(text, ends, 0, n, b"")
                else:
                    size = [0, *ends]
                    head = (n, form, _chars(text[:size[first]]), _chars(text[size[first]:size[last]]), copies)
                    found = (p for m in ORDER[form] for p in _span(text, ends, *spans[m], m))
                head = dict(zip(("n", "form", "prefix_chars", "middle_chars", "copies"), head))
                at = -1
                for at, chunk in enumerate(found):
                    yield from out.add(len(chunk), key, part, row, name, at, chunk, None if at else head)
                if at < 0:  # an empty text
                    yield from out.add(0, key, part, row, name, 0, b"", head)
                row += 1
        yield from out.rest()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(each, f"{KEY}, doc_id long, at int, chunk binary, {HEAD}")


KEY_TYPES = [pa.int64(), pa.int32(), pa.int32()]


class Rows:
    """Gathers rows into batches of bounded bytes."""

    def __init__(self, types: list[pa.DataType], names: list[str]):
        self.types, self.names, self.rows, self.size = types, names, [], 0

    def add(self, size: int, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size
        if self.size >= 1 << 22 or len(self.rows) >= ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*self.rows), self.types)], self.names)
        self.rows, self.size = [], 0


def assembled(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The pieces of ``pieces``, every document's together and in the order of its output."""
    return (pieces(docs, rule).repartition("key")
            .sortWithinPartitions("key", "part", "row", "at"))


def _documents(batches: Iterator[pa.RecordBatch], take: Callable) -> Iterator[pa.RecordBatch]:
    """Call ``take(begins, row)`` for each sorted row, then ``take(True, None)``."""
    before = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            yield from take(row[:3] != before, row)
            before = row[:3]
    yield from take(True, None)


def texts(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, form, text): the output of every row, a whole text in a row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, last = Rows([pa.int64(), pa.string(), pa.string()], ["doc_id", "form", "text"]), [], None

        def take(begins: bool, row) -> Iterator[pa.RecordBatch]:
            nonlocal held, last
            if begins and last is not None:
                whole = b"".join(held).decode("utf-8", "replace")
                for _ in range(last[1]["copies"]):
                    yield from out.add(len(whole), last[0], last[1]["form"], whole)
            if row is not None:
                if begins:
                    held, last = [], (row[3], row[6])
                held.append(row[5])

        yield from _documents(batches, take)
        yield from out.rest()

    return assembled(docs, rule).mapInArrow(each, "doc_id long, form string, text string")


def digests(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) per row.

    The restored text is put together from the output alone: a piece that begins with a marker
    opens a span, which goes back to its place.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Rows([*KEY_TYPES, pa.int64(), pa.int32(), pa.int32(), pa.binary(), _HEAD, pa.string()],
                   ["key", "part", "row", "doc_id", "place", "at", "chunk", "head", "output_sha256"])
        whole, last, place = None, None, 0

        def take(begins: bool, row) -> Iterator[pa.RecordBatch]:
            nonlocal whole, last, place
            if begins and last is not None:
                yield from out.add(0, *last[:4], 3, 0, None, last[6], whole.hexdigest())
            if row is None:
                return
            if begins:
                whole, last, place = hashlib.sha256(), row, 0
            chunk = row[5]
            whole.update(chunk)
            if last[6]["form"] != "plain" and chunk[:3] in PLACE:
                place, chunk = PLACE[chunk[:3]], chunk[3:]
            yield from out.add(len(chunk), *row[:3], None, place, row[4], chunk, None, None)

        yield from _documents(batches, take)
        yield from out.rest()

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "copies", "output_sha256", "restored_sha256"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()]
        out, back = Rows(kinds, names), None

        def take(begins: bool, row) -> Iterator[pa.RecordBatch]:
            nonlocal back
            if row is None:
                return
            if begins:
                back = hashlib.sha256()
            if row[4] < 3:
                back.update(row[6])
            else:
                yield from out.add(0, row[3], *row[7].values(), row[8], back.hexdigest())

        yield from _documents(batches, take)
        yield from out.rest()

    read_back = assembled(docs, rule).mapInArrow(
        read, f"{KEY}, doc_id long, place int, at int, chunk binary, {HEAD}, output_sha256 string")
    rows = read_back.sortWithinPartitions("key", "part", "row", "place", "at").mapInArrow(
        restore, "doc_id long, n long, form string, prefix_chars long, middle_chars long, copies int, "
                 "output_sha256 string, restored_sha256 string")
    copies = F.explode(F.sequence(F.lit(1), "copies"))
    return rows.withColumn("copies", copies).drop("copies")
