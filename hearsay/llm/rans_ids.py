"""Token ids as binary blocks, coded by a static range asymmetric numeral system.

Documents are put in ascending order of their id, tokenized, and written as segments of about
``SEGMENT`` ids. A segment carries one frequency table, counted over all its ids and shared by
its blocks. A block of ``BLOCK`` ids is coded on its own by ``LANES`` interleaved coders; the
segment's directory is a list of checkpoints (bytes, ids, checksum), so blocks can be decoded in
parallel or alone. All blocks of a segment move through numpy together, one step per ``LANES``
ids of each. Segments are rows of a table that Spark writes and reads on any storage; a lost task
writes its segments again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hearsay.llm.byte_bpe import default_file, load, slices
from hearsay.llm.common import stored

END = 2
LANES, BLOCK, SEGMENT = 256, 1 << 16, 1 << 20
#: Frequencies of a table add up to 2**16; a coder's state stays in [2**16, 2**32).
SCALE = 16
#: Ids below this are numbered by a table.
TABLE = 1 << 20
MAGIC = b"rANS\x01"


# -- coding ---------------------------------------------------------------------------------

def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids and their frequencies, each at least 1, adding up to 2**16."""
    symbols, counts = np.unique(ids, return_counts=True)
    if len(symbols) > 1 << SCALE:
        raise ValueError("a segment may hold 65536 distinct ids at most")
    share = 1 + (counts * ((1 << SCALE) - len(symbols)) // max(1, counts.sum()))
    if len(share):
        share[counts.argmax()] += (1 << SCALE) - share.sum()
    return symbols.astype("u4"), share.astype("u4")


def _encode(codes: np.ndarray, freq: np.ndarray, low: np.ndarray) -> list[bytes]:
    """Code equally long rows of symbol numbers; one byte string per row. Tables and states are unsigned
    32-bit numbers, as no state reaches 2**32."""
    rows, n = codes.shape
    steps = -(-n // LANES)
    state = np.full((rows, LANES), 1 << SCALE, "u4")
    word, used = np.zeros((steps, rows, LANES), "<u2"), np.zeros((steps, rows, LANES), bool)
    for s in range(steps - 1, -1, -1):
        part = codes[:, s * LANES:(s + 1) * LANES]
        wide = part.shape[1]
        x, f = state[:, :wide], freq.take(part)
        full = x >> np.uint32(SCALE) >= f  # x >= f << SCALE, which may not fit
        word[s, :, :wide], used[s, :, :wide] = x & np.uint32(0xFFFF), full
        x = np.where(full, x >> np.uint32(SCALE), x)
        q = x // f
        state[:, :wide] = (q << np.uint32(SCALE)) + (x - q * f) + low.take(part)
    heads = state.astype("<u4")
    return [heads[r].tobytes() + word[:, r][used[:, r]].tobytes() for r in range(rows)]


def _decode(blocks: list[bytes], n: int, symbol: np.ndarray, freq: np.ndarray, rest: np.ndarray
            ) -> np.ndarray:
    """Undo ``_encode`` for blocks of ``n`` ids each; tables are indexed by slot."""
    rows = len(blocks)
    state = np.stack([np.frombuffer(b, "<u4", LANES) for b in blocks])
    words = np.frombuffer(b"".join(b[4 * LANES:] for b in blocks), "<u2").astype("u4")
    at = np.cumsum([0] + [(len(b) - 4 * LANES) // 2 for b in blocks])[:-1]
    out = np.empty((rows, n), "u4")
    for s in range(-(-n // LANES)):
        wide = min(LANES, n - s * LANES)
        x = state[:, :wide]
        slot = (x & np.uint32(0xFFFF)).astype(np.intp)
        out[:, s * LANES:s * LANES + wide] = symbol.take(slot)
        x = freq.take(slot) * (x >> np.uint32(SCALE)) + rest.take(slot)
        short = x < 1 << SCALE
        count, flat = short.sum(1), x.reshape(-1)
        places = np.flatnonzero(short)
        first = at - (np.cumsum(count) - count)  # next word of a block, less the words of blocks before it
        flat[places] = (flat[places] << np.uint32(SCALE)) | words.take(np.repeat(first, count) + np.arange(len(places)))
        at = at + count
        state[:, :wide] = x
    if (state != 1 << SCALE).any():
        raise ValueError("a block does not end in the coder's first state")
    return out


def _numbers(symbols: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The place of every id in the sorted ``symbols``: by a table, unless far larger ids would make it
    large."""
    if not len(symbols) or symbols[-1] >= TABLE:
        return np.searchsorted(symbols, ids)
    table = np.zeros(int(symbols[-1]) + 1, np.intp)
    table[symbols] = np.arange(len(symbols))
    return table[ids]


def pack(ids: np.ndarray) -> bytes:
    """A segment: header, frequency table, checkpoints, blocks."""
    symbols, freq = frequencies(ids)
    low = np.cumsum(freq, dtype="u4") - freq
    codes = _numbers(symbols, ids)
    whole = len(ids) // BLOCK
    blocks = _encode(codes[:whole * BLOCK].reshape(whole, BLOCK), freq, low) if whole else []
    if len(ids) % BLOCK:
        blocks += _encode(codes[None, whole * BLOCK:], freq, low)
    table = zlib.compress(np.diff(symbols, prepend=0).astype("<u4").tobytes()
                          + (freq - 1).astype("<u2").tobytes())
    points = b"".join(struct.pack("<III", len(b), len(part), zlib.crc32(part.astype("<u4").tobytes()))
                      for b, part in zip(blocks, (ids[i:i + BLOCK] for i in range(0, len(ids), BLOCK))))
    head = struct.pack("<III", len(symbols), len(table), len(blocks))
    return b"".join([MAGIC, head, table, points, *blocks])


def unpack(data: bytes, only: int | None = None) -> np.ndarray:
    """The ids of a segment, or of its block ``only``; damage raises ValueError."""
    if data[:5] != MAGIC:
        raise ValueError("not a segment")
    kinds, size, count = struct.unpack_from("<III", data, 5)
    raw = zlib.decompress(data[17:17 + size])
    symbols = np.cumsum(np.frombuffer(raw, "<u4", kinds), dtype="u4")
    freq = np.frombuffer(raw, "<u2", kinds, 4 * kinds).astype("u4") + np.uint32(1)
    low = np.cumsum(freq, dtype="u4") - freq
    owner = np.repeat(np.arange(kinds), freq.astype("i8"))
    rest = np.arange(len(owner), dtype="u4") - low[owner]
    points = [struct.unpack_from("<III", data, 17 + size + 12 * i) for i in range(count)]
    starts = np.cumsum([17 + size + 12 * count] + [p[0] for p in points]).tolist()
    chosen = range(count) if only is None else [only]
    blocks = [data[starts[i]:starts[i + 1]] for i in chosen]
    whole = [i for i in range(len(blocks)) if points[chosen[i]][1] == BLOCK]
    parts = list(_decode([blocks[i] for i in whole], BLOCK, symbols[owner], freq[owner], rest)) if whole else []
    parts += [_decode([b], points[k][1], symbols[owner], freq[owner], rest)[0]
              for k, b in zip(chosen, blocks) if points[k][1] != BLOCK]
    for part, k in zip(parts, chosen):
        if zlib.crc32(part.astype("<u4").tobytes()) != points[k][2]:
            raise ValueError(f"checksum of block {k} differs")
    return np.concatenate(parts) if parts else np.zeros(0, "u4")


# -- writing and reading --------------------------------------------------------------------

SEGMENT_SCHEMA = "part int, seq int, doc_ids array<long>, lengths array<int>, n_tokens long, payload binary"


def segments(docs: DataFrame, path: str | None = None, end: int = END) -> DataFrame:
    """The rows to write: segments in ascending order of (part, seq), documents in ascending
    order of their id (null first, then by text) through all of them.

    A segment closes once it holds ``SEGMENT`` ids, so it holds one long document at least and
    memory is bounded by that. Null and empty texts are the end id alone; repeated rows are kept;
    other columns are ignored; an empty table gives no segment.
    """
    ordered = (docs.select("doc_id", "text").repartitionByRange("doc_id")
               .sortWithinPartitions("doc_id", "text"))
    file = path

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = load(file or default_file()), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, np.ndarray]] = []
        size, last = 0, int(end).to_bytes(4, "little")
        for b in batches:
            for names, texts in slices(b):
                for name, text in zip(names, texts):
                    held.append((name, np.frombuffer(coder.encode(text) + last, "<u4")))
                    size += len(held[-1][1])
                    if size >= SEGMENT:
                        yield _segment(part, seq, held)
                        held, size, seq = [], 0, seq + 1
        if held:
            yield _segment(part, seq, held)

    return ordered.mapInArrow(each, SEGMENT_SCHEMA)


def _segment(part: int, seq: int, held: list) -> pa.RecordBatch:
    ids = np.concatenate([i for _, i in held])
    values = [part, seq, [n for n, _ in held], [len(i) for _, i in held], len(ids), pack(ids)]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array([v], t) for v, t in zip(values, types)],
        ["part", "seq", "doc_ids", "lengths", "n_tokens", "payload"])


def read_back(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the written segments.

    ``start`` counts the ids of all documents before it. Segment totals are summed per part
    first, so the one window without a key has a row per part.
    """
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("inner"))
    starts = stored(starts.join(parts, "part").select("part", "seq", (F.col("base") + F.col("inner")).alias("first")),
                    "starts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, names, lengths, data in zip(*(b.column(i) for i in range(5))):
                ids = unpack(data.as_py()).astype("<u4")
                size = lengths.values.to_numpy().astype("i8")
                ends = np.cumsum(size)
                sums = [zlib.crc32(ids[e - n:e].tobytes()) for e, n in zip(ends.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * len(size), pa.int32()), pa.array([seq.as_py()] * len(size), pa.int32()),
                     names.values, pa.array(ends - size), pa.array(size), pa.array(sums, pa.int64())],
                    ["part", "seq", "doc_id", "offset", "n_tokens", "ids_crc32"])

    rows = files.select("part", "seq", "doc_ids", "lengths", "payload").mapInArrow(
        each, "part int, seq int, doc_id long, offset long, n_tokens long, ids_crc32 long")
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
