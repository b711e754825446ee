"""Best-fit packing planned on a histogram of lengths.

Documents are tokenized and cut into pieces, written once. How many pieces have which length is all
the planner sees: at most ``SIZE`` numbers, however many documents there are. It places whole runs of
equally long pieces by best-fit decreasing, into runs of sequences with the same room left; a planned
run says where the pieces ranked ``first`` to ``first + n`` of a length go. Pieces then take their
places by a join on their rank within their length. A rank is the number of such pieces in earlier
tasks plus the place in the own one, so no length is ever brought together in one task.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from hearsay.llm.byte_bpe import default_file, load, slices
from hearsay.llm.common import stored

SIZE, END = 1024, 2
#: Bytes of ids in a batch of pieces.
BATCH = 1 << 22
PLAN = "length int, first long, n long, per long, sequence long, room long"


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, n, pieces per sequence, first sequence, offset in it).

    Best-fit decreasing: a piece goes where the least room is left that holds it. Equal pieces fill
    a sequence one after the other, so runs are placed as a whole. Runs are bounded by lengths and
    rooms, not by pieces.
    """
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, sequences = [], 0
    for length in sorted(counts, reverse=True):
        left = counts[length]

        def place(first: int, n: int, room: int) -> int:
            """Fill up to ``n`` sequences from ``first`` on; returns how many were touched."""
            nonlocal left
            per, touched = room // length, 0
            whole = min(n, left // per)
            for many, each in ((whole, per), (int(whole < n and left % per > 0 and left < (whole + 1) * per), left % per)):
                if many:
                    runs.append((length, counts[length] - left, many * each, each, first + touched, size - room))
                    rooms[room - each * length].append((first + touched, many))
                    left -= many * each
                    touched += many
            return touched

        for room in sorted(r for r in rooms if r >= length):
            if not left:
                break
            held = rooms.pop(room)
            for first, n in held:
                done = place(first, n, room) if left else 0
                if done < n:
                    rooms[room].append((first + done, n - done))
        if left:
            sequences += place(sequences, left, size)
    return runs


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(part, nth, doc_id, piece, start, length, ids): documents' token ids and ``end``, cut into
    pieces where they are longer than ``size``; the first piece is the shorter one.

    ``nth`` counts the pieces of one length in a task. Null and empty texts are the end id alone,
    repeated rows are documents of their own, other columns are ignored, an empty table gives no
    piece. ``ids`` are little-endian unsigned 32-bit integers. Write the result before its ranks
    are used: another run of a task may number its pieces differently.
    """
    names = ["part", "nth", "doc_id", "piece", "start", "length", "ids"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = load(path or default_file()), TaskContext.get().partitionId()
        seen, rows, held = np.zeros(size + 1, "i8"), [], 0
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            for ids_of, texts in slices(batch):
                for name, text in zip(ids_of, texts):
                    ids = coder.encode(text) + last
                    n = len(ids) // 4
                    head = (n - 1) % size + 1
                    edges = [0, *range(head, n + 1, size)]
                    for k, (i, j) in enumerate(zip(edges, edges[1:])):
                        rows.append((part, int(seen[j - i]), name, k, i, j - i, ids[4 * i:4 * j]))
                        seen[j - i] += 1
                        held += 4 * (j - i) + 40
                        if held >= BATCH:
                            yield _batch(rows, kinds, names)
                            rows, held = [], 0
        if rows:
            yield _batch(rows, kinds, names)

    kind = "part int, nth long, doc_id long, piece int, start long, length int, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, kind)


def _batch(rows: list, kinds: list, names: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)


def place(found: DataFrame, size: int = SIZE) -> DataFrame:
    """``found`` (written pieces) with ``sequence_id`` and ``offset`` instead of ``part`` and ``nth``."""
    spark = found.sparkSession
    counts = stored(found.groupBy("length", "part").agg(F.count("*").alias("n")), "length-counts")
    # at most ``size`` rows
    runs = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    planned = spark.createDataFrame(runs, PLAN)
    slots = _slots(counts, planned)
    columns = [c for c in found.columns if c not in ("part", "nth")]
    i = F.col("base") + F.col("nth") - F.col("first")
    taken = found.join(slots, ["part", "length"]).filter("nth >= low and nth < high")
    return taken.select(*columns, (F.col("sequence") + F.floor(i / F.col("per"))).cast("long").alias("sequence_id"),
                        (F.col("room") + i % F.col("per") * F.col("length")).cast("long").alias("offset"))


def _slots(counts: DataFrame, planned: DataFrame) -> DataFrame:
    """Where the tasks' pieces go: (part, length, low, high, base, first, per, sequence, room) for
    the pieces ``low`` to ``high`` - 1 of a length in a task.

    The ranges of the tasks and those of the plan are cut against each other in one ordered pass
    per length; its rows are tasks and runs, not pieces.
    """
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = counts.select("length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n", "part")
    run = F.struct("first", "per", "sequence", "room")
    task = F.struct("part", "base", (F.col("base") + F.col("n")).alias("until"))
    both = (tasks.select("length", F.col("base").alias("at"), task.alias("task"))
            .unionByName(planned.select("length", F.col("first").alias("at"), run.alias("run")), allowMissingColumns=True))
    order = Window.partitionBy("length").orderBy("at")
    cut = both.select(
        "length", "at", F.lead("at").over(order).alias("next"),
        F.last("task", ignorenulls=True).over(order).alias("task"), F.last("run", ignorenulls=True).over(order).alias("run"))
    high = F.coalesce("next", "task.until")
    return cut.filter(high > F.col("at")).select(
        "task.part", "length", (F.col("at") - F.col("task.base")).alias("low"), (high - F.col("task.base")).alias("high"),
        "task.base", "run.first", "run.per", "run.sequence", "run.room")


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset): every piece with its place."""
    return place(stored(pieces(docs, path, size, end), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences; a group holds one sequence."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p"), F.sum("length").alias("n_tokens")).select(
        "sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
