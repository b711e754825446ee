"""Near-duplicate vectors by an inverted multi-index.

Two independent codebooks, one for each half of the unit vectors, form a product grid of cells.
A vector visits the cells around it by multi-sequence traversal: both halves' codewords are
sorted by how far the vector lies from their region, and cells come off a heap by the sum of
the two squared distances, until that sum passes the stop of the target recall. Vectors met in a
visited cell are verified by their cosine in double precision.

Equal vectors are one class with a count, so copies cost nothing. A pair is met once: in the
vector's own cell by the smaller id, else from the cell with the smaller number. Tasks report
numbers of links and spanning links, never pairs.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import slots, stored
from hearsay.llm.components import components, merge_labels
from hearsay.llm.vectors import SEED, blocks, closest, codebook, matrix, runs, sample_matrix, squared, unit, usable

SAMPLE = 4096
#: Vectors of a label and cell that the grid's size aims at, and the share of links to find.
IN_CELL, RECALL = 128, 0.9999
BLOCK, SLICE = 512, 4096


@dataclass(frozen=True)
class Grid:
    """Codebooks of both halves, and the stop of the traversal as a squared distance."""

    first: np.ndarray
    second: np.ndarray
    stop: float

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
        """The own cell of each unit vector and the cells its traversal visits."""
        cut, wide = self.first.shape[1], len(self.second)
        near = [_beyond(rows[:, :cut], self.first), _beyond(rows[:, cut:], self.second)]
        order = [np.argsort(d, axis=1, kind="stable") for d in near]
        away = [np.take_along_axis(d, o, 1) for d, o in zip(near, order)]
        own = order[0][:, 0] * wide + order[1][:, 0]
        met = [[int(a[i]) * wide + int(b[j]) for i, j in traverse(x, y, self.stop)]
               for a, b, x, y in zip(*order, *(w.tolist() for w in away))]
        return own, met


def _beyond(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to the plane behind which each centre is nearer than the
    row's own centre; 0 for its own. No point of that centre's region is nearer."""
    d = squared(rows, centres)
    own = d.argmin(1)
    apart = np.sqrt(squared(centres, centres))[own]
    gap = (d - d.min(1)[:, None]) / np.maximum(2 * apart, 1e-12)
    gap[np.arange(len(rows)), own] = 0
    return gap ** 2


def traverse(first: list[float], second: list[float], stop: float) -> Iterator[tuple[int, int]]:
    """Multi-sequence: index pairs of two sorted lists by rising sum, while it is at most ``stop``."""
    heap = [(first[0] + second[0], 0, 0)]
    while heap and heap[0][0] <= stop:
        _, i, j = heapq.heappop(heap)
        yield i, j
        if j + 1 < len(second):
            heapq.heappush(heap, (first[i] + second[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(first):
            heapq.heappush(heap, (first[i + 1] + second[0], i + 1, 0))


def fit_grid(sample: np.ndarray, in_label: int, least: float, recall: float | None = RECALL) -> Grid:
    """Codebooks sized for ``in_label`` vectors of the largest label, and the stop.

    A link is at most 2 - 2 ``least`` away, squared; with ``recall`` None that is the stop, and no link can
    be missed. Otherwise every sampled vector gets partners at exactly that distance: towards another
    sampled vector, towards its nearest one, and in a random direction, so that links along the table's
    own main directions count as much as links that go anywhere. The stop is what the ``recall`` share
    of the partners needs to be met, by the kind of partner that needs most.
    """
    far, wide = 2 - 2 * least, sample.shape[1]
    k = max(1, min(256, math.ceil(math.sqrt(in_label / IN_CELL))))
    cut = max(1, wide // 2)
    second = codebook(sample[:, cut:], k) if wide > 1 else np.zeros((1, 0))
    grid = Grid(codebook(sample[:, :cut], k), second, far)
    if recall is None or k == 1 or len(sample) < 2:
        return grid
    draw = np.random.default_rng(SEED)
    others = np.concatenate([sample[draw.permutation(len(sample))] for _ in range(4)])
    towards = [others, _nearest_other(sample), draw.normal(size=(4 * len(sample), wide))]
    needed = [_needed(grid, np.tile(sample, (len(t) // len(sample), 1)), t, least) for t in towards]
    return replace(grid, stop=min(far, max(float(np.quantile(n, recall, method="higher")) for n in needed)))


def _nearest_other(rows: np.ndarray) -> np.ndarray:
    """The row nearest to each row, apart from itself."""
    found = []
    for at in range(0, len(rows), 1024):
        d = squared(rows[at:at + 1024], rows)
        d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
        found.append(rows[d.argmin(1)])
    return np.concatenate(found)


def _needed(grid: Grid, rows: np.ndarray, towards: np.ndarray, least: float) -> np.ndarray:
    """The stop at which each row's traversal meets the cell of its partner: the unit vector at cosine
    ``least`` from it in the direction of ``towards``."""
    out = []
    for at in range(0, len(rows), 1024):
        row, aim = rows[at:at + 1024], towards[at:at + 1024]
        aim = aim - (aim * row).sum(1)[:, None] * row
        size = np.linalg.norm(aim, axis=1, keepdims=True)
        partner = least * row + math.sqrt(1 - least * least) * aim / np.maximum(size, 1e-12)
        cut, i = grid.first.shape[1], np.arange(len(row))
        out.append(_beyond(row[:, :cut], grid.first)[i, closest(partner[:, :cut], grid.first)]
                   + _beyond(row[:, cut:], grid.second)[i, closest(partner[:, cut:], grid.second)])
    return np.concatenate(out)


def near_vectors(vectors: DataFrame, least: float = 0.93, recall: float | None = RECALL,
                 sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding, label).

    Two rows link when their labels are equal and not null, their vectors are as long and their
    cosine is at least ``least``. ``n_links`` counts the other rows linked directly,
    ``component_id`` is the smallest vec_id reachable, itself included. Rows without a label or
    an id, and vectors that are null, empty, zero or hold null or non-finite components, link
    with nothing and are kept. Rows equal in vector and label link with each other; ids are meant
    to be unique, and rows that share one share its links. Other columns are ignored; an empty
    table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", F.col("embedding").alias("vec"), "label",
                          F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"))
    fit = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    classes = stored(rows.filter(fit).groupBy("label", "dim", "vec").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("n")), "vector-classes")
    widths = [r[0] for r in classes.groupBy("dim").agg(F.count("*").alias("n"))
              .orderBy(F.desc("n"), "dim").limit(1).collect()]
    found = []
    for dim in widths:  # the grid fits the commonest width; other widths are one cell
        most = classes.filter(F.col("dim") == dim).groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        grid = fit_grid(sample_matrix(classes.filter(F.col("dim") == dim), sample), most, least, recall)
        found.append(stored(_links(classes, grid, dim, least, slots(spark)), "vector-links"))
    if not found:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"),
                           F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found[0].filter("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    roots = components(found[0].filter("b is not null").select("a", "b"))
    known = (classes.join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
             .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                     F.coalesce("root", "id").alias("component_id")))
    linked = rows.filter(fit).join(known, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~fit).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                     F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(classes: DataFrame, grid: Grid, dim: int, least: float, parts: int) -> DataFrame:
    """(a, b, links): numbers of links of class a (b null), or a spanning link of a and b."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            wide = b.column(1).to_numpy() == dim
            own, met = np.zeros(b.num_rows, "i8"), [[0]] * b.num_rows
            if wide.any():
                at = np.flatnonzero(wide)
                own[at], seen = grid.cells(unit(matrix(b.column(2).take(pa.array(at)))))
                for i, cells in zip(at.tolist(), seen):
                    met[i] = [c for c in cells if c >= own[i]]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(own), pa.array(met, pa.list_(pa.int64()))],
                ["label", "dim", "vec", "id", "n", "own", "met"])

    kind, vec = (classes.schema[c].dataType.simpleString() for c in ("label", "vec"))
    placed = stored(classes.select("label", "dim", "vec", "id", "n").mapInArrow(
        place, f"label {kind}, dim int, vec {vec}, id long, n long, own long, met array<long>"), "vector-cells")
    # labels as numbers: equal labels have equal hashes, and verification compares another hash of the label
    named = placed.withColumn("group", F.xxhash64("label")).withColumn("tag", F.hash("label"))
    columns = ["group", "dim", "cell", "id", "n", "own", "tag", "vec"]
    residents = named.withColumn("cell", F.col("own")).select(*columns)
    probes = named.withColumn("cell", F.explode("met")).select(*columns)
    stream = blocks(residents, probes, ["group", "dim", "cell"], BLOCK, SLICE, parts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        block = None
        for new, role, b in runs(batches, 3):
            if new:
                held, block = [], None
            if role == 0:
                held.append(b)
                continue
            block = block or (_Side(held) if held else None)
            if block is not None:
                for at in range(0, b.num_rows, SLICE):
                    yield from _compare(block, _Side([b.slice(at, SLICE)]), least)

    return stream.mapInArrow(verify, "a long, b long, links long")


class _Side:
    """Vectors of a stretch of rows, with what the comparison needs of them."""

    def __init__(self, held: list[pa.RecordBatch]):
        column = lambda i: np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held])
        self.cell, self.id, self.n, self.own, self.tag = (column(i) for i in (2, 6, 7, 8, 9))
        self.rows = np.concatenate([matrix(b.column(10)) for b in held])
        self.norm = np.sqrt((self.rows ** 2).sum(1))


def _compare(block: _Side, probe: _Side, least: float) -> Iterator[pa.RecordBatch]:
    near = (probe.rows @ block.rows.T) / (probe.norm[:, None] * block.norm[None]) >= least
    near &= probe.tag[:, None] == block.tag[None]
    inside = probe.own == probe.cell
    near &= ~inside[:, None] | (probe.id[:, None] < block.id[None])
    i, j = np.nonzero(near)
    if not len(i):
        return
    there = near.astype("i8")
    ids = np.concatenate([block.id, probe.id])
    links = np.concatenate([probe.n @ there, there @ block.n])
    distinct, spot = np.unique(ids, return_inverse=True)
    root = merge_labels(np.arange(len(distinct)), spot[len(block.id) + i], spot[j])
    some, moved = links > 0, root != np.arange(len(distinct))
    a = np.concatenate([ids[some], distinct[moved]])
    b = np.concatenate([np.zeros(some.sum(), "i8"), distinct[root[moved]]])
    count = np.concatenate([links[some], np.zeros(moved.sum(), "i8")])
    yield pa.RecordBatch.from_arrays(
        [pa.array(a), pa.array(b, mask=np.arange(len(a)) < some.sum()), pa.array(count)], ["a", "b", "links"])
