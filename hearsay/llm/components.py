"""Connected components of a link table, by alternating large-star and small-star rounds.

A star needs one shuffle: links are partitioned by node and sorted, so that a node's smallest neighbour
comes first and the others stream by. Duplicates do no harm, and whether a round changed anything is
known from the flags that its rows carry, so a round is one job of two shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from hearsay.llm.common import stored

#: Neighbours of a node that one task takes; more are dealt to several.
HUB = 1 << 17
STAR = "a long, b long, loose boolean"


def components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns ``a`` and ``b``).

    ``root`` is the smallest node reachable, itself included. Nodes without links are absent.
    Self-links and repeated links are harmless; an empty table gives an empty result. The links and every
    round are written to the shared folder, which cuts the lineage: what ``links`` comes from runs once, and
    later plans don't hold it. Only counts reach the driver. The
    neighbours of a node with more than ``HUB`` are cut into groups; an aggregate tells the groups which
    neighbour is the smallest.
    """
    seen = Observation("links")
    given = stored(links.select("a", "b").observe(seen, F.count_if(F.expr("a <> b")).alias("n")), "links")
    ends = given.select(F.explode(F.array("a", "b")).alias("node"))
    edges = given.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("loose"))
    for _ in range(max_rounds):
        if not seen.get["n"]:
            break
        many = seen.get["n"] > HUB  # else no node can have that many neighbours
        large = _large_star(edges, many)
        seen = Observation("round")
        edges = stored(_small_star(stored(large, "stars") if many else large, many).observe(
            seen, F.count("*").alias("n"), F.count_if("loose").alias("loose")), "links")
        if not seen.get["loose"]:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    found = ends.select("node", F.col("node").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("b").alias("root")))
    return found.groupBy("node").agg(F.min("root").alias("root"))


def _grouped(rows: DataFrame, many: bool) -> DataFrame:
    """(a, part, b, loose, low) with the rows of a node, or of a group of a hub's, together and in order.
    The first ``low`` of them is the node's smallest neighbour."""
    if not many:
        rows = rows.select("a", F.lit(0).alias("part"), "b", "loose", F.col("b").alias("low"))
        return rows.repartition("a").sortWithinPartitions("a", "b")
    size = F.ceil(F.count("*") / HUB).cast("int")
    hubs = rows.groupBy(F.col("a").alias("hub")).agg(size.alias("groups"), F.min("b").alias("least")).filter("groups > 1")
    part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")), F.lit(0)).cast("int")
    rows = rows.join(hubs, rows["a"] == hubs["hub"], "left").select(
        "a", part.alias("part"), "b", "loose", F.coalesce("least", "b").alias("low"))
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", "b")


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _batch(a: np.ndarray, b: np.ndarray, loose: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(loose.astype(bool))], ["a", "b", "loose"])


def _starts(a: np.ndarray, part: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])))


def _large_star(edges: DataFrame, many: bool) -> DataFrame:
    """Link every larger neighbour of a node to the node's smallest neighbour, or to the node. A link
    is loose where that is another one than before."""
    both = edges.select("a", "b", F.lit(False).alias("loose"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "loose"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group and its first neighbour
        for batch in batches:
            a, part, b, _, lows = _columns(batch)
            if not len(a):
                continue
            first = _starts(a, part)
            low = lows[first].copy()
            if held is not None and held[:2] == (a[0], part[0]):
                low[0] = held[2]
            held = (a[-1], part[-1], low[-1])
            size = np.diff(np.append(first, len(a)))
            low = np.minimum(np.repeat(low, size), a)
            new = (b > a) & np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]))
            yield _batch(b[new], low[new], low[new] < a[new])

    return _grouped(both, many).mapInArrow(each, STAR)


def _small_star(edges: DataFrame, many: bool) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them. Links of a node with several are
    loose, and so is the link of a node that any of its rows calls so."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last group: node, part, smallest neighbour, loose
        for batch in batches:
            a, part, b, loose, lows = _columns(batch)
            if not len(a):
                continue
            first = _starts(a, part)
            low, size = lows[first].copy(), np.diff(np.append(first, len(a)))
            same = held is not None and held[:2] == (a[0], part[0])
            if same:
                low[0] = held[2]
            wide = np.repeat(low, size)
            other = (b != wide) & np.append(True, b[1:] != b[:-1])
            any_loose = np.logical_or.reduceat(loose | (b != wide), first)
            if same:
                any_loose[0] |= held[3]
            elif held is not None:
                yield _batch(np.array([held[0]]), np.array([held[2]]), np.array([held[3]]))
            yield _batch(np.concatenate([b[other], a[first][:-1]]), np.concatenate([wide[other], low[:-1]]),
                         np.concatenate([np.ones(other.sum(), bool), any_loose[:-1]]))
            held = (a[-1], part[-1], low[-1], bool(any_loose[-1]))
        if held is not None:
            yield _batch(np.array([held[0]]), np.array([held[2]]), np.array([held[3]]))

    return _grouped(edges, many).mapInArrow(each, STAR)


def merge_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union of the links (i, j) into ``label``, which maps each index to its root; for the
    values inside one task."""
    while len(i):
        x, y = label[i], label[j]
        apart = x != y
        if not apart.any():
            break
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, deeper := label[label]):
            label = deeper
    return label
