"""What the two vector operators share: validity, codebooks, and a join by sorted streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEED = 5


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    one = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, one) & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix of doubles."""
    return np.array(column.flatten().to_numpy(zero_copy_only=False), "f8").reshape(len(column), -1)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def sample_matrix(vectors: DataFrame, most: int) -> np.ndarray:
    """Unit vectors of at most ``most`` rows, those with the smallest hashes. A bounded sample, on
    which the codebooks are fitted."""
    rows = (vectors.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(most).toArrow())["vec"]
    return unit(matrix(rows.combine_chunks())) if len(rows) else np.zeros((0, 1))


def codebook(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means centres of the rows; fewer if there are fewer distinct rows."""
    distinct = np.unique(rows, axis=0)
    draw = np.random.default_rng(SEED)
    centres = distinct[draw.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = closest(rows, centres)
        count = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def closest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row, a thousand rows at a time."""
    return np.concatenate([squared(rows[i:i + 1024], centres).argmin(1) for i in range(0, len(rows), 1024)]
                          or [np.zeros(0, "i8")])


def squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all centres."""
    cross = rows @ centres.T
    return np.maximum(0, (rows ** 2).sum(1)[:, None] - 2 * cross + (centres ** 2).sum(1)[None])


def blocks(residents: DataFrame, probes: DataFrame, keys: list[str], rows_per_block: int,
           probes_per_slice: int, slots: int) -> DataFrame:
    """Residents and probes of equal keys, streamed together: partitioned by (keys, block, slice)
    and sorted so that the residents of a block (role 0) come before its probes (role 1).

    A key with many residents is cut into blocks, to each of which every probe goes; a key with
    many probes is cut into slices, to each of which every resident goes. So neither a hot key
    nor its probes meet in one task, and a task holds one block in memory at most.
    """
    pieces = lambda n, m: F.greatest(F.lit(1), F.ceil(n / float(m))).cast("int")
    here = residents.groupBy(*keys).agg(pieces(F.count("*"), rows_per_block).alias("_blocks"))
    there = probes.groupBy(*keys).agg(pieces(F.count("*"), probes_per_slice).alias("_slices"))
    cuts = here.join(there, keys)
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (residents.join(cuts, keys).withColumn("_block", part(F.col("_blocks")))
            .withColumn("_slice", every("_slices")).withColumn("role", F.lit(0)))
    right = (probes.join(cuts, keys).withColumn("_slice", part(F.col("_slices")))
             .withColumn("_block", every("_blocks")).withColumn("role", F.lit(1)))
    columns = [*keys, "_block", "_slice", "role", *[c for c in residents.columns if c not in keys]]
    order = [*keys, "_block", "_slice"]
    return (left.select(*columns).unionByName(right.select(*columns))
            .repartition(slots, *order).sortWithinPartitions(*order, "role"))


def runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """Stretches of one group and role: (a new group begins, role, rows). The columns begin with
    ``n_keys`` keys, block, slice and role; a group may span batches."""
    before = None
    for b in batches:
        grid = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys + 3)])
        starts = np.flatnonzero(np.append(True, (grid[1:] != grid[:-1]).any(1))).tolist()
        for i, j in zip(starts, [*starts[1:], b.num_rows]):
            key = tuple(grid[i, :-1].tolist())
            yield key != before, int(grid[i, -1]), b.slice(i, j - i)
            before = key
