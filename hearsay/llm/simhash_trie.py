"""SimHash near-duplicates by a self-join of the fingerprints' binary trie.

Texts become 64-bit fingerprints in one pass without a shuffle. Distinct fingerprints are the
leaves of a binary trie. The join starts at the pair (root, root) and walks node pairs together:
each step adds the bits in which the two prefixes differ and drops the pair once they exceed the
budget. The upper part of the trie is walked as DataFrames, four bits a round, until both nodes
hold at most ``leaf_rows`` fingerprints; a hot prefix is simply walked further down. What is left
is walked bit by bit inside tasks, in bounded slices. Tasks report spanning links, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hearsay.llm.common import packed, slots, stored
from hearsay.llm.components import components, merge_labels

BITS, STEP = 64, 4
SEED = 42
#: Hashes, or pairs of trie nodes, that a task works on at once: bounds its arrays.
SLICE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """SimHash of a text: majority of the XXH64 bits over its word shingles, repeats included.

    Only A-Z are lower-cased; words are runs of other than ASCII white space. Fewer words than a
    shingle holds: the whole sequence is hashed. No word at all, or null: zero.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(t) + 1 for t in tokens])
        starts = [0, *ends[: len(tokens) - words].tolist()]
        hashes = [digest(joined[i:j], SEED)
                  for i, j in zip(starts, (ends[words - 1:] - 1).tolist())]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(BITS, "i8")
    for at in range(0, len(hashes), SLICE):  # bounded memory for very long texts
        part = np.array(hashes[at:at + SLICE], "<u8").view("u1").reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, key, fp) of every row: ``key`` is a hash of the text, ``fp`` holds the 64 bits as a
    signed long."""
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), text_key(F.col(text_col)).alias("key"),
                         F.col(text_col).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column(2)),
                                "u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view("i8"))], ["id", "key", "fp"])

    return narrow.mapInArrow(each, "id long, key long, fp long")


def text_key(text: Column) -> Column:
    """A hash that tells texts with one id apart."""
    return F.xxhash64(text)


def trie_links(fps: DataFrame, budget: int = 2, leaf_rows: int = 16384, top: int = 0) -> DataFrame:
    """Links (a, b) that connect exactly the distinct ``fp`` values within ``budget`` bits.

    Every pair within the budget ends up connected through reported links, and every reported
    link joins two values that chains of such pairs connect. Only values that agree in the first
    ``top`` bits (a multiple of ``STEP``) are compared: each such prefix has a trie of its own.
    """
    spark, depth, tasks = fps.sparkSession, top, []
    root = F.col("id")  # written, so that the first step is an ordinary join on the node
    pending = stored(spark.range(1 << top).select(root.alias("pa"), root.alias("pb"), F.lit(0).alias("err")), "trie-root")
    masks = [(m, m.bit_count()) for m in range(1 << STEP) if m.bit_count() <= budget]
    mask_array = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(c).alias("cost"))
                           for m, c in masks])
    while depth < BITS:
        parent = _prefix(F.col("fp"), depth)
        depth += STEP
        wanted = pending.select(F.explode(F.array("pa", "pb")).alias("up")).distinct()
        nodes = stored(
            fps.select(parent.alias("up"), _prefix(F.col("fp"), depth).alias("node"))
            .groupBy("up", "node").agg(F.count("*").alias("n"))
            .join(wanted, "up", "left_semi"), "trie-nodes")
        left = nodes.select(F.col("up").alias("pa"), F.col("node").alias("ca"),
                            F.col("n").alias("na"))
        right = nodes.select(F.col("node").alias("cb"), F.col("n").alias("nb"))
        low = F.lit((1 << STEP) - 1).cast("long")
        walked = (
            pending.join(left, "pa").select("*", F.explode(mask_array).alias("m"))
            .filter(F.col("err") + F.col("m.cost") <= budget)
            .withColumn("cb", F.shiftleft("pb", STEP).bitwiseOR(
                F.col("ca").bitwiseAND(low).bitwiseXOR(F.col("m.mask"))))
            .filter("pa <> pb OR ca <= cb").join(right, "cb")
            .select(F.col("ca").alias("pa"), F.col("cb").alias("pb"),
                    (F.col("err") + F.col("m.cost")).alias("err"),
                    F.greatest("na", "nb").alias("n")))
        walked = stored(walked, "trie-pairs")
        small = (F.col("n") <= leaf_rows) | F.lit(depth == BITS)
        tasks.append(walked.filter(small).filter("pa <> pb OR n > 1").select(
            F.lit(depth).alias("depth"), "pa", "pb", "err"))
        pending = walked.filter(~small).drop("n")
        if pending.isEmpty():
            break
    held = [_members(fps, t, d) for d, t in zip(range(top + STEP, BITS + 1, STEP), tasks)]
    paired = held[0]
    for more in held[1:]:
        paired = paired.unionByName(more)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for depth_, err, same, xs, ys in zip(*(batch.column(i) for i in range(5))):
                a = _unsigned(xs)
                b = a if same.as_py() else _unsigned(ys)
                node, root = link_forest(a, b, depth_.as_py(), err.as_py(), budget)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node.view("i8")), pa.array(root.view("i8"))], ["a", "b"])

    return paired.repartition(slots(spark)).mapInArrow(walk, "a long, b long")


def _prefix(fp, depth: int):
    if depth == 0:
        return F.lit(0).cast("long")
    return fp if depth == BITS else F.shiftrightunsigned(fp, BITS - depth)


def _members(fps: DataFrame, tasks: DataFrame, depth: int) -> DataFrame:
    """The tasks of one depth with the fingerprints below both nodes, at most ``leaf_rows`` each."""
    wanted = tasks.select(F.explode(F.array("pa", "pb")).alias("node")).distinct()
    blobs = (fps.select(_prefix(F.col("fp"), depth).alias("node"), "fp")
             .join(wanted, "node", "left_semi")
             .groupBy("node").agg(F.collect_list("fp").alias("fps")))
    return (tasks.join(blobs.select(F.col("node").alias("pa"), F.col("fps").alias("xs")), "pa")
            .join(blobs.select(F.col("node").alias("pb"), F.col("fps").alias("ys")), "pb")
            .select("depth", "err", (F.col("pa") == F.col("pb")).alias("same"), "xs",
                    F.when(F.col("pa") != F.col("pb"), F.col("ys")).alias("ys")))


def _unsigned(values: pa.ListScalar) -> np.ndarray:
    return np.sort(values.values.to_numpy(zero_copy_only=False).astype("i8").view("u8"))


def link_forest(a: np.ndarray, b: np.ndarray, depth: int, err: int, budget: int
                ) -> tuple[np.ndarray, np.ndarray]:
    """Walk two subtries (sorted unsigned values; ``a is b`` for a self-join) below ``depth``.

    Returns a spanning forest as (value, root) arrays. The frontier holds node pairs as index
    ranges; pairs of single values are compared at once, others descend one bit.
    """
    same = a is b
    every = a if same else np.concatenate([a, b])
    shift = 0 if same else len(a)
    label = np.arange(len(every))
    stack = [(depth, np.array([[0, len(a), 0, len(b), err]], "i8"))]
    while stack:
        bit, pairs = stack.pop()
        if len(pairs) > SLICE:
            half = len(pairs) // 2
            stack += [(bit, pairs[:half]), (bit, pairs[half:])]
            continue
        single = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if bit == BITS:
            single[:] = True
        if single.any():
            i, j = pairs[single, 0], pairs[single, 2]
            near = (np.bitwise_count(a[i] ^ b[j]) <= budget) & ~(same & (i == j))
            label = merge_labels(label, i[near], j[near] + shift)
            pairs = pairs[~single]
        if len(pairs):
            below = _descend(a, b, pairs, bit, budget, same)
            if len(below):
                stack.append((bit + 1, below))
    moved = label != np.arange(len(every))
    return every[moved], every[label[moved]]


def _descend(a, b, pairs, bit, budget, same) -> np.ndarray:
    a0, a1, b0, b1, err = pairs.T
    one = np.uint64(1 << (BITS - 1 - bit))
    am, bm = _middle(a, a0, a1, one), _middle(b, b0, b1, one)
    mirror = (a0 == b0) & (a1 == b1) if same else np.zeros(len(pairs), bool)
    kids = [np.column_stack(x) for x in (
        (a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1),
        (am, a1, b0, bm, err + 1))]
    kids[3] = kids[3][~mirror]  # of a node with itself, the mixed pair counts once
    out = np.concatenate(kids)
    full = (out[:, 0] < out[:, 1]) & (out[:, 2] < out[:, 3]) & (out[:, 4] <= budget)
    if same:
        full &= ~((out[:, 0] == out[:, 2]) & (out[:, 1] - out[:, 0] == 1)
                  & (out[:, 3] - out[:, 2] == 1))
    return out[full]


def _middle(values, lo, hi, one) -> np.ndarray:
    """First index in [lo, hi) whose bit is set; the values of a range share all higher bits."""
    first = values[lo]
    split = (first & ~(one | (one - np.uint64(1)))) | one
    return np.clip(np.searchsorted(values, split), lo, hi)


def near_groups(docs: DataFrame, words: int = 3, budget: int = 2, leaf_rows: int = 16384,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, fp, group) per row of ``docs``: fingerprint and smallest id it is linked to.

    Rows link when their fingerprints differ in at most ``budget`` bits; ``group`` is the
    smallest id reachable by links, itself included. Null and empty texts have fingerprint zero
    and link like any other. Rows with the same id or text are kept, each with its group; a null
    id never names a group unless nothing else is in it. Other columns of ``docs``, whatever
    their names, are ignored; an empty table gives an empty result.
    """
    rows = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(trie_links(classes.select("fp"), budget, leaf_rows))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    groups = linked.groupBy("root").agg(F.min("least").alias("group"))
    named = linked.select("fp", "root").join(groups, "root").select("fp", "group")
    return rows.join(named, "fp").select("id", "key", "fp", "group")


def one_per_group(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of ``near_groups`` the one with the smallest
    id (of those, the smallest hash of the text; null ids come last). Rows equal in id and text
    are one row. Texts are shuffled once: the join and the removal of equal rows share it.
    """
    return keep_first(docs, near_groups(docs, words, budget))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``one_per_group`` keeps of ``groups`` (id, key, fp, group). The names of
    other columns may be any."""
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("key"))
    root = groups.groupBy(F.coalesce("group", "fp").alias("g"), F.col("group").isNull().alias("nameless")).agg(
        F.min(order).alias("m"))  # a group without any id goes by its fingerprint
    kept = root.select(*_row_key(F.col("m.id"), F.col("m.key"))).distinct()
    rows = docs.select(packed(docs), *_row_key(F.col("doc_id"), text_key(F.col("text"))))
    return rows.join(kept, ["_id", "_key"], "left_semi").dropDuplicates(["_id", "_key"]).select("row.*")


def _row_key(id_: Column, key: Column) -> tuple[Column, Column]:
    """Join keys without nulls."""
    return (F.coalesce(id_, F.lit(0)).alias("_id"), F.xxhash64(id_.isNull(), key).alias("_key"))
