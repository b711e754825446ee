"""Prefix trie of conversations by fixed-length blocks of turns.

A turn is two 64-bit hashes of its depth, role and text; a sequence is the exclusive or of its turns'
hashes, so the digest of any prefix is a running sum that can be computed in pieces. Conversations are
grouped by the digests of prefixes of ``BLOCK``, 2 ``BLOCK``, ... turns first. Where a block has no sibling
its turns are a chain and take its counts as they are; only where siblings diverge are their turns grouped
again. From here on the work is on distinct blocks, not on conversations.

Sums over subtrees need no walk through the tree. Every childless node sends its block path, which is that
of its smallest member: the paths through a block count its childless nodes and name the smallest as the
``owner``. A node's weight counts once, at its owner; the nodes one owner has are the end of its path. So a
subtree's sum is that of the totals of the paths through its top, less what the top's owner holds above it.

Texts are hashed where they are read and not shuffled. Long conversations are ranked, and sums along
paths taken, in pieces; a node where many conversations end is digested from pieces joined in order.

Order of turns: by ``turn``, null first; ties by their hash. Rows without a conv_id belong to no conversation.
Null roles and texts are empty strings. Repeated rows are turns of their own. Other columns are ignored. An
empty table has no node. Sequences are told apart by 128 bits of XXH64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.llm.common import stored

#: Turns of a block; blocks and nodes along a path that a window takes at once.
BLOCK, STRETCH = 8, 1024
#: Bytes of joined ids that one row holds.
JOINED = 1 << 16
#: How conversations are put together: ids in groups of ``FAMILY``, up to ``HEADS`` - 1 turns lent by the first.
FAMILY, HEADS = 5, 9
KEY, PARENT, OWN = ["kx", "ky"], ["px", "py"], ["bx", "by"]


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, total, depth, x, y, size): the turns of every conversation after rebuilding, and one
    row with a null depth for each conversation without any."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    narrow = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", F.xxhash64(F.lit(1), role, text).alias("a"),
        F.xxhash64(F.lit(2), role, text).alias("b"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "a", "b"]
    rows = stored(narrow.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", "a", "b", "size", F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at")), "turns")
    spans = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)), F.crc32(F.col("conv_id").cast("string")) % HEADS
    convs = spans.groupBy("conv_id").agg(F.sum("n").alias("n")).select("conv_id", "n", base.alias("base"), h.alias("h"))
    lent = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("of_base"))
    convs = stored(convs.join(lent, "base", "left").withColumn("lent", F.least("h", F.coalesce("of_base", F.lit(0)))).select(
        "conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")),
        "conversations")
    where = spans.join(convs, "conv_id").select("conv_id", "part", "h", "lent", "total", (F.col("before") - F.col("first")).alias("shift"))
    numbered = rows.join(where, ["conv_id", "part"]).withColumn("nth", F.col("at") + F.col("shift") + 1)
    own = numbered.filter("nth > h").select("conv_id", "total", (F.col("lent") + F.col("nth") - F.col("h")).alias("depth"), "a", "b", "size")
    heads = (numbered.filter((F.col("nth") < HEADS) & (F.pmod("conv_id", F.lit(FAMILY)) == 0))
             .select(F.col("conv_id").alias("base"), F.col("nth").alias("depth"), "a", "b", "size"))
    first = heads.join(convs, "base").filter("depth <= h").select("conv_id", "total", "depth", "a", "b", "size")
    hashed = [F.xxhash64(F.lit(s), F.col("depth"), F.col("a"), F.col("b")).alias(c) for s, c in ((3, "x"), (4, "y"))]
    turns = own.unionByName(first).select("conv_id", "total", "depth", *hashed, "size")
    return turns.unionByName(convs.filter("total = 0").select("conv_id", "total"), allowMissingColumns=True)


def along(rows: DataFrame, path: str, step: str, sums: dict[str, tuple[Column, str]], start: int) -> DataFrame:
    """``rows`` with running aggregates along each path: {name: (aggregate, column)} over the rows from
    the path's beginning to ``start`` (0: this row, -1: the one before it).

    Windows take ``STRETCH`` steps at a time; what earlier stretches add up to is joined where a path
    has more than one, so a very long path is not one task.
    """
    at = F.floor(F.col(step) / STRETCH).alias("_at")
    rows = rows.withColumn("_at", at)
    inside = Window.partitionBy(path, "_at").orderBy(step).rowsBetween(Window.unboundedPreceding, start)
    before = Window.partitionBy(path).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(path, "_at").agg(*[f(c).alias(n) for n, (f, c) in sums.items()])
    carried = whole.select(path, "_at", *[f(n).over(before).alias(f"_{n}") for n, (f, _) in sums.items()]).filter("_at > 0")
    out = rows.withColumns({n: f(c).over(inside) for n, (f, c) in sums.items()}).join(carried, [path, "_at"], "left")
    both = {n: (F.coalesce(n, F.lit(0)).bitwiseXOR(F.coalesce(f"_{n}", F.lit(0))) if f is F.bit_xor
                else F.coalesce(n, F.lit(0)) + F.coalesce(f"_{n}", F.lit(0))) for n, (f, _) in sums.items()}
    return out.withColumns(both).drop("_at", *[f"_{n}" for n in sums])


def _fold(start: Column, turns: Column, field: str) -> Column:
    return F.aggregate(turns, start, lambda acc, t: acc.bitwiseXOR(t[field]))


def blocks(turns: DataFrame) -> DataFrame:
    """(conv_id, total, k, turns, bx, by, px, py, kx, ky): a conversation's blocks with the digests of
    the prefixes that end before (p) and with (k) them; a block holds ``BLOCK`` turns at most."""
    held = (turns.filter("depth is not null").groupBy("conv_id", F.floor((F.col("depth") - 1) / BLOCK).alias("k"))
            .agg(F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("depth", "x", "y", "size"))).alias("turns")))
    zero, every = F.lit(0).cast("long"), F.col("turns")
    held = held.withColumns({"bx": _fold(zero, every, "x"), "by": _fold(zero, every, "y")})
    ends = along(held, "conv_id", "k", {"kx": (F.bit_xor, "bx"), "ky": (F.bit_xor, "by")}, 0)
    return ends.withColumns({"px": F.col("kx").bitwiseXOR(F.col("bx")), "py": F.col("ky").bitwiseXOR(F.col("by"))})


def _spread(kinds: DataFrame) -> DataFrame:
    """Turn rows of distinct blocks: their own block (bx, by), key, parent, depth, size."""
    upto, x, y = lambda n: F.slice("turns", F.lit(1), n), F.col("px"), F.col("py")
    return kinds.select("*", F.posexplode("turns").alias("i", "t")).select(
        F.col("kx").alias("bx"), F.col("ky").alias("by"),
        _fold(x, upto(F.col("i")), "x").alias("px"), _fold(y, upto(F.col("i")), "y").alias("py"),
        _fold(x, upto(F.col("i") + 1), "x").alias("kx"), _fold(y, upto(F.col("i") + 1), "y").alias("ky"),
        F.col("t.depth").alias("depth"), F.col("t.size").alias("size"), "n_convs", "conv_id", "alone")


def _members(placed: DataFrame) -> DataFrame:
    """Distinct blocks with their number of conversations, the smallest, and whether they have siblings.

    A parent with one child block is found by an aggregate whose only row is that child, so nothing is
    joined on the parent, which may be one key for a third of all blocks.
    """
    kinds = stored(placed.groupBy(*KEY, *PARENT, "k").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min_by("turns", "conv_id").alias("turns")), "blocks")
    only = kinds.groupBy(*PARENT).agg(F.count("*").alias("n"), F.min(F.struct(*KEY)).alias("child")).filter("n = 1")
    only = only.select("child.*", F.lit(True).alias("alone"))
    return kinds.join(only, KEY, "left").withColumn("alone", F.coalesce("alone", F.lit(False)))


def _refined(turns: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """One row per node: blocks without siblings as they are, diverging ones grouped turn by turn."""
    names = [*KEY, *PARENT, "depth", *sums]
    grouped = turns.filter("not alone").groupBy(*KEY, *PARENT, "depth").agg(*[c.alias(n) for n, c in sums.items()])
    return turns.filter("alone").select(names).unionByName(grouped.select(names))


def joined_digests(ends: DataFrame) -> DataFrame:
    """(kx, ky, digest): SHA-256 of the ascending, comma-joined conv_ids of every key.

    Ids are sorted over range partitions. A key inside one partition is digested there. A key that
    crosses a border, or is large, leaves pieces of joined text, which are then digested in order.
    """
    order = [*KEY, "conv_id"]
    names = [*KEY, "part", "seq", "joined", "digest"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
    form = "kx long, ky long, part int, seq long, joined binary, digest string"

    def batch(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, out, held = TaskContext.get().partitionId(), 0, [], 0
        key, ids, border = None, [], True  # the first key may have begun before

        def close(last: bool) -> None:
            nonlocal seq
            text = ",".join(map(str, ids)).encode()
            if border or last:
                out.append((*key, part, seq, text, None))
                seq += 1
            else:
                out.append((*key, None, None, None, hashlib.sha256(text).hexdigest()))

        for b in batches:
            for x, y, conv in zip(*(c.to_pylist() for c in b.columns)):
                if (x, y) != key:
                    if key is not None:
                        close(False)
                        border = False
                    key, ids = (x, y), []
                elif len(ids) >= JOINED // 8:
                    border = True  # too large to keep: in pieces
                    close(False)
                    ids = []
                ids.append(conv)
                held += 1
                if held >= JOINED:
                    yield from (batch(out),) if out else ()
                    out, held = [], 0
        if key is not None:
            close(True)
            yield batch(out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole = None, None
        for b in batches:
            out = []
            for x, y, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))):
                if (x, y) != key:
                    if key is not None:
                        out.append((*key, whole.hexdigest()))
                    key, whole = (x, y), hashlib.sha256(text)
                else:
                    whole.update(b"," + text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out)], [*KEY, "digest"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, whole.hexdigest())], [*KEY, "digest"])

    parts = stored(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(each, form), "ends")
    open_ = (parts.filter("digest is null").repartition(*KEY).sortWithinPartitions(*KEY, "part", "seq")
             .mapInArrow(finish, "kx long, ky long, digest string"))
    return parts.filter("digest is not null").select(*KEY, "digest").unionByName(open_)


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), as the module describes. The root has depth 0 and no parent."""
    turns = stored(rebuilt(conversations), "rebuilt")
    placed = stored(blocks(turns), "block-paths")
    spread = stored(_spread(_members(placed)), "block-turns")
    counted = _refined(spread, {"n_convs": F.sum("n_convs"), "conv_id": F.min("conv_id"), "size": F.max("size")})
    zero = F.lit(0).cast("long")
    root = turns.filter("depth = 1 or depth is null").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0")
    root = root.select(zero.alias("kx"), zero.alias("ky"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"),
                       zero.alias("depth"), "n_convs", "conv_id", zero.alias("size"))
    counted = stored(counted.unionByName(root), "nodes")
    children = counted.filter("px is not null").groupBy(*PARENT).agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed(dict(zip(PARENT, KEY)))
    nodes = stored(counted.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)), "with-children")

    # paths of childless nodes, by block
    leaves = nodes.filter("n_children = 0").select(F.col("conv_id").alias("leaf"))
    paths = stored(placed.join(leaves, placed["conv_id"] == leaves["leaf"]).select("leaf", *KEY), "leaf-paths")
    owner = _through(spread, paths.groupBy(*KEY).agg(F.count("*").alias("n_leaves"), F.min("leaf").alias("owner")),
                     {"n_leaves": F.sum("n_leaves"), "owner": F.min("owner")}).drop(*PARENT, "depth")
    n_leaves, least = leaves.agg(F.count("*"), F.min("leaf")).first()
    owned = stored(nodes.join(owner, KEY, "left").withColumns({  # only the root is in no block
        "n_leaves": F.coalesce("n_leaves", F.lit(n_leaves)), "owner": F.coalesce("owner", F.lit(least).cast("long")),
        "weight": (F.col("n_convs") - 1) * F.col("size")}), "owned")
    totals = owned.groupBy(F.col("owner").alias("leaf")).agg(F.sum("weight").alias("total"))
    below = _through(spread, paths.join(totals, "leaf").groupBy(*KEY).agg(F.sum("total").alias("below")),
                     {"below": F.sum("below")}).drop(*PARENT, "depth")
    everything = F.lit(owned.agg(F.sum("weight")).first()[0]).cast("long")
    above = along(owned, "owner", "depth", {"above": (F.sum, "weight")}, -1)
    summed = above.join(below, KEY, "left").withColumn("saved_tokens", F.coalesce("below", everything) - F.col("above"))

    ended = (placed.filter(F.col("k") * BLOCK + F.size("turns") == F.col("total")).select(*KEY, "conv_id")
             .unionByName(turns.filter("depth is null").select(zero.alias("kx"), zero.alias("ky"), "conv_id")))
    parents = nodes.select(F.col("kx").alias("px"), F.col("ky").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return (summed.join(parents, PARENT, "left").join(joined_digests(ended), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.lit(nothing)).alias("ends_sha256")))


def _through(spread: DataFrame, per_block: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """What the paths through the blocks add up to at every node."""
    per_block = per_block.withColumnsRenamed(dict(zip(KEY, OWN)))
    return _refined(spread.join(per_block, OWN, "left").na.fill(0, [c for c in sums if c != "owner"]), sums)
