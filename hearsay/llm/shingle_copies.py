"""Near copies by the share of five-word shingles, exact on candidates from the SimHash trie join.

Texts become sets of shingle hashes; equal sets are one class, so exact copies cost nothing. Each
class gets fingerprints, and the trie join of ``simhash_trie`` finds those that differ in at most
``BUDGET`` bits. One is the SimHash of the set. Bits of SimHash tell pairs at similarity 0.8 badly
from others (9.7 of 64 differ on average), so there are ``PRINTS`` short ones more, whose bits are
those of ``MINIMA`` shingles drawn min-wise: a pair at 0.8 meets in none of them with a chance of
1.4e-5. Each kind of fingerprint has a trie of its own. All pairs inside a connected group of
candidates are verified by their exact Jaccard similarity before they link. Groups are cut into
blocks and compared block by block; tasks return spanning links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hearsay.llm.common import slots, stored
from hearsay.llm.components import components, merge_labels
from hearsay.llm.simhash_trie import BITS, SEED, keep_first, majority, text_key, trie_links

WORDS = 5
#: Least similarity of near copies, as a fraction.
SHARE = (4, 5)
#: Short fingerprints of a class, shingles drawn for each, and bits taken from each of these.
PRINTS, MINIMA, TAKEN = 42, 8, 5
#: Bits in which fingerprints of candidates may differ, and leading bits that tell their kinds apart.
BUDGET, KIND = 1, 8
#: Fingerprints below a node that a task walks at once.
LEAF_ROWS = 1 << 18
#: Shingles that are multiplied at once, and what a block aims at: bounds a task's arrays.
CHUNK, BLOCK_ROWS, BLOCK_SHINGLES = 2048, 128, 1 << 16
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 32, (PRINTS * MINIMA, 1), "u4") | np.uint32(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; words as in ``simhash_trie.fingerprint``.

    Fewer words than a shingle holds: the whole sequence is hashed. No word at all, or null: none.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.zeros(0, "u8")
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= WORDS:
        return np.array([digest(joined, SEED)], "u8")
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[: len(tokens) - WORDS].tolist()]
    return np.unique(np.array([digest(joined[i:j], SEED)
                               for i, j in zip(starts, (ends[WORDS - 1:] - 1).tolist())], "u8"))


def prints(found: np.ndarray) -> np.ndarray:
    """The fingerprints of a set of shingles, as signed longs: kind, then bits; none of the empty set."""
    if not len(found):
        return np.zeros(0, "i8")
    high, least = (found >> np.uint64(32)).astype("u4"), np.full(PRINTS * MINIMA, 0xFFFFFFFF, "u4")
    for at in range(0, len(high), CHUNK):
        np.minimum(least, (_FACTORS * high[at:at + CHUNK]).min(1), out=least)
    taken = (least * np.uint32(0x9E3779B1) >> np.uint32(32 - TAKEN)).astype("u8").reshape(PRINTS, MINIMA)
    ends = BITS - KIND - TAKEN * np.arange(1, MINIMA + 1, dtype="u8")
    bits = np.append((taken << ends).sum(1, dtype="u8"), np.uint64(majority(found) >> KIND))
    return (bits | np.arange(PRINTS + 1, dtype="u8") << np.uint64(BITS - KIND)).view("i8")


def sketches(docs: DataFrame) -> DataFrame:
    """(id, key, cls, n, prints) of every row: ``cls`` is a hash of the set of shingles."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("id"), text_key(F.col("text")).alias("key"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t.as_py()) for t in batch.column(2)]
                cls = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], "u8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(cls.view("i8")),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([prints(s) for s in sets], pa.list_(pa.int64()))],
                    ["id", "key", "cls", "n", "prints"])

    return narrow.mapInArrow(each, "id long, key long, cls long, n long, prints array<long>")


def candidate_groups(classes: DataFrame) -> DataFrame:
    """(node, root): classes with a fingerprint within ``BUDGET`` bits of another's, and their group."""
    every = classes.select("cls", F.explode("prints").alias("fp"))
    owners = stored(every.groupBy("fp").agg(F.min("cls").alias("b"), F.max("cls").alias("last")), "prints")
    equal = (every.join(owners.filter("b <> last").select("fp", "b"), "fp").filter("cls <> b")
             .select(F.col("cls").alias("a"), "b"))
    met = stored(trie_links(owners.select("fp"), BUDGET, LEAF_ROWS, KIND).toDF("x", "y"), "print-links")
    near = (met.join(owners.select(F.col("fp").alias("x"), F.col("b").alias("a")), "x")
            .join(owners.select(F.col("fp").alias("y"), "b"), "y").select("a", "b"))
    return components(equal.unionByName(near).filter("a <> b").distinct())


def copy_links(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the candidate classes at ``SHARE`` or more."""
    spark = docs.sparkSession
    members = stored(candidate_groups(classes).withColumnsRenamed({"node": "cls", "root": "g"})
                     .join(classes.select("cls", "n", "first"), "cls"), "copy-members")
    count = F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("n") / BLOCK_SHINGLES)).alias("count")
    sizes = stored(members.groupBy("g").agg(count), "copy-groups")
    placed = (members.join(sizes, "g").withColumn("block", F.pmod(F.hash("cls"), F.col("count")).cast("int"))
              .select("g", "block", "cls", F.col("first.id").alias("id"), F.col("first.key").alias("key"))
              .select("g", "block", "cls", *_place(F.col("id"), F.col("key"))))
    texts = docs.select("text", *_place(F.col("doc_id").cast("long"), text_key(F.col("text"))))
    # equal rows come several times: one text a class
    held = texts.join(placed, ["_id", "_key"]).select("g", "block", "cls", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:3], pa.array([shingles(t.as_py()).view("i8") for t in batch.column(3)],
                                                  pa.list_(pa.int64()))], ["g", "block", "cls", "set"])

    kind = "g long, block int, cls long, set array<long>"
    blobs = stored(held.mapInArrow(read, kind).groupBy("g", "block")
                   .agg(F.collect_list(F.struct("cls", "set")).alias("rows")), "copy-blocks")
    pairs = (sizes.select("g", F.explode(F.sequence(F.lit(0), (F.col("count") - 1).cast("int"))).alias("x"), "count")
             .select("g", "x", F.explode(F.sequence("x", (F.col("count") - 1).cast("int"))).alias("y")))
    side = lambda b, r: blobs.select("g", F.col("block").alias(b), F.col("rows").alias(r))
    paired = (pairs.join(side("x", "xs"), ["g", "x"]).join(side("y", "ys"), ["g", "y"], "left")
              .select("xs", F.when(F.col("x") != F.col("y"), F.col("ys")).alias("ys"),
                      (F.col("x") == F.col("y")).alias("same")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for xs, ys, same in zip(*batch.columns):
                if not same.as_py() and not ys.is_valid:  # a block that no class fell into
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v) for v in spanning(xs, None if same.as_py() else ys)], ["a", "b"])

    return paired.repartition(slots(spark)).mapInArrow(verify, "a long, b long")


def _place(id_, key):
    """Join keys without nulls."""
    return F.coalesce(id_, F.lit(0)).alias("_id"), F.xxhash64(id_.isNull(), key).alias("_key")


def _sets(rows: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of a block, numbers of their shingles, and the shingles one after the other."""
    cls, found = rows.values.field("cls").to_numpy(), rows.values.field("set")
    sizes = found.value_lengths().to_numpy(zero_copy_only=False)
    cls, at = np.unique(cls, return_index=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    flat = found.flatten().to_numpy()
    return cls, sizes[at].astype("i8"), np.concatenate([flat[cuts[i]:cuts[i + 1]] for i in at])


def spanning(xs: pa.ListScalar, ys: pa.ListScalar | None) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs of two blocks, or of one with itself, at ``SHARE`` or more."""
    a, na, va = _sets(xs)
    b, nb, vb = (a, na, va) if ys is None else _sets(ys)
    known, spot = np.unique(np.concatenate([va, vb]), return_inverse=True)
    left, right, starts = spot[:len(va)], spot[len(va):], np.cumsum(nb) - nb
    met, mark = np.empty((len(a), len(b)), "i8"), np.zeros(len(known), "i8")
    for row, end, size in zip(met, np.cumsum(na).tolist(), na.tolist()):
        own = left[end - size:end]
        mark[own] = 1
        row[:] = np.add.reduceat(mark[right], starts)  # no set in a group is empty
        mark[own] = 0
    top, low = SHARE
    i, j = np.nonzero(low * met >= top * (na[:, None] + nb[None] - met))
    ids = np.unique(np.concatenate([a, b]))
    label = merge_labels(np.arange(len(ids)), np.searchsorted(ids, a[i]), np.searchsorted(ids, b[j]))
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def copy_groups(docs: DataFrame) -> DataFrame:
    """(id, key, fp, group) per row of ``docs``: class and smallest id it is linked to, as in
    ``simhash_trie.near_groups``. Null and empty texts, without any shingle, are one class."""
    rows = stored(sketches(docs), "sketches")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    classes = stored(rows.groupBy("cls").agg(
        F.min("id").alias("least"), F.min(order).alias("first"), F.first("n").alias("n"),
        F.first("prints").alias("prints")), "copy-classes")
    roots = components(copy_links(docs, classes))
    linked = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "least", F.coalesce("root", "cls").alias("root"))
    groups = linked.groupBy("root").agg(F.min("least").alias("group"))
    named = linked.join(groups, "root").select("cls", F.col("root").alias("fp"), "group")
    return rows.select("id", "key", "cls").join(named, "cls").select("id", "key", "fp", "group")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of ``copy_groups`` the one that
    ``simhash_trie.keep_first`` takes."""
    return keep_first(docs, copy_groups(docs))
