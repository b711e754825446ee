"""Mix sources to target weights with a multivariate-hypergeometric splitting tree.

Documents fall into blocks by a hash of their id, a bounded number per source. Every source's
target is met by whole copies of the source plus blocks taken in permuted order while they fit.
The drawn blocks of all sources form exact quotas, which a binary tree splits among the output
shards: at each node the left half receives its share of blocks, and how many come from each
source is one multivariate-hypergeometric draw. Then each source's permuted blocks are dealt to the shards by these counts, so
blocks of different shards are disjoint, and a shard is ordered by a hash. All of it is DataFrame
expressions; random numbers are hashes of a seed, so reruns agree.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from hearsay.llm.common import packed, stored, word_count

#: Weights by the source's position, and the most copies of a source.
WEIGHTS = (1, 2, 3)
CAP = 3
BLOCKS, SHARDS = 1024, 16
#: Words that one task writes, about.
TASK_WORDS = 1 << 22
SEED = 20240701


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, target) from rows of (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets share the total size by
    weight; none exceeds ``CAP`` times its source, and what that cuts off is shared again by
    weight. Sorted by cap over weight, the sources that end at their cap come first, so one
    running sum finds the level at which all is shared. Windows run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.select("source", "source_size", (F.row_number().over(by_name) - 1).alias("sid"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    ratio = (F.col("cap") / F.col("weight")).alias("ratio")
    rising = Window.orderBy(ratio, "sid")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    level = ((total - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             / F.sum("weight").over(onward))
    per = per.select("*", F.when(level <= ratio, level).alias("level"))
    per = per.withColumn("level", F.max("level").over(every))
    return per.select("source", "sid", "source_size", F.coalesce(
        F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")),
        F.lit(0.0)).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) + 0.5) / float(1 << 53)


def _log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 8 and the product of the steps down to n."""
    z = n.cast("double") + 8.0
    series = (z + 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3)
    steps = n.cast("double") + 1.0
    for k in range(2, 9):
        steps = steps * (n.cast("double") + float(k))
    return series - F.log(steps)


def hypergeometric(uniform: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """How many of ``drawn`` blocks out of ``total`` are among the ``marked``: inversion of the
    distribution function, summed over twelve standard deviations around the mean. Each
    probability follows from the one before."""
    n, k, m = total.cast("double"), marked.cast("double"), drawn.cast("double")
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - total)
    high = F.least(drawn, marked)
    mean = m * k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(mean * (1 - k / F.greatest(n, F.lit(1.0))) * (n - m)
                    / F.greatest(n - 1, F.lit(1.0)))
    start = F.greatest(low, F.floor(mean - 12 * spread - 12).cast("long"))
    stop = F.least(high, F.ceil(mean + 12 * spread + 12).cast("long"))
    choose = lambda a, b: _log_factorial(a) - _log_factorial(b) - _log_factorial(a - b)

    def step(acc: Column, x: Column) -> Column:
        after = (marked - x) * (drawn - x) / ((x + 1) * (total - marked - drawn + x + 1)).cast("double")
        return F.struct((acc["sum"] + acc["p"]).alias("sum"), (acc["p"] * after).alias("p"),
                        F.when(acc["sum"] <= uniform, x).otherwise(acc["at"]).alias("at"))

    def summed(first: Column) -> Column:
        p = F.exp(choose(marked, first) + choose(total - marked, drawn - first) - choose(total, drawn))
        state = F.struct(F.lit(0.0).alias("sum"), p.alias("p"), first.alias("at"))
        return F.aggregate(F.sequence(first, stop), state, step)["at"]

    return F.when(low >= high, low).otherwise(_bind(start, summed))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def split_quotas(quotas: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(sid, shard, n) from (sid, n): each source's blocks split exactly among the shards.

    Shards' totals differ by at most one block. Each of the log2(shards) levels halves every node; how
    many of the left half's blocks come from each source is one multivariate-hypergeometric draw, made
    source after source from what is left to draw. A node is one row with a number per source, so all
    levels are one small job.
    """
    width = shards.bit_length() - 1
    if 1 << width != shards:
        raise ValueError("shards must be a power of two")
    counts = F.array_sort(F.collect_list(F.struct("sid", F.col("n").cast("long").alias("n"))))
    nodes = quotas.agg(counts.alias("counts")).select(F.lit(0).cast("long").alias("node"), "counts")
    for turn in range(width):
        nodes = nodes.select(F.explode(_halves(turn, 1 << (width - turn - 1))).alias("k")).select("k.*")
    return (nodes.select(F.col("node").cast("int").alias("shard"), F.explode("counts").alias("c"))
            .select("c.sid", "shard", "c.n").filter("n > 0"))


def _halves(turn: int, rest: int) -> Column:
    """The two halves of a node, as (node, counts); the left one holds the larger part of an odd number
    of blocks, fairly over the ``rest`` shards of each."""
    node, counts, zero = F.col("node"), F.col("counts"), F.lit(0).cast("long")

    def draw(total: Column) -> Column:
        none = F.expr("cast(array() as array<struct<sid:int,left:bigint,right:bigint>>)")
        start = F.struct(total.alias("total"), _left_part(total, rest).alias("open"), none.alias("done"))

        def step(acc: Column, x: Column) -> Column:
            many = hypergeometric(_uniform(F.lit(turn), node, x["sid"]), acc["total"], x["n"], acc["open"])
            return _bind(many, lambda y: F.struct(
                (acc["total"] - x["n"]).alias("total"), (acc["open"] - y).alias("open"),
                F.concat(acc["done"], F.array(F.struct(
                    x["sid"].cast("int").alias("sid"), y.alias("left"), (x["n"] - y).alias("right")))).alias("done")))

        return F.aggregate(counts, start, step)["done"]

    def half(done: Column, number: Column, side: str) -> Column:
        return F.struct(number.alias("node"), F.transform(
            done, lambda d: F.struct(d["sid"].alias("sid"), d[side].alias("n"))).alias("counts"))

    drawn = _bind(F.aggregate(counts, zero, lambda acc, x: acc + x["n"]), draw)
    return _bind(drawn, lambda d: F.array(half(d, node * 2, "left"), half(d, node * 2 + 1, "right")))


def _left_part(n: Column, rest: int) -> Column:
    """Blocks for the left half: ``rest`` shards of floor(n / 2 rest), the odd ones first left."""
    each, odd = F.floor(n / (2 * rest)).cast("long"), n % (2 * rest)
    return each * rest + F.least(odd, F.lit(rest)).cast("long")


def mix_plan(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS) -> DataFrame:
    """One row per document: (doc_id, source, size, source_size, target, draws).

    ``draws`` lists the shards the document goes to, once per copy taken, at most ``CAP``; an
    empty list means the mix leaves it out. Rows that share an id share a block, so repeated
    rows are all kept and treated alike. A null text has size 0, a null source is a source of
    its own, an empty table gives an empty plan. Other columns are ignored.

    Whole copies come first; the rest of a target is filled with the source's blocks in permuted
    order, each taken if it still fits, and at last with the smallest left over if that comes
    nearer to the target.
    """
    return _planned(docs, blocks, shards)[0]


def _planned(docs: DataFrame, blocks: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """The plan and the targets."""
    rows = stored(docs.select(
        F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"),
        F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id")), F.lit(blocks)).cast("int").alias("block")), "sizes")
    held = rows.groupBy("source", "block").agg(F.sum("size").alias("size"))
    targets = stored(source_targets(rows), "targets")
    drawn = stored(_draw(held, targets), "drawn")
    shares = split_quotas(drawn.groupBy("sid").agg(F.count("*").alias("n")), shards)
    ends = shares.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("shard", "n"))).alias("s"))
    ends = ends.select("sid", F.aggregate(
        "s", F.expr("cast(array() as array<struct<shard:int,until:bigint>>)"),
        lambda acc, x: F.concat(acc, F.array(F.struct(
            x["shard"].alias("shard"),
            (F.coalesce(F.try_element_at(acc, F.lit(-1))["until"], F.lit(0)) + x["n"]).alias("until"))))
    ).alias("ends"))
    order = Window.partitionBy("sid").orderBy("key", "block", "copy")
    dealt = (drawn.withColumn("place", F.row_number().over(order) - 1).join(ends, "sid")
             .select("source", "block", F.filter("ends", lambda e: e["until"] > F.col("place"))[0]["shard"].alias("shard")))
    per_block = dealt.groupBy("source", "block").agg(F.sort_array(F.collect_list("shard")).alias("draws"))
    plan = rows.alias("r").join(
        per_block.alias("b"),
        F.col("r.source").eqNullSafe(F.col("b.source")) & (F.col("r.block") == F.col("b.block")), "left")
    plan = plan.select("r.doc_id", "r.source", "r.size",
                       F.coalesce("b.draws", F.array().cast("array<int>")).alias("draws"))
    plan = plan.alias("p").join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        "p.doc_id", "p.source", "p.size", "t.source_size", "t.target", "p.draws")
    return plan, targets


def _draw(held: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, sid, block, copy, key) for every block drawn; at most ``blocks`` per source are
    folded in one row."""
    key = F.xxhash64(F.lit(SEED + 1), F.col("source"), F.col("block"))
    per = held.groupBy("source").agg(
        F.array_sort(F.collect_list(F.struct(key.alias("key"), "block", "size"))).alias("order"))
    per = per.alias("h").join(targets.alias("t"), F.col("h.source").eqNullSafe(F.col("t.source"))).select(
        "t.source", "t.sid", "t.source_size", "t.target", "h.order")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    per = per.withColumn("whole", F.least(whole, F.lit(CAP)).cast("int")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size"))
    start = F.struct(F.col("rest").alias("rest"), F.expr("cast(array() as array<int>)").alias("taken"))
    fits = F.aggregate("order", start, lambda acc, x: F.when(
        (x["size"] > 0) & (x["size"] <= acc["rest"]),
        F.struct((acc["rest"] - x["size"]).alias("rest"),
                 F.concat(acc["taken"], F.array(x["block"])).alias("taken"))).otherwise(acc))
    per = per.withColumn("fit", fits)
    spare = F.array_sort(F.transform(
        F.filter("order", lambda x: (x["size"] > 0) & ~F.array_contains("fit.taken", x["block"])),
        lambda x: F.struct(x["size"].alias("size"), x["block"].alias("block"))))
    per = per.withColumn("spare", F.try_element_at(spare, F.lit(1)))
    nearer = F.col("spare.size") < 2 * F.col("fit.rest")
    part = F.when(nearer, F.concat("fit.taken", F.array("spare.block"))).otherwise(F.col("fit.taken"))
    per = per.withColumn("part", part)
    return per.select("source", "sid", F.col("whole"), "part", F.explode("order").alias("b")).select(
        "source", "sid", F.col("b.block").alias("block"), F.col("b.key").alias("key"),
        F.explode(F.sequence(F.lit(0), F.lit(CAP))).alias("copy"), "whole", "part").filter(
        (F.col("copy") < F.col("whole"))
        | ((F.col("copy") == F.col("whole")) & F.array_contains("part", F.col("block")))).select(
        "source", "sid", "block", "copy", F.xxhash64("key", "copy").alias("key"))


def mix(docs: DataFrame, blocks: int = BLOCKS, shards: int = SHARDS, task_words: int = TASK_WORDS) -> DataFrame:
    """The mixed documents: every column of ``docs``, whatever their names, a row per copy taken, dealt
    to ``shards`` shards and put into a hashed order inside each.

    A shard is one partition, or as many in a row as keep a partition at about ``task_words`` words: the
    hashes of the order are cut into equal ranges, so large inputs get more tasks, not larger ones.
    Rows with one id must have one source; the plan is joined back by id and source.
    """
    plan, targets = _planned(docs, blocks, shards)
    drawn = plan.filter(F.size("draws") > 0).select("doc_id", "source", "draws").distinct()
    total = targets.agg(F.sum("target")).first()[0] or 0
    pieces = max(1, math.ceil(total / shards / task_words))
    rows = docs.select(packed(docs), F.col("doc_id"), F.col("source")).alias("d").join(
        drawn.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")))
    rows = rows.select("row", "d.doc_id", F.posexplode("draws").alias("copy", "shard"))
    rows = rows.withColumn("place", F.xxhash64(F.lit(SEED + 2), F.col("doc_id"), F.col("copy")))
    # equal ranges of the signed hashes, in ascending order
    piece = F.least(F.floor((F.col("place") / float(1 << 64) + 0.5) * pieces), F.lit(pieces - 1))
    part = (F.col("shard") * pieces + piece).cast("int")
    return rows.repartitionById(shards * pieces, part).sortWithinPartitions("place").select("row.*")
