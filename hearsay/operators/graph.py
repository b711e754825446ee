"""Subreddits that share their authors: a set-similarity join, degrees and communities.

Two sets with a Jaccard similarity of t or more share an element of their first n - ceil(t n) + 1
elements, in any order common to all sets. With the rarest authors first these prefixes hold few
authors that many subreddits share, so subreddits that have nothing but common authors to meet by are
never paired. What meets is checked for its size, and its similarity is then counted exactly.

No set is gathered: prefixes are found on counts per slice of the order, overlaps by counting the
smaller set's authors that the larger one has. Authors are not capped. Rows without a subreddit or an
author say nothing about who shares whom and are left out.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearsay.session import shared_scratch

#: Slices of the order among authors of one frequency, by hash.
SLICES = 64


def memberships(posts: DataFrame) -> DataFrame:
    """(subreddit, author): the edges of the bipartite graph, each once."""
    return posts.where("subreddit IS NOT NULL AND author IS NOT NULL").select("subreddit", "author").distinct()


def author_degrees(members: DataFrame) -> DataFrame:
    """(author, subreddits): in how many subreddits an author posts."""
    return members.groupBy("author").agg(F.count(F.lit(1)).alias("subreddits"))


def prefixes(members: DataFrame, least: Fraction) -> DataFrame:
    """(subreddit, author, size): the authors under which a subreddit has to be looked up.

    A subreddit's authors are counted per (frequency, hash slice); the slices that begin within the
    prefix are taken whole, so the result may hold a few authors more than needed, never fewer. The
    window runs over these counts.
    """
    ranked = members.join(author_degrees(members), "author").withColumn(
        "slice", F.pmod(F.xxhash64("author"), F.lit(SLICES)).cast("int"))
    counts = ranked.groupBy("subreddit", "subreddits", "slice").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("subreddit").orderBy("subreddits", "slice")
    size = F.sum("n").over(Window.partitionBy("subreddit"))
    before = F.sum("n").over(order) - F.col("n")
    needed = F.col("size") - F.ceil(F.col("size") * least.numerator / least.denominator) + 1
    inside = counts.withColumns({"size": size, "before": before}).where(F.col("before") < needed)
    return ranked.join(inside.select("subreddit", "subreddits", "slice", "size"), ["subreddit", "subreddits", "slice"]).select(
        "subreddit", "author", "size")


def candidates(index: DataFrame, least: Fraction) -> DataFrame:
    """(small, large, small_size, large_size): pairs that share a prefix author and whose sizes allow
    the similarity."""
    left = index.select("author", F.col("subreddit").alias("small"), F.col("size").alias("small_size"))
    right = index.select("author", F.col("subreddit").alias("large"), F.col("size").alias("large_size"))
    smaller = (F.col("small_size") < F.col("large_size")) | (
        (F.col("small_size") == F.col("large_size")) & (F.col("small") < F.col("large")))
    fits = F.col("small_size") * least.denominator >= F.col("large_size") * least.numerator
    return left.join(right, "author").where(smaller & fits).drop("author").distinct()


def similar_subreddits(members: DataFrame, least: Fraction = Fraction(1, 2)) -> DataFrame:
    """(a, b, shared, jaccard), a < b: all pairs of subreddits whose sets of authors have a Jaccard
    similarity of at least ``least``, with the number of authors they share."""
    members = kept(members, "memberships")
    found = kept(candidates(prefixes(members, least), least), "candidates")
    of_small = members.withColumnRenamed("subreddit", "small")
    of_large = members.withColumnRenamed("subreddit", "large")
    shared = (found.join(of_small, "small").join(of_large, ["large", "author"])
              .groupBy("small", "large", "small_size", "large_size").agg(F.count(F.lit(1)).alias("shared")))
    union = F.col("small_size") + F.col("large_size") - F.col("shared")
    return (shared.where(F.col("shared") * least.denominator >= union * least.numerator)
            .select(F.least("small", "large").alias("a"), F.greatest("small", "large").alias("b"), "shared",
                    F.round(F.col("shared") / union, 6).alias("jaccard")))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge from either end, as (node, other, shared, jaccard)."""
    turned = edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "shared", "jaccard")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "shared", "jaccard").unionByName(turned)


def communities(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, community): the smallest node that can be reached over ``edges``, itself included.

    Alternates two steps until nothing changes: larger neighbours are linked to a node's smallest
    neighbour, then a node's smaller neighbours to the smallest of them. Chains halve, so rounds grow with
    the logarithm of the longest one. Every round is written to the shared folder, which cuts the lineage.
    """
    links = kept(_downwards(edges.select("a", "b")), "links")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    before = None
    for _ in range(max_rounds):
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not now[0] or now == before:
            roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("community"))
        before = now
        ways = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = ways.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        large = _downwards(ways.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        links = kept(_downwards(large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
                                 .unionByName(low.select("a", F.col("low").alias("b")))), "links")
    raise RuntimeError(f"communities not settled after {max_rounds} rounds")


def _downwards(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def subreddit_graph(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(subreddit, authors, neighbours, shared, strongest, community) for every subreddit.

    ``neighbours`` and ``shared`` add up its edges, ``strongest`` is the neighbour with the largest
    similarity (the first by name among equals), NULL without edges; a subreddit without edges is a community of its own.
    """
    own = members.groupBy("subreddit").agg(F.count(F.lit(1)).alias("authors"))
    best = F.min(F.struct((-F.col("jaccard")).alias("j"), "other"))
    around = both_ways(edges).groupBy(F.col("node").alias("subreddit")).agg(
        F.count(F.lit(1)).alias("neighbours"), F.sum("shared").alias("shared"), best.alias("best"))
    named = communities(edges).withColumnRenamed("node", "subreddit")
    zero: Column = F.lit(0).cast("long")
    return own.join(around, "subreddit", "left").join(named, "subreddit", "left").select(
        "subreddit", "authors", F.coalesce("neighbours", zero).alias("neighbours"),
        F.coalesce("shared", zero).alias("shared"), F.col("best.other").alias("strongest"),
        F.coalesce("community", "subreddit").alias("community"))


def kept(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read back."""
    path = shared_scratch(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
