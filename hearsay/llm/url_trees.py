"""URL filter: rules first, gradient-boosted trees on lexical features for the rest.

Rules name a host and a path prefix and decide the URLs they fit. These URLs are the labelled
ones: from them the trees learn which shapes of URL are blocked, and judge those no rule fits.
Features are binned at quantiles. Trees grow level by level: each level is one aggregate of
gradients by (node, feature, bin) over the sample, of which only these sums reach the driver
(at most nodes x features x bins rows), and the best splits become part of a nested expression.
Scoring is one projection without a shuffle but for the join with the suffix statistics. All of
it is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from hearsay.llm.common import LOWER, UPPER, stored

#: Most labelled URLs the fit reads: those with the smallest hashes.
SAMPLE = 20000
ROUNDS, DEPTH, BINS, RATE, LAMBDA = 10, 3, 16, 0.4, 1.0
FEATURES = ("length", "depth", "digits", "entropy", "params", "host_length", "labels", "hyphens",
            "path_length", "suffix_blocked", "suffix_seen")
#: The given rules: (verdict, host, path prefix).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def rule_name(rule: tuple[str, str, str]) -> str:
    return rule[1] + rule[2]


def with_rules(urls: DataFrame, rules=RULES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (the longest that fits, else null) and ``ruled`` (its
    verdict) to a frame with a ``url`` column."""
    out = urls.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    longest = sorted(rules, key=lambda r: (-len(rule_name(r)), rule_name(r)))
    fits = [((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
            for _, h, p in longest]
    none = F.lit(None).cast("string")
    rule = F.coalesce(none, *[F.when(f, F.lit(rule_name(r))) for f, r in zip(fits, longest)])
    ruled = F.coalesce(none, *[F.when(f, F.lit(r[0])) for f, r in zip(fits, longest)])
    return out.withColumn("rule", rule).withColumn("ruled", ruled)


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")),
                       lambda c: (n - F.length(F.replace(text, c, F.lit("")))))
    held = F.aggregate(F.filter(each, lambda k: k > 0), F.lit(0.0), lambda acc, k: acc + k * F.log2(k))
    return F.when(n > 0, F.log2(n) - held / n).otherwise(0.0)


def _suffix(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def suffix_statistics(labelled: DataFrame) -> DataFrame:
    """(suffix, suffix_blocked, suffix_seen) over the labelled URLs: smoothed share of blocked
    ones and log of their number. Hash aggregates: a hot suffix is a few partial rows."""
    return labelled.groupBy(_suffix(F.col("host")).alias("suffix")).agg(
        ((F.sum("blocked") + 1.0) / (F.count("*") + 2.0)).alias("suffix_blocked"),
        F.log1p(F.count("*")).alias("suffix_seen"))


def with_features(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Add the columns ``FEATURES`` to a frame with ``url``, ``host`` and ``path``. A null url has
    the features of an empty one; an unseen suffix counts as half blocked and never seen."""
    url = F.coalesce("url", F.lit(""))
    size = F.length(url).cast("double")
    own = {
        "length": size, "depth": F.regexp_count("path", F.lit("/")).cast("double"),
        "digits": F.regexp_count(url, F.lit("[0-9]")) / F.greatest(size, F.lit(1.0)),
        "entropy": _entropy(url), "params": F.regexp_count(url, F.lit("[?&][^?&#=]+=")).cast("double"),
        "host_length": F.length("host").cast("double"),
        "labels": F.regexp_count("host", F.lit(r"\.")).cast("double"),
        "hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
        "path_length": F.length("path").cast("double"),
    }
    kept = [c for c in urls.columns if c not in FEATURES]
    out = urls.select(*kept, *[c.alias(k) for k, c in own.items()], _suffix(F.col("host")).alias("_suffix"))
    out = out.join(suffixes, out["_suffix"] == suffixes["suffix"], "left")
    return out.select(*kept, *own, F.coalesce("suffix_blocked", F.lit(0.5)).alias("suffix_blocked"),
                      F.coalesce("suffix_seen", F.lit(0.0)).alias("suffix_seen"))


@dataclass
class Node:
    """A split (feature number, last bin to the left) or a leaf value."""

    value: float = 0.0
    split: tuple[int, int] | None = None
    kids: list["Node"] = field(default_factory=list)

    def expr(self) -> Column:
        if self.split is None:
            return F.lit(self.value)
        f, b = self.split
        return F.when(F.col("bins")[f] <= b, self.kids[0].expr()).otherwise(self.kids[1].expr())

    def number(self, at: int = 1) -> Column:
        """The number of the leaf a row falls into: 1 at the root, then 2k and 2k + 1."""
        if self.split is None:
            return F.lit(at)
        f, b = self.split
        return F.when(F.col("bins")[f] <= b, self.kids[0].number(2 * at)).otherwise(
            self.kids[1].number(2 * at + 1))


@dataclass
class Trees:
    """A fitted model: bin edges, the score of the labelled share, and the trees."""

    edges: list[list[float]]
    start: float
    trees: list[Node]

    def bins(self) -> Column:
        one = [sum([(F.col(f) > e).cast("int") for e in edges], F.lit(0)) for f, edges in zip(FEATURES, self.edges)]
        return F.array(*one)

    def margin(self) -> Column:
        return sum([t.expr() for t in self.trees], F.lit(self.start))


def fit(labelled: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH) -> Trees:
    """Fit on rows of ``FEATURES`` and ``blocked`` (0 or 1), with a ``weight`` or of weight 1.

    With labels of one kind, or none, there are no trees and every URL gets the labelled share
    (smoothed by one of each kind).
    """
    cuts = [i / BINS for i in range(1, BINS)]
    if "weight" not in labelled.columns:
        labelled = labelled.withColumn("weight", F.lit(1))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    head = labelled.agg(total("weight").alias("n"), total(F.col("blocked") * F.col("weight")).alias("k"),
                        *[F.percentile_approx(f, cuts, 1000).alias(f) for f in FEATURES]).first()
    n, k = int(head["n"]), int(head["k"])
    model = Trees([sorted(set(head[f] or [])) for f in FEATURES], math.log((k + 1) / (n - k + 1)), [])
    if k in (0, n):
        return model
    grouped = stored(labelled.select(model.bins().alias("bins"), "blocked", "weight")
                     .groupBy("bins", "blocked").agg(F.sum("weight").alias("weight")), "url-bins")
    for _ in range(rounds):
        chance = 1 / (1 + F.exp(-model.margin()))
        rows = grouped.select("bins", ((F.col("blocked") - chance) * F.col("weight")).alias("pull"),
                              (chance * (1 - chance) * F.col("weight")).alias("mass"))
        root, open_nodes = Node(), {}
        for level in range(depth):
            sums = (rows.select(root.number().alias("node"), "pull", "mass", F.posexplode("bins").alias("f", "bin"))
                    .groupBy("node", "f", "bin").agg(F.sum("pull").alias("g"), F.sum("mass").alias("h")).collect())
            open_nodes = open_nodes or {1: root}
            open_nodes = _split(open_nodes, sums, last=level == depth - 1)
            if not open_nodes:
                break
        model.trees.append(root)
    return model


def _split(open_nodes: dict[int, Node], sums: list, last: bool) -> dict[int, Node]:
    """Split each open node where that helps most; the new leaves, by number."""
    table: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for r in sums:
        table.setdefault(r["node"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
    made: dict[int, Node] = {}
    worth = lambda g, h: g * g / (h + LAMBDA)
    for number, node in open_nodes.items():
        best = (1e-6, None)
        for f, bins in sorted(table.get(number, {}).items()):
            g, h = (sum(v[i] for v in bins.values()) for i in (0, 1))
            node.value = RATE * g / (h + LAMBDA)
            left_g = left_h = 0.0
            for b in sorted(bins)[:-1]:
                left_g, left_h = left_g + bins[b][0], left_h + bins[b][1]
                gain = worth(left_g, left_h) + worth(g - left_g, h - left_h) - worth(g, h)
                if gain > best[0]:
                    best = (gain, (f, b, left_g, left_h, g, h))
        if best[1] is not None:
            f, b, left_g, left_h, g, h = best[1]
            node.split = (f, b)
            node.kids = [Node(RATE * left_g / (left_h + LAMBDA)),
                         Node(RATE * (g - left_g) / (h - left_h + LAMBDA))]
            made |= {2 * number: node.kids[0], 2 * number + 1: node.kids[1]}
    return {} if last else made


def judge(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of ``pages``.

    ``verdict`` is the rule's where one fits, else ``block`` if the trees' ``score`` is over one
    half, else ``allow``. A null url, or one without ``://``, has an empty host and path, fits no
    rule and is judged by its shape. Repeated urls get the same answer; other columns are
    ignored; an empty table gives an empty result.
    """
    ruled = with_rules(pages.select("page_id", "url"), rules)
    labelled = (ruled.filter(F.col("ruled").isNotNull())
                .select("url", "host", "path", (F.col("ruled") == "block").cast("int").alias("blocked")))
    suffixes = stored(suffix_statistics(labelled), "suffixes")
    distinct = labelled.groupBy("url", "host", "path", "blocked").agg(F.count("*").alias("weight"))
    chosen = distinct.orderBy(F.xxhash64("url"), "url").limit(sample)
    model = fit(stored(with_features(chosen, suffixes).select(*FEATURES, "blocked", "weight"), "url-sample"))
    rows = with_features(ruled, suffixes).withColumn("bins", model.bins())
    rows = rows.withColumn("score", 1 / (1 + F.exp(-model.margin())))
    verdict = F.coalesce("ruled", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
