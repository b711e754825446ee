"""Vector operators, URL trees, mixing and components against plain versions."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from hearsay.llm import column_scan, components, multi_index, split_tree, url_trees
from hearsay.llm.queries import queries
from hearsay.llm.vectors import unit


# -- components -----------------------------------------------------------------------------

def plain_roots(links):
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


@pytest.mark.parametrize("links", [
    [], [(5, 5)], [(i + 1, i) for i in range(60)], [(0, i) for i in range(1, 80)],
    [(3, 1), (1, 3), (9, 8), (8, 3), (20, 21), (-4, 21)],
    [(random.Random(1).randrange(90) ^ i, i) for i in range(90)],
])
def test_components_are_the_plain_ones(spark, links):
    got = components.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == plain_roots(links) and len(got) == len(plain_roots(links))


@pytest.mark.parametrize("hub", [3, 1 << 17])
def test_components_of_hubs_and_many_batches(spark, monkeypatch, hub):
    """Stars around a small, a middle and a large node, chains between them, and random links; batches
    of seven rows, so that groups span several."""
    monkeypatch.setattr(components, "HUB", hub)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rng = random.Random(hub)
        links = [(0, i) for i in range(100, 160)] + [(1000, i) for i in range(200, 260)] + [(500, 400 + i) for i in range(200)]
        links += [(i, i + 1) for i in range(2000, 2100)] + [(rng.randrange(3000, 3100), rng.randrange(3000, 3100)) for _ in range(70)]
        links += [(155, 2050), (255, 2099)] + links[:50]
        rng.shuffle(links)
        got = components.components(spark.createDataFrame(links, "a long, b long").repartition(3)).collect()
        assert {r["node"]: r["root"] for r in got} == plain_roots(links) and len(got) == len(plain_roots(links))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_links_are_computed_once(spark):
    """What the links come from, such as all comparisons, runs once; nodes with a self-link alone stay."""
    links, rows = [(i + 1, i) for i in range(40)] + [(77, 77)], spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    found = spark.createDataFrame(links, "a long, b long").mapInArrow(each, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(found).collect()}
    assert got == plain_roots(links) and rows.value == len(links)


@hyp(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=60))
def test_components_of_any_links(links):
    from pyspark.sql import SparkSession
    session = SparkSession.getActiveSession()
    got = components.components(session.createDataFrame(links, "a long, b long").coalesce(2)).collect()
    assert {r["node"]: r["root"] for r in got} == plain_roots(links)


# -- vectors --------------------------------------------------------------------------------

def awkward_vectors(spark):
    draw = np.random.default_rng(3)
    base, rows = draw.normal(size=(6, 8)), []
    for i in range(120):
        v = base[i % 6] + draw.normal(size=8) * 0.25
        rows.append((i, v.tolist(), i % 2))
    rows += [(200 + i, rows[0][1], 0) for i in range(30)]  # copies of one vector
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [None] * 8, 0),
             (304, [], 0), (305, [1.0, 2.0], 0), (306, rows[1][1], None), (None, rows[0][1], 0),
             (350, [float("inf")] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit("clash"))


def plain_vectors(rows, least):
    usable = [r for r in rows if r["vec_id"] is not None and r["label"] is not None and r["embedding"]
              and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    links = []
    for i, a in enumerate(usable):
        for b in usable[:i]:
            if a["label"] == b["label"] and len(a["embedding"]) == len(b["embedding"]):
                x, y = np.array(a["embedding"], "f8"), np.array(b["embedding"], "f8")
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links.append((a["vec_id"], b["vec_id"]))
    return Counter(v for ab in links for v in ab), plain_roots(links)


def check_vectors(df, got, least):
    count, root = plain_vectors(df.collect(), least)
    assert got.count() == df.count()
    for r in got.collect():
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == (count.get(i, 0), root.get(i, i)), i
        assert r["kept"] == (i == r["component_id"])


@pytest.mark.parametrize("recall", [0.9999, None])
def test_vector_links_are_all_pairs(spark, recall):
    df = awkward_vectors(spark)
    check_vectors(df, multi_index.near_vectors(df, 0.93, recall), 0.93)


def test_vector_query_is_all_pairs(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    check_vectors(df, queries()["op2_multi_index"](spark, sf_dir), 0.93)


def test_vectors_of_no_rows(spark):
    none = awkward_vectors(spark).limit(0)
    assert multi_index.near_vectors(none).count() == 0
    assert column_scan.nearest(none).count() == 0


@hyp(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 5), min_size=1, max_size=9), st.lists(st.floats(0, 5), min_size=1, max_size=9), st.floats(0, 8))
def test_traversal_visits_every_cell_in_order(a, b, stop):
    a, b = sorted(a), sorted(b)
    met = list(multi_index.traverse(a, b, stop))
    assert set(met) == {(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] + b[j] <= stop}
    sums = [a[i] + b[j] for i, j in met]
    assert sums == sorted(sums) and len(met) == len(set(met))


def plain_nearest(rows, every, k):
    found = {}
    usable = [(r["vec_id"], np.array(r["embedding"], "f8")) for r in rows
              if r["vec_id"] is not None and r["embedding"] and len(r["embedding"]) == len(rows[0]["embedding"])
              and all(x is not None and np.isfinite(x) for x in r["embedding"]) and any(r["embedding"])]
    for i, x in usable:
        if i % every == 0:
            near = [(-round(float(x @ y / np.sqrt((x @ x) * (y @ y))), 12), j) for j, y in usable if j != i]
            found[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return found


def test_nearest_query_finds_nine_in_ten(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want, got = plain_nearest(rows, 50, 5), {}
    for r in queries()["op10_column_scan"](spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert want.keys() == got.keys() and all(len(v) == 5 for v in got.values())
    assert np.mean([len({j for j, _ in want[i]} & {j for j, _ in got[i]}) / 5 for i in want]) >= 0.95
    exact = {(i, j): s for i in want for j, s in plain_nearest(rows, 50, 10**6)[i]}
    assert all(abs(exact[i, j] - s) < 1e-9 for i in got for j, s in got[i])


def test_nearest_with_copies_and_few_rows(spark):
    df = awkward_vectors(spark)
    rows = df.collect()
    got = {}
    for r in column_scan.nearest(df, every=20, k=5, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = {i: [j for j, _ in v] for i, v in plain_nearest(rows, 20, 5).items()}
    assert got.keys() == want.keys()
    assert got[0] == want[0] == [200, 201, 202, 203, 204]
    assert np.mean([got[i] == want[i] for i in want]) > 0.85
    few = df.filter("vec_id < 4")
    assert [r["vec_id"] for r in column_scan.nearest(few, every=50, k=5).orderBy("rank").collect()].__len__() == 3


# -- URLs -----------------------------------------------------------------------------------

URLS = ["https://Example.ORG/es/x?a=1", "http://example.org/en/1", "http://example.org/en/2", "x://sub.example.org/en/19",
        "https://a.com/fr/", "https://a.com/de/q#y", "https://notcom/fr/", "http://a.net/x", "no scheme", "", None,
        "http://example.org", "http://org/", "https://x.com?u=http://y.org/", "a://b://c.org/es/", "http://com/de/" + "z" * 4000,
        "http://www.ÄÖ.org/é", "https://a.com/fr", "https://a.com/fr/", "http://exampleXorg/es/"]


def plain_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, v) for v, h, p in url_trees.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_rules_are_the_plain_ones(spark, sf_dir):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = queries()["op1_url_trees"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        host, path, rule, verdict = plain_rule(dict(pages)[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["score"] > 0.5 else "allow"))


def test_odd_urls_and_no_rows(spark):
    df = spark.createDataFrame([(i, u, "clash", 1.0) for i, u in enumerate(URLS)], "page_id long, url string, host string, length double")
    got = {r["page_id"]: r for r in url_trees.judge(df).collect()}
    for i, u in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == plain_rule(u)[:3], u
        assert got[i]["verdict"] in ("allow", "block") and 0 < got[i]["score"] < 1
    assert url_trees.judge(df.limit(0)).count() == 0
    one = url_trees.judge(df, rules=(("allow", "org", "/"),))
    assert {r["verdict"] for r in one.collect()} == {"allow"}


def test_trees_learn_labelled_shapes(spark):
    """URLs with many parameters are bad; the trees find this out on other URLs than the sample."""
    make = lambda i: f"http://s{i % 50}.net/p{i}" + ("?a=1&b=2&c=3" if i % 3 == 0 else "?a=1" if i % 2 else "")
    df = spark.createDataFrame([(i, make(i)) for i in range(600)], "page_id long, url string")
    split = url_trees.with_rules(df, ()).withColumn("blocked", (F.col("page_id") % 3 == 0).cast("int"))
    train = split.filter("page_id < 400")
    stats = url_trees.suffix_statistics(train)
    model = url_trees.fit(url_trees.with_features(train, stats))
    test = url_trees.with_features(split.filter("page_id >= 400"), stats).withColumn("bins", model.bins())
    wrong = test.filter((model.margin() > 0) != (F.col("blocked") == 1))
    assert wrong.count() == 0


# -- mixing ---------------------------------------------------------------------------------

def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3.0 * sizes[s] for s in capped}
        capped |= over


def check_mix(docs, plan):
    texts = [(r["source"], len((r["text"] or "").encode().split())) for r in docs.collect()]
    sizes = Counter()
    for s, n in texts:
        sizes[s] += n
    targets, taken, rows = plain_targets(sizes), Counter(), plan.collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - targets[r["source"]]) < 1e-6 * max(1, r["target"])
        assert len(r["draws"]) <= 3
        taken[r["source"]] += r["size"] * len(r["draws"])
    return sizes, targets, taken, rows


def test_mix_query_meets_targets(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    sizes, targets, taken, rows = check_mix(docs, split_tree.mix_plan(docs))
    assert all(abs(taken[s] - targets[s]) < 0.03 * targets[s] for s in sizes)
    again = queries()["op9_split_tree"](spark, big).collect()
    assert {(r["doc_id"], r["taken"]) for r in again} == {(r["doc_id"], r["size"] * len(r["draws"])) for r in rows}
    held = Counter(s for r in rows for s in r["draws"])
    assert len(held) == 16 and max(held.values()) < 2 * min(held.values())


def test_mix_of_odd_and_no_rows(spark):
    rows = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d " * 50, None), (5, "e f", "y"), (5, "e f", "y"),
            (6, "g", "z"), (None, "h i", "z"), (7, " ", "empty")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("draws", F.lit("clash"))
    check_mix(docs, split_tree.mix_plan(docs))
    mixed = split_tree.mix(docs)
    assert mixed.columns == docs.columns
    counts = Counter(r["doc_id"] for r in mixed.collect())
    assert counts[5] % 2 == 0 and max(counts.values()) <= 6
    assert split_tree.mix_plan(docs.limit(0)).count() == 0 and split_tree.mix(docs.limit(0)).count() == 0


def test_shards_are_partitions_and_large_ones_are_cut(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    plan = {r["doc_id"]: Counter(r["draws"]) for r in split_tree.mix_plan(docs, shards=4).collect()}
    for task_words, pieces in ((1 << 22, 1), (25_000, None)):
        mixed = split_tree.mix(docs, shards=4, task_words=task_words)
        parts = mixed.select("doc_id", "text", F.spark_partition_id().alias("p")).collect()
        by = {p: [r for r in parts if r["p"] == p] for p in range(mixed.rdd.getNumPartitions())}
        assert all(by.values()) and (pieces is None or len(by) == 4 * pieces)
        sizes, each = [words(v) for v in by.values()], len(by) // 4
        assert max(sizes) < 2 * sum(sizes) / len(sizes)
        for p, rows in by.items():  # disjoint shards, in the order of their parts
            assert all(plan[r["doc_id"]][p // each] > 0 for r in rows)
        assert Counter(r["doc_id"] for r in parts) == Counter({d: sum(c.values()) for d, c in plan.items() if c})


def test_hypergeometric_draws_follow_the_law(spark):
    n, marked, drawn = 60, 25, 20
    df = spark.range(20000).select(split_tree.hypergeometric(
        split_tree._uniform(F.col("id")), F.lit(n).cast("long"), F.lit(marked).cast("long"), F.lit(drawn).cast("long")).alias("x"))
    got = df.agg(F.avg("x"), F.var_samp("x"), F.min("x"), F.max("x")).first()
    mean = drawn * marked / n
    assert abs(got[0] - mean) < 0.05
    assert abs(got[1] - mean * (1 - marked / n) * (n - drawn) / (n - 1)) < 0.15
    assert 0 <= got[2] and got[3] <= drawn


@pytest.mark.parametrize("quotas, shards", [([7, 0, 100, 3, 1], 8), ([1], 4), ([1000, 999], 16), ([5, 5, 5], 1)])
def test_quotas_split_exactly(spark, quotas, shards):
    rows = [(i, q) for i, q in enumerate(quotas) if q]
    got = split_tree.split_quotas(spark.createDataFrame(rows, "sid int, n long"), shards).collect()
    per_source, per_shard = Counter(), Counter()
    for r in got:
        assert r["n"] > 0
        per_source[r["sid"]] += r["n"]
        per_shard[r["shard"]] += r["n"]
    assert per_source == Counter(dict(rows))
    low = sum(quotas) // shards
    assert all(low <= per_shard[s] <= low + 1 for s in range(shards))


@pytest.mark.parametrize("exponent", [0, 1, 1.5, 2])
@pytest.mark.parametrize("in_label", [12_000, 400_000])
def test_grid_meets_links_of_any_spectrum(exponent, in_label):
    """Pairs just above the threshold, whose differences have the table's own spectrum."""
    rng, n, wide, cosine = np.random.default_rng(1), 6000, 64, 0.933
    scale = np.arange(1, wide + 1) ** (-exponent / 2)
    one = unit(rng.normal(size=(n, wide)) * scale)
    away = rng.normal(size=(n, wide)) * scale
    away -= (away * one).sum(1)[:, None] * one
    two = cosine * one + np.sqrt(1 - cosine ** 2) * unit(away)
    rows = np.concatenate([one, two])
    grid = multi_index.fit_grid(rows[rng.permutation(len(rows))[:4096]], in_label, 0.93)
    assert len(grid.first) >= 10
    own, met = grid.cells(np.concatenate([one[:400], two[:400]]))
    seen = [set(m) for m in met]
    # a pair is met from the smaller of its two cells
    found = [own[i] == own[400 + i] or max(own[i], own[400 + i]) in seen[i if own[i] < own[400 + i] else 400 + i] for i in range(400)]
    assert np.mean(found) >= 0.99
    assert np.mean([len(m) for m in met]) < 0.5 * len(grid.first) ** 2


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=w).tolist()) for i, w in enumerate([8] * 300 + [3] * 40 + [2] * 3 + [1] * 2)]
    rows += [(1000, rows[7][1]), (1050, [1.0, 2.0]), (1100, [0.0, 0.0]), (1150, None), (1200, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"dim": F.lit("clash"), "list": F.lit(0)})
    got = {}
    for r in column_scan.nearest(df, every=5, k=4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    usable = {i: np.array(v) for i, v in rows if v and np.isfinite(v).all() and np.any(v)}
    hits = total = 0
    for q in (i for i in usable if i % 5 == 0):
        same = [(-(v @ usable[q]) / np.linalg.norm(v) / np.linalg.norm(usable[q]), i) for i, v in usable.items()
                if i != q and len(v) == len(usable[q])]
        want = [i for _, i in sorted(same)[:4]]
        found = sorted(got.get(q, []))
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        hits, total = hits + len({i for _, i, _ in found} & set(want)), total + len(want)
        if len(usable[q]) != 8:  # one list: exact
            assert [i for _, i, _ in found] == want
    assert hits >= 0.97 * total and not set(got) & {1100, 1150, 1200}
