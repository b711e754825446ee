"""Near copies of the pipeline against brute-force Jaccard over five-word shingles."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as cp
from hearsay.llm import shingle_copies, simhash_trie


def plain_shingles(text):
    words = (text or "").encode("utf-8", "replace").lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(texts):
    """Smallest ids of the groups of pairs at 0.8 or more, and all such pairs."""
    ids, sets, root = sorted(texts), {i: plain_shingles(t) for i, t in texts.items()}, {}

    def find(i):
        while root.get(i, i) != i:
            i = root[i]
        return i

    pairs = []
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if 5 * len(a & b) >= 4 * len(a | b):
                pairs.append((j, i))
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {find(i) for i in ids}, pairs


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"edit{rng.randrange(10**6)}"
    return out


def written(seed=5):
    """Short and long texts with copies on both sides of 0.8, and awkward rows."""
    rng, texts = random.Random(seed), []
    for n in [6, 8, 12, 25, 40, 60, 90, 150, 300] * 8:
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        texts += [" ".join(base)] + [" ".join(edited(rng, base, max(1, round(n * share))))
                                     for share in (0, 0.01, 0.02, 0.03, 0.05)]
        texts += [" ".join(base + ["one", "more", "word"][:k]) for k in (1, 2, 3)]
    return [*texts, None, "", " \n", "word", "WORD", "two words"]


def test_stage_is_brute_force_jaccard(spark):
    texts = dict(enumerate(written()))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept, pairs = plain_kept(texts)
    assert len(pairs) > 500
    out = [r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()]
    assert len(out) == len(set(out)) and set(out) == kept


def test_large_groups_are_compared_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_copies, "BLOCK_ROWS", 4)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    texts = {i: " ".join(edited(rng, base, 1 + i % 4)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"] for r in cp.near_duplicates(spark, docs, "").collect()}
    assert out == plain_kept(texts)[0]


def test_groups_of_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, _ = plain_kept({r["doc_id"]: r["text"] for r in docs.collect()})
    assert {r["doc_id"] for r in cp.near_duplicates(spark, docs, sf_dir).collect()} == kept


def roots(n, links):
    """Smallest number that links lead to, for each below ``n``."""
    root = list(range(n))
    for i, j in links:
        x, y = sorted((root[i], root[j]))
        root = [x if r == y else r for r in root]
    return root


def test_candidates_come_from_the_trie_join(spark):
    """Those whose fingerprints of one kind differ in one bit at most, and no others."""
    sets = {shingle_copies.shingles(t).tobytes(): shingle_copies.shingles(t) for t in written(9) if plain_shingles(t)}
    found = [shingle_copies.prints(s) for s in sets.values()]
    kinds = np.array(found).view("u8")
    assert (kinds[:, -1] & np.uint64((1 << 56) - 1) == [simhash_trie.majority(s) >> 8 for s in sets.values()]).all()
    near = [(i, j, d) for j in range(len(kinds)) for i in range(j)
            for d in [int(np.bitwise_count(kinds[i] ^ kinds[j]).min())] if d <= 1]
    whole = roots(len(kinds), [(i, j) for i, j, _ in near])
    assert whole != roots(len(kinds), [(i, j) for i, j, d in near if not d])  # one bit finds more than equality
    classes = spark.createDataFrame([(n, f.tolist()) for n, f in enumerate(found)], "cls long, prints array<long>")
    out = {r["node"]: r["root"] for r in shingle_copies.candidate_groups(classes).collect()}
    assert [out.get(n, n) for n in range(len(kinds))] == whole


def test_prefixes_have_tries_of_their_own(spark):
    rng = random.Random(2)
    low = [rng.getrandbits(56) for _ in range(300)]
    values = [(kind << 56) | (v ^ flip) for v in low for kind, flip in ((0, 0), (1, 0), (1, 1 << rng.randrange(56)))]
    fps = spark.createDataFrame([(v,) for v in set(values)], "fp long")
    for leaf_rows in (40, 1 << 18):
        links = {tuple(sorted(r)) for r in simhash_trie.trie_links(fps, 1, leaf_rows, 8).collect()}
        assert links == {tuple(sorted(values[i:i + 2])) for i in range(1, len(values), 3)}
