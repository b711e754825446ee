"""Text operators against plain versions, on the given tables and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hearsay.llm import bpe_rounds, code_language, pair_ranking, rans_ids, simhash_trie, trie_counts
from hearsay.llm.queries import queries
from hearsay.session import shared_scratch

ODD = [None, "", " \n\t", "word", "Two WORDS", "a\x1cb c", "Σίσυφος ΟΔΟΣ", "1234 !!! ???", "don't I'LL",
       "<|endoftext|>", "a <|startoftext|>B", "é é　x", "日本語 😀😀", "x" * 3000, "aaa " * 5000,
       "\n a\n\n  b ", "ﬁ ŉ ß ẞ", "same text here twice", "same text here twice"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None, "clash", 1.0) for i, t in enumerate(ODD)]
    rows += [(None, "no id", None, "s", "x", 2.0), (3, "word", "en", "s", "x", 3.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string, n double")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


# -- SimHash --------------------------------------------------------------------------------

def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_groups(prints, budget):
    """Smallest id reachable, by comparing all pairs."""
    ids, root = sorted(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= budget:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ODD)
def test_fingerprint_is_the_plain_one(text):
    assert simhash_trie.fingerprint(text) == plain_fingerprint(text)


def test_simhash_query_is_all_pairs(spark, sf_dir, docs):
    prints = {i: plain_fingerprint(t) for i, t in texts_of(docs).items()}
    groups = plain_groups(prints, 2)
    got = queries()["op3_simhash_trie"](spark, sf_dir).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {
        (i, f"{p:016x}", groups[i]) for i, p in prints.items()}
    assert len(got) == docs.count()


@pytest.mark.parametrize("leaf_rows", [1, 3, 50])
def test_trie_walk_needs_no_large_leaves(spark, leaf_rows):
    draw, values = random.Random(leaf_rows), set()
    while len(values) < 120:
        value = draw.choice([0, 2**64 - 1, 0x0123456789ABCDEF])
        for _ in range(draw.randrange(7)):
            value ^= 1 << draw.randrange(64)
        values.add(value)
    signed = {v: v - 2**64 if v >> 63 else v for v in values}
    fps = spark.createDataFrame([(s,) for s in signed.values()], "fp long")
    links = [(r["a"], r["b"]) for r in simhash_trie.trie_links(fps, 2, leaf_rows).collect()]
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a % 2**64), find(b % 2**64)))
        root[y] = x
    plain = plain_groups({v: v for v in values}, 2)
    assert {v: find(v) for v in values} == plain


def test_simhash_of_odd_and_no_rows(odd):
    got = simhash_trie.near_groups(odd).collect()
    assert len(got) == odd.count()
    zero = {r["id"] for r in got if r["fp"] == 0}
    assert {0, 1, 2} <= zero
    assert {r["group"] for r in got if r["id"] in (17, 18)} == {17}
    assert simhash_trie.near_groups(odd.limit(0)).count() == 0
    kept = simhash_trie.one_per_group(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(3) == 1 and 18 not in ids and None in ids


# -- quality and language -------------------------------------------------------------------

def test_quality_ranks_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = queries()["op4_quality_ranking"](spark, big)
    assert got.count() == spark.read.parquet(f"{big}/documents.parquet").count()
    marked = got.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in marked)
    assert np.mean([r["predicted"] == r["quality"] for r in marked]) > 0.95


def test_held_out_labels_do_not_matter(docs, labels):
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality"))
                                .otherwise(F.col("quality")))
    a, b = (pair_ranking.fit(docs, x) for x in (labels, flipped))
    assert np.array_equal(a.weights, b.weights) and a.threshold == b.threshold


def test_quality_of_odd_and_no_rows(odd, labels):
    got = pair_ranking.classify(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert pair_ranking.classify(odd.limit(0), labels).count() == 0
    assert pair_ranking.classify(odd, labels.limit(0)).filter("predicted = 1").count() == odd.count()
    assert pair_ranking.keep_good(odd, labels.limit(0)).columns == odd.columns


def test_language_of_held_out_documents(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    got = queries()["op6_language_codes"](spark, big)
    rows = got.join(spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]) > 0.97
    assert {r["held_out"] for r in rows} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)


def test_language_of_odd_and_no_rows(odd):
    got = {r["doc_id"]: r for r in code_language.identify(odd).collect()}
    for i in (0, 1, 2, 7):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[4]["lang_pred"] == "en"  # the only language there is
    assert code_language.identify(odd.limit(0)).count() == 0
    none = code_language.identify(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert code_language.keep_identified(odd).columns == odd.columns


@pytest.mark.parametrize("n", [1, 2, 4, 6, 9, 40])
def test_codewords_differ(n):
    code = code_language.codewords(n)
    assert len({tuple(r) for r in code.tolist()}) == n


# -- tokens ---------------------------------------------------------------------------------

def library(path):
    out = Tokenizer.from_file(path)
    out.no_padding()
    out.no_truncation()
    return out


@hyp(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_word_bpe_is_the_library(text):
    own, lib = bpe_rounds.load(bpe_rounds.default_file()), library(bpe_rounds.default_file())
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode([text])[0].tolist() == ids
    assert own.decode(np.array(ids, "u4")) == lib.decode(ids, skip_special_tokens=False)


def test_word_bpe_query_is_the_library(spark, sf_dir, docs):
    lib, want = library(bpe_rounds.default_file()), {}
    for i, t in texts_of(docs).items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = queries()["op8_bpe_rounds"](spark, sf_dir).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_word_bpe_of_odd_rows(odd):
    lib = library(bpe_rounds.default_file())
    got = bpe_rounds.encode(odd, keep=("doc_id", "text", "score")).collect()
    assert len(got) == odd.count()
    for r in got:
        assert r["ids"] == lib.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe_rounds.encode(odd.limit(0)).count() == 0


@hyp(max_examples=40, deadline=None)
@given(st.integers(0, 70_000), st.integers(1, 60_000), st.integers(0, 99))
def test_segments_round_trip(n, kinds, seed):
    ids = np.random.default_rng(seed).zipf(1.3, n).astype("u8") % kinds
    data = rans_ids.pack(ids.astype("u4"))
    assert np.array_equal(rans_ids.unpack(data), ids)


def test_blocks_stand_alone_and_damage_is_seen():
    ids = np.arange(150_000, dtype="u4") % 777
    data = rans_ids.pack(ids)
    assert np.array_equal(rans_ids.unpack(data, only=1), ids[65536:131072])
    broken = bytearray(data)
    broken[-2000] ^= 1
    with pytest.raises(ValueError):
        rans_ids.unpack(bytes(broken))


def plain_id_rows(texts):
    lib, start, out = library(rans_ids.default_file()), 0, {}
    for i, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_rans_query_reads_back_what_the_library_gives(spark, sf_dir, docs):
    got = queries()["op7_rans_ids"](spark, sf_dir).collect()
    want = plain_id_rows(sorted(texts_of(docs).items()))
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)


def test_rans_of_odd_and_no_rows(spark, odd):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    path = shared_scratch(spark, "rans-test")
    rans_ids.segments(rows).write.parquet(path)
    got = rans_ids.read_back(spark.read.parquet(path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == plain_id_rows(sorted(texts_of(rows).items()))
    empty = shared_scratch(spark, "rans-test")
    rans_ids.segments(odd.limit(0)).write.parquet(empty)
    assert rans_ids.read_back(spark.read.schema(rans_ids.SEGMENT_SCHEMA).parquet(empty)).count() == 0
    assert rans_ids.segments(odd).agg(F.sum(F.size("doc_ids"))).first()[0] == odd.count()


def plain_unigram(word, pieces, missing):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            score = pieces.get(word[start:end])
            n = 1
            if score is None and end - start == 1:
                score, n = missing, len(word[start:end].encode())
            if score is not None:
                new = best[start][0] + score
                if best[end] is None or new > best[end][0]:
                    best[end] = (new, best[start][1] + n)
    return best[-1][1], best[-1][0]


@hyp(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé", min_size=1, max_size=12), max_size=30), st.integers(0, 99))
def test_trie_scores_are_the_plain_ones(words, seed):
    draw = random.Random(seed)
    pieces = {"".join(draw.choice("abc") for _ in range(draw.randrange(1, 5))): -float(draw.randrange(1, 9))
              for _ in range(12)}
    model, words = trie_counts.Unigram(pieces), sorted(set(words))
    assert model.count(words) == [plain_unigram(w, pieces, model.missing) for w in words]


def test_token_count_query_is_the_plain_one(spark, sf_dir, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=trie_counts.default_file())
    pieces = {lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size())
              if not (lib.is_unknown(i) or lib.is_control(i) or lib.is_byte(i) or lib.is_unused(i))}
    missing, seen, want = min(pieces.values()) - 10, {}, {}
    for i, t in texts_of(docs).items():
        words = (t or "").split()
        for w in words:
            if w not in seen:
                seen[w] = plain_unigram("▁" + w, pieces, missing)[0]
        want[i] = (len(words), sum(seen[w] for w in words))
    got = queries()["op5_trie_counts"](spark, sf_dir).collect()
    assert {r["doc_id"]: (r["n_pretokens"], r["n_tokens"]) for r in got} == want and len(got) == len(want)


def test_token_counts_of_odd_and_no_rows(odd):
    got = {r["doc_id"]: r for r in trie_counts.token_counts(odd).collect()}
    assert [got[i]["n_tokens"] for i in (0, 1, 2)] == [0, 0, 0] and got[14]["n_pretokens"] == 5000
    assert trie_counts.token_counts(odd.limit(0)).count() == 0


@pytest.mark.parametrize("top", [1, 70_000, rans_ids.TABLE - 1, rans_ids.TABLE, 2**32 - 1])
def test_ids_are_numbered_and_coded_in_32_bits(top):
    ids = np.array([top, 0, top, 5, 0, 0, top // 2] * 12_000, "u4")
    symbols, freq = rans_ids.frequencies(ids)
    assert np.array_equal(rans_ids._numbers(symbols, ids), np.searchsorted(symbols, ids))
    low = np.cumsum(freq, dtype="u4") - freq
    (block,) = rans_ids._encode(rans_ids._numbers(symbols, ids)[None, :1000], freq, low)
    owner = np.repeat(np.arange(len(symbols)), freq)
    got = rans_ids._decode([block], 1000, symbols[owner], freq[owner], np.arange(1 << 16, dtype="u4") - low[owner])
    assert got.dtype == np.dtype("u4") and np.array_equal(got[0], ids[:1000])
    assert np.array_equal(rans_ids.unpack(rans_ids.pack(ids)), ids)
