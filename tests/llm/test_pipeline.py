"""The pipeline's stages, each against a plain version on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as cp
from hearsay.llm import bpe_rounds, code_language, pair_ranking
from hearsay.llm.common import stored
from tests.llm.test_shingle_copies import plain_kept


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Every stage's input and output."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        after = stored(stage(spark, docs, sf_dir), f"test-{name}")
        out[name] = (docs, after)
        docs = after
    return out


def ids(df):
    return Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_order_and_columns(spark, sf_dir, steps):
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_duplicates", "mixing", "encoding"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in steps.items() if name != "encoding")


def test_quality_keeps_what_is_predicted_good(spark, sf_dir, steps):
    before, after = steps["quality"]
    found = pair_ranking.classify(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(after) == ids(found.filter("score >= 0.3"))
    assert 0 < after.count() < before.count()


def test_language_keeps_what_is_known_and_clear(steps):
    before, after = steps["language"]
    assert ids(after) == ids(code_language.identify(before).filter("lang_pred <> 'und' AND NOT ambiguous"))


def test_one_document_of_each_group_stays(steps):
    before, after = steps["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert ids(after) == Counter(plain_kept(texts)[0])


#: Names that the stages use inside, names with dots, and names of other case.
CLASHES = ["_id", "_key", "_draws", "_shard", "_copy", "_source", "row", "place", "part", "draws", "copy", "score", "predicted",
           "lang_pred", "ambiguous", "c0", "k0", "f", "cls", "fp", "group", "id", "key", "a.b", "`tick", "place.x"]


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_stages_take_columns_of_any_name(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 60")
    stage = dict(cp.STAGES)[name]
    plain = ids(stage(spark, docs, sf_dir))
    wide = docs.withColumns({c: F.concat(F.lit(f"{i}:"), F.col("doc_id").cast("string")) for i, c in enumerate(CLASHES)})
    out = stage(spark, wide, sf_dir)
    assert out.columns == wide.columns
    rows = out.collect()
    assert Counter(r["doc_id"] for r in rows) == plain and plain
    assert all(r[c] == f"{i}:{r['doc_id']}" for r in rows for i, c in enumerate(CLASHES))


def test_mix_takes_whole_documents(steps):
    before, after = steps["mixing"]
    known = {tuple(r) for r in before.collect()}
    assert {tuple(r) for r in after.collect()} <= known
    assert max(ids(after).values()) <= 3


def test_encoding_is_the_library(steps):
    before, after = steps["encoding"]
    lib = Tokenizer.from_file(bpe_rounds.default_file())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        assert r["ids"] == lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["decoded"] == lib.decode(r["ids"], skip_special_tokens=False)
    assert ids(after) == ids(before)


def test_empty_documents_pass_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"empty-{name}")
        assert docs.count() == 0
