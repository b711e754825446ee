"""Scorers that learn, against held-out texts, word lists and plain arithmetic."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hearsay.checks.queries import VERDICTS, _marked, queries
from hearsay.operators import insights as ins
from hearsay.scoring import enrich
from hearsay.scoring.fitted import FittedScorer, choosing_fold, fit, fit_best, load_model, save_model
from hearsay.scoring.word_table import counted_words, learn_words, score_words
from hearsay.session import shared_scratch
from hearsay.sources.sample_posts import tone_of_documents

LARGER = "/root/testdata/sf0.1"


def f1_of_toxic(quality):
    return {r["label"]: r["f1"] for r in quality.collect()}.get("toxic") or 0.0


def test_fitted_model_beats_the_word_list_on_held_out_texts(spark):
    """Some 700 held-out texts, of which a seventh is toxic."""
    fitted = f1_of_toxic(queries()["fitted_quality"](spark, LARGER))
    held = _marked(spark, LARGER).where("held_out").withColumns(
        {"title": F.col("text"), "selftext": F.lit(None).cast("string")})
    listed = enrich(held, [tone_of_documents()])
    assert fitted > 0.6 > 0.45 > f1_of_toxic(ins.scorer_quality(ins.confusion(listed, "truth", "verdict")))


def test_held_out_texts_teach_nothing(spark, sf_dir):
    marked = _marked(spark, sf_dir)
    learn = lambda df: fit(df.where("NOT held_out"), "text", F.col("truth") == "toxic", "v", VERDICTS, dims=64, rounds=3)
    changed = marked.withColumn("text", F.when(F.col("held_out"), F.lit("idiot")).otherwise(F.col("text")))
    assert learn(marked) == learn(changed)


def test_model_survives_its_table_and_scores_without_python(spark):
    model = FittedScorer("v", "no", "yes", -1.0, tuple(float(i % 3) for i in range(16)))
    path = shared_scratch(spark, "test-model")
    save_model(spark, model, path)
    assert load_model(spark, path) == model
    df = spark.createDataFrame([(1, "one two"), (2, None), (3, " \n"), (4, "one two one"), (5, "...")], "id long, text string")
    out = model.score(df, "text")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    rows = {r["id"]: (r["v"], r["v_confidence"]) for r in out.collect()}
    assert rows[2] == rows[3] == ("no", 0.0) and rows[1] == rows[4]
    assert rows[5] == ("no", round(1 / (1 + math.exp(-1)), 6))
    number = {w: spark.sql(f"SELECT pmod(hash('{w}'), 16)").first()[0] for w in ("one", "two")}
    logit = -1.0 + sum(model.weights[i] for i in set(number.values()))
    chance = 1 / (1 + math.exp(-logit))
    assert rows[1] == ("yes" if chance >= 0.5 else "no", round(max(chance, 1 - chance), 6))


@pytest.mark.parametrize("rows, label", [([("a", "toxic")], "toxic"), ([("a", "clean")], "clean"), ([], "clean")])
def test_one_label_or_no_rows_still_fit(spark, rows, label):
    df = spark.createDataFrame(rows, "text string, truth string")
    model = fit(df, "text", F.col("truth") == "toxic", "v", VERDICTS, dims=8)
    assert model.score(spark.createDataFrame([("b",)], "text string"), "text").first()["v"] == label


def test_penalty_is_chosen_on_texts_its_fit_has_not_seen(spark, sf_dir):
    """F1 of each penalty by plain counting; the winner is fitted to all rows."""
    toxic, small = F.col("truth") == "toxic", {"dims": 256, "rounds": 8}
    marked = _marked(spark, sf_dir).where("NOT held_out").withColumn("inner", choosing_fold(F.col("text"))).persist()
    strengths = (0.5, 0.01)
    model, f1 = fit_best(marked, "text", toxic, "v", VERDICTS, strengths, **small)
    for s in strengths:
        tried = fit(marked.where("NOT inner"), "text", toxic, "v", VERDICTS, strength=s, **small)
        rows = [(r["truth"] == "toxic", r["v"] == "toxic")
                for r in tried.score(marked.where("inner AND truth IS NOT NULL"), "text").collect()]
        both, either = sum(a and b for a, b in rows), sum(a for a, _ in rows) + sum(b for _, b in rows)
        assert f1[s] == pytest.approx(2 * both / max(either, 1))
    best = max(strengths, key=lambda s: (f1[s], s))
    assert model == fit(marked, "text", toxic, "v", VERDICTS, strength=best, **small)
    copies = marked.groupBy("text").agg(F.count_distinct("inner").alias("sides"))
    assert copies.where("sides > 1").isEmpty()
    marked.unpersist()


@pytest.mark.parametrize("rows", [[("a", "toxic")], [("a", None)], [], [("", "clean"), (None, "clean")]])
def test_choosing_takes_one_label_or_no_rows(spark, rows):
    df = spark.createDataFrame(rows, "text string, truth string")
    model, f1 = fit_best(df, "text", F.col("truth") == "toxic", "v", VERDICTS, dims=8)
    assert set(f1.values()) <= {0.0, 1.0}
    assert model.score(spark.createDataFrame([("b",)], "text string"), "text").count() == 1


def test_words_are_counted_where_the_text_is(spark):
    texts = ["b a b", "", None, "...", "A a\na", "one", "x1y x1y"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", counted_words(F.col("text")).alias("w"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: {w["word"]: w["n"] for w in r["w"] or []} for r in df.collect()}
    assert got == {0: {"a": 1, "b": 2}, 1: {}, 2: {}, 3: {}, 4: {"a": 3}, 5: {"one": 1}, 6: {"x": 2, "y": 2}}


def test_fifty_thousand_words_are_joined_not_listed(spark, sf_dir):
    """Weights of 50,000 words; sums against plain arithmetic, by occurrence and once per text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    known = spark.range(50_000).select(F.concat(F.lit("filler"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))
                                       .alias("word"), F.lit("b").alias("label"), F.lit(0.5).alias("weight"))
    common = spark.createDataFrame([("the", "a", 0.25), ("the", "b", 0.125), ("der", "b", 1.5), ("le", "c", -2.0)], known.schema)
    words, labels = known.unionByName(common), ("a", "b", "c")
    rows = docs.collect()
    for distinct in (True, False):
        out = score_words(docs, "doc_id", "text", words, labels, "a", "kind", distinct, {"c": 0.3})
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "INSET" not in plan and len(plan) < 60_000
        got = {r["doc_id"]: (r["kind"], r["kind_confidence"]) for r in out.collect()}
        assert len(got) == len(rows)
        for r in rows:
            text = "".join(ch if ch.isalpha() else " " for ch in (r["text"] or "").lower())
            n = Counter(text.split())
            n = Counter(set(n)) if distinct else n
            logits = [0.25 * n["the"], 0.125 * n["the"] + 1.5 * n["der"], 0.3 - 2.0 * n["le"]]
            if not (r["text"] or "").strip():
                assert got[r["doc_id"]] == ("a", 0.0)
                continue
            top = max(logits)
            assert got[r["doc_id"]][0] == labels[logits.index(top)]
            assert abs(got[r["doc_id"]][1] - 1 / sum(math.exp(x - top) for x in logits)) < 1e-5


def test_learning_ignores_unmarked_and_rare_words(spark):
    rows = [(1, "x y", "t"), (2, "x z", "t"), (3, "x", "f"), (4, "y", None), (5, None, "f")]
    df = spark.createDataFrame(rows, "id long, text string, truth string")
    got = {(r["word"], r["label"]): r["weight"] for r in learn_words(df, "id", "text", "truth").collect()}
    assert set(got) == {("x", "t"), ("x", "f")}
    assert got["x", "t"] == round(math.log((2.5 / 3) / (3.5 / 5)), 6)


def test_choosing_the_penalty_splits_texts_once(spark, monkeypatch):
    """Five fits and their comparison read numbers that were stored once."""
    from hearsay.scoring import fitted
    calls, real = [], fitted.features
    monkeypatch.setattr(fitted, "features", lambda text, dims: calls.append(dims) or real(text, dims))
    df = spark.createDataFrame([(f"w{i} " + ("bad" if i % 3 else "good"), i % 3 > 0) for i in range(60)], "text string, truth boolean")
    model, f1 = fit_best(df, "text", F.col("truth"), "v", VERDICTS, dims=64, rounds=5)
    assert calls == [64] and len(f1) == len(fitted.STRENGTHS) and len(model.weights) == 64
