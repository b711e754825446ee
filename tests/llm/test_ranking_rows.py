"""The quality model learns from every labelled row."""

import numpy as np
from pyspark.sql import functions as F

from hearsay.llm import pair_ranking


def test_pairs_hold_every_row():
    good, bad = np.arange(10.0)[:, None], 100 * np.arange(1.0, 4)[:, None]
    diff = pair_ranking.pairs(good, bad)
    assert len(diff) == 10 * pair_ranking.PAIRS
    met = {(round(100 * np.ceil(-d / 100)), round(d + 100 * np.ceil(-d / 100))) for d in diff[:, 0]}
    assert {b for b, _ in met} == {100, 200, 300} and {g for _, g in met} == set(range(10))
    assert len(pair_ranking.pairs(good, bad[:0])) == 0


def test_rows_beyond_any_bound_are_used(spark, monkeypatch):
    """12,000 labelled rows, more than the 8,000 of the sample that was taken before."""
    seen, real = [], pair_ranking.fit_pairs
    monkeypatch.setattr(pair_ranking, "fit_pairs", lambda rows: seen.append(rows.count()) or real(rows))
    n = F.col("id")
    labels = spark.range(12000).select(n.alias("doc_id"), (n % 3 != 0).cast("int").alias("quality"))
    docs = spark.range(12000).select(n.alias("doc_id"), F.when(n % 3 != 0, F.concat(F.lit("plain words in a row "), n)).otherwise(
        F.concat(F.lit("###!!! ### $$$ "), n)).alias("text"))
    model = pair_ranking.fit(docs, labels)
    assert seen == [labels.where("crc32(cast(doc_id as string)) % 5 <> 0").count()]
    got = pair_ranking.scored(docs, model, "doc_id").join(labels, "doc_id")
    assert got.where("predicted <> quality").count() < 12  # the threshold is a quantile
