"""Counts of listed words against Spark's own split."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hearsay.scoring import listed
from hearsay.scoring.lexicon import WORD_SEPARATOR

LISTS = [("this", "a", "été", "wonderful"), ("wonderfully", "wonder", "sign", "a"), (), ("ß", "k", "i", "don't", "Upper", "日本")]
PIECES = ["this", "THIS", "a", "A", "été", "ÉTÉ", "wonderful", "wonderfully", "wonder", "sign", "signs", "ß", "K", "K", "İ", "i",
          "don't", "upper", "日本", "日本語", "𝐀", "😀", "²", "_", "7", "’", "́", " ", " ", "\n", "\0", "-", "[", "`", "{", "@", "Ω", "ΟΔΟΣ"]


def texts(seed=7):
    rng = random.Random(seed)
    return [None, "", " ", *PIECES, *["".join(rng.choices(PIECES, k=rng.randrange(1, 30))) for _ in range(3000)],
            "this " * 30000]


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_counts_are_those_of_the_split_text(spark, monkeypatch, size):
    df = spark.createDataFrame(list(enumerate(texts())), "n long, text string").repartition(2)
    monkeypatch.setattr(listed, "SLICE", size)
    split = F.split(F.lower("text"), WORD_SEPARATOR)

    def number(own):
        return F.coalesce(F.size(F.filter(split, lambda w: w.isin(list(own)))), F.lit(0))

    plain = F.array(*map(number, LISTS))
    rows = df.select("n", "text", listed.count_listed(F.col("text"), LISTS).alias("found"),
                     F.when(F.col("text").isNull(), F.array(*[F.lit(0)] * len(LISTS))).otherwise(plain).alias("plain")).collect()
    assert [r for r in rows if r["found"] != r["plain"]] == []
    assert sum(map(sum, (r["found"] for r in rows))) > 30000


def test_slices_do_not_join_texts(monkeypatch):
    given = pa.array(["x", "th", "is", "", None, "this", "é", "this", "a"])
    finder = listed.Finder([b"a", b"this"])
    for size in (1, 3, 100):
        monkeypatch.setattr(listed, "SLICE", size)
        assert finder.counts(given)[1:].tolist() == finder.counts(given[1:]).tolist()
        assert finder.counts(given).sum(1).tolist() == [0, 0, 0, 0, 0, 1, 0, 1, 1]


def test_no_listed_word(spark):
    df = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [r[0] for r in df.select(listed.count_listed(F.col("text"), [(), ()])).collect()] == [[0, 0], [0, 0]]
