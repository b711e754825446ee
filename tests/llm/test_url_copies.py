"""Copies of one URL leave room for the others in the sample of the URL trees."""

from pyspark.sql import functions as F

from hearsay.llm import url_trees

RULES = (("block", "bad.example", "/"), ("allow", "good.example", "/"))


def test_copies_of_a_url_do_not_fill_the_sample(spark):
    urls = [f"http://bad.example/x/y/z/{i}?a={i}&b={i * 7}&c=1" for i in range(60)]
    urls += [f"http://good.example/{'abcdefg'[i % 7] * (1 + i // 7)}" for i in range(60)]
    first = (spark.createDataFrame([(u,) for u in urls], "url string")
             .orderBy(F.xxhash64("url")).first()["url"])
    urls += [first] * 200
    open_ = ["http://other.example/x/y/z/3?a=4&b=28&c=1", "http://other.example/aaa"]
    pages = spark.createDataFrame(list(enumerate(urls + open_)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_trees.judge(pages, RULES, sample=100).collect()}
    assert len(got) == len(urls) + 2
    bad, good = got[len(urls)], got[len(urls) + 1]
    assert bad["rule"] is None and good["rule"] is None and bad["score"] > good["score"]
