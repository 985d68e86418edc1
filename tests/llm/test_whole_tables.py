"""Operators over whole tables, against expectations written apart from them."""

import __spark_entry__ as entry
from riskloom.llm import decontaminate


def result(spark, sf, name):
    return entry.queries()[name](spark, sf).toPandas()


BLOCKED = [
    "http://m.free-bets.example.net/fr/1", "https://ADS-TRACK.example.com/en/2#top", "http://blog.adult-x.example.net/es/3", "http://online-slots.win/a", "http://u@viagra.net:80/", "http://x.shop.net/Casino/play",
    "http://blog.net/wp-login.php?u=1", "http://blog.net/de/Sign-In", "http://blog.net/get/Setup.EXE", "http://blog.net/downloads/", "http://link-farm.net", "http://porn.net/", "http://ads.blog.net/1",
]
ALLOWED = [
    "http://blog.net/en/1", "http://loads-track.net/", "http://adult-education.net/a", "http://padsx.net/", "http://blog.net/downloading", "http://blog.net/a?u=/login", "http://blog.net/x.exempt", "http://farm.net/pill",
    "http://blog.net/poker.html", "http://blog.net/catalog/essex",
]


def test_general_url_rules(spark, tmp_path):
    urls = BLOCKED + ALLOWED
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = result(spark, str(tmp_path), "op2_url_filters").set_index("page_id").verdict
    assert [u for i, u in enumerate(urls) if got[i] == "block"] == BLOCKED


def test_junk_hosts_of_the_given_pages(spark, sf):
    got = result(spark, sf, "op2_url_filters")
    junk = got.host.str.contains(r"(?:^|[.])(?:casino-win|cheap-pills|spam-farm|free-bets|ads-track|adult-x)[.]")
    free = got.rule.isna()
    assert (junk & free).any() and ((got.verdict == "block") == junk)[free].all()


def test_windows_of_items_without_id(spark):
    bench = spark.createDataFrame([(None, "some words of a test without id"), (1, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x Some words of a test, without id y"), (2, "clean"), (3, "other words")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: (7, [], True), 2: (0, [], False), 3: (2, ["1"], True)}
    assert [r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()] == [2]
