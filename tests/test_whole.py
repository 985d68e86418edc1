"""Queries over the whole of their input, against results computed apart from the query and its SQL."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.operators import sketches, vectors


@pytest.fixture(scope="module")
def orders(sf):
    read = lambda t: pd.read_parquet(f"{sf}/{t}.parquet")
    o = read("orders").merge(read("customer"), left_on="o_custkey", right_on="c_custkey").merge(read("nation"), left_on="c_nationkey", right_on="n_nationkey")
    return pd.DataFrame({"country": o.n_name, "day": pd.to_datetime(o.o_orderdate).dt.normalize(), "amount": o.o_totalprice, "status": o.o_orderstatus})


def result(spark, sf, name):
    df = entry.queries()[name](spark, sf).toPandas()
    if "day" in df:
        df["day"] = pd.to_datetime(df["day"])
    return df


def per_day(orders):
    """Scores of run 2 by (country, day)."""
    per = orders.groupby(["country", "day"], as_index=False).agg(n=("amount", "size"), amount=("amount", "sum"))
    return per.assign(prob=1 / (1 + np.exp(-(per.n - 4) / 2.0)))


def close(got, want, *columns):
    both = got.merge(want, on=["country", "day"], suffixes=("", "_w"), validate="1:1")
    assert len(both) == len(got) == len(want)
    for c in columns:
        assert (both[c] - both[f"{c}_w"]).abs().max() < 2e-6


def test_ranks_of_all_days(spark, sf, orders):
    want = per_day(orders)
    by_day = want.groupby("day").prob
    size = by_day.transform("size")
    want["percent_rank"] = ((by_day.rank(method="min") - 1) / (size - 1).where(size > 1)).fillna(0)
    want["cume_dist"] = by_day.rank(method="max") / size
    close(result(spark, sf, "win_21"), want, "prob", "percent_rank", "cume_dist")


def test_newest_runs_of_all_days(spark, sf, orders):
    got, want = result(spark, sf, "win_22"), per_day(orders)
    assert set(got.run_ts) == {2}
    close(got, want, "n", "prob")
    newest = result(spark, sf, "win_24")
    close(newest, want.sort_values("day").groupby("country", as_index=False).last(), "n", "prob")


def test_joins_and_flags_of_all_days(spark, sf, orders):
    want = per_day(orders)
    got = result(spark, sf, "jn_11")
    assert got.n[0] == got.found[0] == 2 * len(want)
    want["calm"] = (1 / (1 + np.exp(-(0.3 - (want.n - 5) / 2.0 * 0.9 - (want.prob - 0.5) / 0.2 * 0.1))) >= 0.4).astype(int)
    want["fallback"] = 0
    close(result(spark, sf, "scr_02"), want, "calm", "fallback")
    alerts = result(spark, sf, "scr_04")
    assert set(zip(alerts.country, alerts.day, strict=True)) == set(zip(want.country, want.day, strict=True))


@pytest.mark.parametrize("name", ["set_02", "jn_08"])
def test_key_differences_of_all_days(spark, sf, orders, name):
    keys = lambda df: set(zip(df.country, df.day, strict=True))
    got = result(spark, sf, name)
    assert keys(got) == keys(orders) - keys(orders[orders.status == "F"]) and len(got) == len(keys(got))


def test_online_scores_of_all_days(spark, sf, orders):
    got = result(spark, sf, "st_04").sort_values(["country", "day"], ignore_index=True)
    want = []
    for country, rows in orders.groupby("country"):
        n = rows.groupby("day").size().asfreq("D", fill_value=0).astype(float)
        mean, std = n.expanding().mean(), n.expanding().std()
        want.append(pd.DataFrame({"country": country, "day": n.index, "value": n.values, "mean": mean.values, "z": ((n - mean) / std.where(std > 1e-12)).fillna(0).values}))
    want = pd.concat(want).sort_values(["country", "day"], ignore_index=True)
    assert got.day.dt.year.nunique() > 1
    assert list(zip(got.country, got.day, got.value, strict=True)) == list(zip(want.country, want.day, want.value, strict=True))
    assert (got["mean"] - want["mean"]).abs().max() < 1e-5 and (got.z - want.z).abs().max() < 1e-3


@pytest.fixture(scope="module")
def docs(sf):
    d, names = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/nation.parquet").set_index("n_nationkey").n_name
    d["country"] = (d.doc_id % 5).map(names)
    d["day"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(d.doc_id // 5 % 20, unit="D")
    d["themes"] = [re.findall("[A-Z]?[a-z]{3,}", t) for t in d.text]
    d["persons"] = [[p.split(",")[0] for p in re.findall("[a-z]+, ?[a-z]+", t)] for t in d.text]
    return d


def test_themes_of_whole_texts(spark, sf, docs):
    has = lambda p: docs.themes.map(lambda ts: any(re.match(p, t) for t in ts))
    assert set(result(spark, sf, "flt_03").doc_id) == set(docs.doc_id[has("[Ee]n")])
    want = docs.assign(theme_the=has("[Tt]h").astype(int), theme_er=has("er").astype(int)).groupby(["country", "day"], as_index=False)[["theme_the", "theme_er"]].sum()
    close(result(spark, sf, "agg_08"), want, "theme_the", "theme_er")


def test_persons_of_whole_texts(spark, sf, docs):
    per = docs.explode("persons").dropna(subset="persons").groupby(["country", "day", "persons"], as_index=False).size()
    want = per.groupby(["country", "day"], as_index=False).agg(persons=("size", "size"), person_top=("size", "max"), person_tokens=("size", "sum"))
    close(result(spark, sf, "agg_09"), want, "persons", "person_top", "person_tokens")


@pytest.mark.parametrize("bytes_at_once", [16, 1 << 26])
def test_blocks_of_anchors(spark, monkeypatch, bytes_at_once):
    monkeypatch.setattr(vectors, "MOST_BYTES", bytes_at_once)
    anchors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "anchor int, vec array<double>")
    rows = spark.createDataFrame([("A", "d", [1.0, 0.0]), ("B", "d", [0.0, 1.0]), ("C", "d", None), ("D", "d", [1.0])], "country string, day string, vec array<double>")
    got = {(r.country, r.anchor): r.cos for r in vectors.similarities(rows, anchors).collect()}
    assert len(got) == 20
    for i in range(5):
        assert got["A", i] == pytest.approx((1 + i * i) ** -0.5) and got["B", i] == pytest.approx(i * (1 + i * i) ** -0.5)
        assert got["C", i] is None and got["D", i] is None
    assert vectors.similarities(rows, anchors.limit(0)).count() == 0 and vectors.similarities(rows.limit(0), anchors).count() == 0


def test_both_ways_of_similarities_agree(spark):
    rng = np.random.default_rng(2)
    vecs = lambda n: [(i, rng.normal(size=96).tolist()) for i in range(n)]
    rows, anchors = spark.createDataFrame(vecs(150), "country int, vec array<double>"), spark.createDataFrame(vecs(40), "anchor int, vec array<double>")
    a, b = ({(r.country, r.anchor): r.cos for r in f(rows, anchors, keep=["country"]).collect()} for f in (vectors.similarities, vectors.similarities_in_place))
    assert len(a) == 6000 and a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < 1e-9


def test_pools_of_large_and_small_days(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [("A", 1 if k % 4 else 2, k % 2, float(x)) for k, x in enumerate(rng.normal(size=400))]
    sims = spark.createDataFrame(rows, "country string, day int, anchor int, cos double")
    limits = vectors.thresholds(sims)
    want = sorted(map(tuple, vectors.pooled(sims, limits).collect()))
    for small in (1, 60):
        monkeypatch.setattr(vectors, "SMALL", small)
        assert np.allclose(np.array([r[1:] for r in sorted(map(tuple, vectors.pooled(sims, vectors.thresholds(sims)).collect()))]), np.array([r[1:] for r in want]))
    own = [x for _, d, a, x in rows if d == 1 and a == 1]
    assert next(r for r in want if r[1:3] == (1, 1))[3:6] == pytest.approx((max(own), np.percentile(own, 95), np.percentile(own, 99)))


def test_sketches_of_loads_merge_to_those_of_all(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=30000)
    keys, q = ["country", "anchor"], {"a": 0.5, "b": 0.9, "c": 0.99}
    rows = spark.createDataFrame(pd.DataFrame({"country": "A", "anchor": 1, "cos": x, "load": np.arange(30000) % 7}))
    stored = sketches.sketched(rows.where("load = 0"), "cos", keys)
    for k in range(1, 7):
        stored = stored.unionByName(sketches.sketched(rows.where(f"load = {k}"), "cos", keys))
        if k == 3:
            stored = sketches.merged(stored, keys)
    got = sketches.percentiles(stored, q, keys).first()
    assert got.n == 30000
    for name, share in q.items():
        assert abs((x <= got[name]).mean() - share) < 0.0133 * 1.5
    assert sketches.off(rows, sketches.percentiles(stored, q, keys).drop("n"), "cos", q, keys).first().off < 0.0133 * 1.5
    assert sketches.sketched(rows.withColumn("cos", F.lit(None).cast("double")), "cos", keys).count() == 0
