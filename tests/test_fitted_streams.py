"""Fitted operators against numpy, streams that stop and go on, and text patterns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom import streaming
from riskloom.operators import dealt, evaluate, learning, text
from riskloom.sources.readers import embedded_json


def rows_of(spark, sf, name):
    return entry.queries()[name](spark, sf).toPandas()


def test_isotonic_is_pool_adjacent_violators(spark, sf):
    from riskloom.plans.fixtures import predictions

    got = rows_of(spark, sf, "cal_02")
    past = predictions(spark, sf).where("day < '2024-01-12'").select("p", "y").toPandas().groupby("p").y.agg(["sum", "size"]).reset_index()
    blocks = []
    for p, y, n in past.itertuples(index=False):
        blocks.append([y, n, [p]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + ps]
    x = np.array([p for b in blocks for p in b[2]])
    v = np.array([b[0] / b[1] for b in blocks for _ in b[2]])
    assert np.allclose(got.calibrated, np.interp(got.p, x, v), atol=1e-9)


def test_platt_is_at_the_optimum(spark, sf):
    from riskloom.plans.fixtures import predictions

    got = rows_of(spark, sf, "cal_01").merge(predictions(spark, sf).select("doc_id", "y", "day").toPandas(), on="doc_id")
    z = np.log(got.calibrated / (1 - got.calibrated))
    order = np.argsort(got.p.to_numpy())
    steps = np.diff(z.to_numpy()[order])
    assert (steps >= -1e-9).all() or (steps <= 1e-9).all()
    past = got[got.day.astype(str) < "2024-01-12"]
    assert abs((past.calibrated - past.y).mean()) < 1e-3  # the intercept's gradient


def test_components_equal_numpy(spark, sf):
    from riskloom.plans.embeddings import TRAIN
    from riskloom.plans.fixtures import titles

    t = titles(spark, sf).select("vec_id", "day", "vec").toPandas().sort_values("vec_id")
    x = np.array(t.vec.tolist())
    train = x[(t.day.astype(str) <= str(TRAIN)).to_numpy()]
    got = np.array(rows_of(spark, sf, "vec_04").sort_values("vec_id").pc.tolist())
    _, s, v = np.linalg.svd(train - train.mean(0), full_matrices=False)
    want = (x - train.mean(0)) @ v[:8].T
    for k in range(3):
        if s[k] - s[k + 1] > 1e-3 * s[k]:
            assert np.allclose(np.abs(got[:, k]), np.abs(want[:, k]), atol=1e-4)
    assert np.allclose((got**2).sum(), (want**2).sum(), rtol=1e-6)


def test_clusters_give_distances(spark, sf):
    got = rows_of(spark, sf, "vec_05")
    d = np.array(got.distances.tolist())
    assert d.shape[1] == 10 and (d >= 0).all()
    assert np.allclose(d.min(1), got.nearest) and np.allclose(d.mean(1), got.mean_distance)


@pytest.mark.parametrize(("name", "columns"), [("trn_02", ["p"]), ("trn_03", ["p"]), ("trn_04", ["meta"]), ("scr_03", ["p"])])
def test_models_give_probabilities_that_vary_once_per_key(spark, sf, name, columns):
    got = rows_of(spark, sf, name)
    keys = ["doc_id"] if "doc_id" in got else ["country", "day"]
    assert len(got) and not got.duplicated(keys).any()
    for c in columns:
        assert got[c].between(0, 1).all() and got[c].nunique() > 1
    if name == "trn_03":
        assert sorted(got.fold.unique()) == [1, 2, 3, 4, 5, 6]
        from riskloom.plans.metrics import learnable

        days = learnable(spark, sf).toPandas()
        later = days[days.fold > days.fold.min()]
        assert len(got) == len(later) and set(zip(got.country, got.day, strict=True)) == set(zip(later.country, later.day, strict=True))


def test_features_are_standard_on_training_rows(spark, sf):
    got = rows_of(spark, sf, "trn_01")
    x = np.array(got.x.tolist())
    train = x[got.day.astype(str).str[:4].astype(int) <= 1998]
    assert np.isfinite(x).all() and abs(train[:, 0].mean()) < 1e-6 and abs(train[:, 0].std(ddof=1) - 1) < 1e-6


class Rate:
    """A learner by hand: everybody has the past's rate."""

    def __init__(self, past):
        self.rate = past.agg(F.avg("y")).first()[0]

    def transform(self, df):
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1 - self.rate), F.lit(self.rate))))


def test_folds_are_predicted_from_the_past_only(spark):
    rng = np.random.default_rng(3)
    rows = [(int(f), int(y), float(x)) for f, y, x in zip(rng.integers(2, 9, 300), rng.integers(0, 2, 300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows, "fold int, y int, x double")
    got = learning.out_of_fold(df, "fold", ["x"], "y", fit=Rate).collect()
    assert len(got) == sum(f > 2 for f, *_ in rows)
    for r in got:
        past = [y for f, y, _ in rows if f < r.fold]
        assert abs(r.p - sum(past) / len(past)) < 1e-12
    assert learning.out_of_fold(df.where("fold = 2"), "fold", ["x"], "y", fit=Rate).count() == 0


def test_folds_go_on_from_written_models(spark, tmp_path):
    df = spark.createDataFrame([(k % 4, int(k % 7 > 3), float(k % 7)) for k in range(200)], "fold int, y int, x double")
    seen = []

    def fit(past):
        n = past.agg(F.max("fold")).first()[0]
        if n == 2 and len(seen) < 3:
            seen.append("lost")
            raise RuntimeError("lost")
        seen.append(n)
        return learning.boosted(past, ["x"], "y", rounds=2)

    with pytest.raises(RuntimeError):
        learning.out_of_fold(df, "fold", ["x"], "y", str(tmp_path), fit)
    got = learning.out_of_fold(df, "fold", ["x"], "y", str(tmp_path), fit)
    assert seen == [0, 1, "lost", 2] and got.count() == 150
    again = learning.out_of_fold(df, "fold", ["x"], "y", str(tmp_path), lambda past: pytest.fail("fitted again"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_folds_by_years(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.date(y, 3, 1), 9) for y in range(1990, 2000)], "day date, fold int")
    got = {r.day.year: r.fold for r in learning.folds_by_time(df, "day", 6).collect()}
    assert got == {**{y: 0 for y in range(1990, 1994)}, **{1994 + k: k + 1 for k in range(6)}}
    assert {r.fold for r in learning.folds_by_time(df.where("day < '1992-01-01'"), "day", 6).collect()} == {0, 1}


def average_precision(p, y):
    """Step-wise, ties as one step."""
    out, done, hits = 0.0, 0, 0
    for v in sorted(set(p), reverse=True):
        n, t = (p == v).sum(), y[p == v].sum()
        done, hits = done + n, hits + t
        out += t / y.sum() * hits / done
    return out


def logistic(x, y, weight, reg):
    """Weighted logistic regression with a ridge on all but the constant, by Newton's steps."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([0.0] + [reg] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        w += np.linalg.solve(a.T @ (a * (weight * p * (1 - p))[:, None]) / weight.sum() + ridge, a.T @ (weight * (y - p)) / weight.sum() - ridge @ w)
    return w


def standard(past, rows):
    return (rows - past.mean(0)) / past.std(0, ddof=1)


def test_the_stacked_model_is_at_its_optimum(spark, sf):
    from riskloom.plans.fixtures import predictions

    d = predictions(spark, sf).toPandas()
    past, val = d[d.day.astype(str) < "2024-01-12"], d[d.day.astype(str) >= "2024-01-12"]
    x, v, y = past[["p", "q"]].to_numpy(), val[["p", "q"]].to_numpy(), past.y.to_numpy()
    weight = np.where(y == 1, min((1 - y.mean()) / y.mean(), 20), 1.0)
    tried = []
    for reg in (0.001, 0.01, 0.1):
        w = logistic(standard(x, x), y, weight, reg)
        p = 1 / (1 + np.exp(-(w[0] + standard(x, v) @ w[1:])))
        tried.append((average_precision(p, val.y.to_numpy()), p))
    got = rows_of(spark, sf, "trn_04").set_index("doc_id").meta.loc[val.doc_id].to_numpy()
    best = max(t[0] for t in tried)
    assert any(np.abs(got - p).max() < 2e-3 for ap, p in tried if ap > best - 1e-9)


def test_selection_adds_what_lifts_precision_most(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 240)
    cols = {"a": y + rng.normal(0, 1.0, 240), "b": y + rng.normal(0, 1.1, 240), "c": rng.normal(size=240), "d": y * 0.2 + rng.normal(size=240)}
    fold = np.arange(240) % 3
    df = spark.createDataFrame([(int(f), int(t), *[float(cols[c][k]) for c in "abcd"]) for k, (f, t) in enumerate(zip(fold, y, strict=True))], "fold int, y int, a double, b double, c double, d double")
    picked, best = [], -1.0
    while len(picked) < 3:
        score = {m: np.mean([average_precision(sum(cols[c] for c in [*picked, m])[fold == f] / (len(picked) + 1), y[fold == f]) for f in range(3)]) for m in "abcd" if m not in picked}
        m = max(score, key=lambda k: (score[k], k))
        if score[m] <= best:
            break
        best, picked = score[m], [*picked, m]
    assert learning.forward_selection(df, list("abcd"), "y", "fold") == picked and len(picked) >= 2


def test_ablation_is_that_of_models_by_hand(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(size=400) > 0.7).astype(int)
    df = spark.createDataFrame([(int(k), int(t), *map(float, v)) for k, (t, v) in enumerate(zip(y, x, strict=True))], "k int, y int, a double, b double, c double")
    got = {r.run: (r.features, r.ap) for r in learning.ablation(df.where("k < 300"), df.where("k >= 300"), {"ab": ["a", "b"], "c": ["c"]}, "y").collect()}
    past, weight = y[:300], np.where(y[:300] == 1, (1 - y[:300].mean()) / y[:300].mean(), 1.0)
    for run, own in (("all", [0, 1, 2]), ("without ab", [2]), ("without c", [0, 1])):
        z = standard(x[:300, own], x[:, own])
        w = logistic(z[:300], past, weight, 0.01)
        assert got[run][0] == len(own) and abs(got[run][1] - average_precision(z[300:] @ w[1:], y[300:])) < 5e-3


def test_the_calm_cut_leaves_the_observed_share(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=600)
    y = (x + rng.normal(size=600) < 0.4).astype(int)
    df = spark.createDataFrame([(int(k), int(t), float(v)) for k, (t, v) in enumerate(zip(y, x, strict=True))], "k int, y int, v double")
    model, cut = learning.calm_fit(df.where("k < 400"), df.where("k >= 400"), ["v"], "y")
    z = standard(x[:400, None], x[:, None])
    w = logistic(z[:400], y[:400], np.ones(400), 0.01)
    p = 1 / (1 + np.exp(-(w[0] + z[400:] @ w[1:])))
    assert abs(cut - np.quantile(p, 1 - y[400:].mean())) < 2e-3
    scored = learning.apply(model, df.where("k >= 400")).orderBy("k").toPandas()
    assert np.abs(scored.p - p).max() < 2e-3 and abs((scored.p >= cut).mean() - y[400:].mean()) < 0.01


def test_linear_models_are_chosen_by_f1(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 4))
    y = (x[:, 0] + 0.3 * rng.normal(size=500) > 1.0).astype(int)
    df = spark.createDataFrame([(int(k), int(t), *map(float, v)) for k, (t, v) in enumerate(zip(y, x, strict=True))], "k int, y int, a double, b double, c double, d double")
    train, val, family = df.where("k < 300"), df.where("k >= 300"), ((0.5, 1.0), (0.001, 0.0), (0.1, 0.5))
    score = []
    for reg, mix in family:
        p = learning.apply(learning.logistic_fit(train, list("abcd"), "y", reg=reg, mix=mix), val).toPandas()
        score.append(max(2 * ((p.p >= c) & (p.y == 1)).sum() / ((p.p >= c).sum() + p.y.sum()) for c in set(p.p)))
    assert learning.chosen_linear(train, val, list("abcd"), "y", family)[0] == family[int(np.argmax(score))]


def test_clusters_of_distant_groups_are_these(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [30, 0, 5], [0, 40, -9], [25, 25, 25]], float)
    x = np.concatenate([c + rng.normal(size=(50, 3)) for c in centres])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k int, v array<double>")
    got = learning.clustered(df, "v", F.col("k") % 2 == 0, 4).orderBy("k").toPandas()
    means = np.array([x[50 * g : 50 * g + 50 : 2].mean(0) for g in range(4)])
    want = np.sort(np.linalg.norm(x[:, None] - means, axis=2), axis=1)
    assert np.allclose(np.sort(np.array(got.distances.tolist()), axis=1), want, atol=1e-6)
    assert np.allclose(got.nearest, want[:, 0], atol=1e-6) and np.allclose(got.mean_distance, want.mean(1), atol=1e-6)


def test_four_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(300, 6))
    x = base @ rng.normal(size=(6, 400)) + rng.normal(size=(300, 400)) + 1e5
    x[rng.random(x.shape) < 0.03] = np.nan
    x[:, 7] = 3.0
    names = [f"x{k}" for k in range(400)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names)).repartition(4)
    got = {(r.a, r.b): r.r for r in evaluate.correlations(df, names).collect()}
    want = pd.DataFrame(x, columns=names).corr().to_numpy()
    assert len(got) == 400 * 399 // 2
    for i in range(400):
        for j in range(i + 1, 400):
            r = got[names[i], names[j]]
            assert r is None if 7 in (i, j) else abs(r - want[i, j]) < 1e-8
    few = names[:6]
    nulls = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in few])
    small, large = ({(r.a, r.b): r.r for r in f(nulls, few).collect()} for f in (evaluate.correlations, evaluate.gram_correlations))
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-9 for k in small)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    land, out, checkpoint = (str(tmp_path / x) for x in ("land", "out", "checkpoint"))
    rows = lambda a, b: spark.createDataFrame([(i, i % 3) for i in range(a, b)], "id long, k long")
    stream = lambda: streaming.landed(spark, land, "id long, k long", 1)
    rows(0, 30).repartition(3).write.parquet(land)
    seen = []

    def failing(df, i):
        if i == 1:
            raise RuntimeError("lost")
        seen.append(i)
        df.write.mode("overwrite").parquet(f"{out}/batch={i}")

    def each(df, i):
        seen.append(i)
        df.write.mode("overwrite").parquet(f"{out}/batch={i}")

    with pytest.raises(Exception, match="lost"):
        streaming.drain(stream(), failing, checkpoint=checkpoint)
    assert seen == [0]
    streaming.drain(stream(), each, checkpoint=checkpoint)
    rows(30, 50).coalesce(1).write.mode("append").parquet(land)
    streaming.drain(stream(), each, checkpoint=checkpoint)
    streaming.drain(stream(), each, checkpoint=checkpoint)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(50))
    assert seen == [0, 1, 2, 3]


def test_casualties_by_the_nearest_word_of_harm(spark):
    said = [
        ("3 killed, 5 wounded", ["dead 3", "hurt 5"]), ("Killed 3, wounded 5; 3 dead.", ["dead 3", "hurt 5"]), ("At least 1,200 people were killed", ["dead 1200"]), ("At least 1,200 people killed", ["dead 1200"]),
        ("7 died 8 injured", ["dead 7", "hurt 8"]), ("unskilled 9. killed", []), ("A toll of 4 and 6 deaths in 2024, 2 of them", ["dead 4", "dead 6", "dead 2024"]), (None, None), ("", []),
    ]
    df = spark.createDataFrame([(t,) for t, _ in said], "t string")
    assert [r.c for r in df.select(text.casualties(F.col("t")).alias("c")).collect()] == [want for _, want in said]


def test_deeds_by_the_beginnings_of_words(spark):
    df = spark.createDataFrame([("An AIRSTRIKE; protesters marched",), ("embargo",), (None,)], "t string")
    assert [r.a for r in df.select(text.deeds(F.col("t")).alias("a")).collect()] == [["bombing", "crowd"], [], []]


HELD = ["air strike", "a", "b_c", "o'neil", "são paulo", "é", "日本", "-x", "x-", "1", "the", "air", "strike on", "paulo", "né", "c++"]
SAID = ["An Air Strike on São Paulo by O'Neil", "airstrike", "b_c b_cd", "é né", "日本 日本人 x日本", "a-x x--x", "c++ c+", "_the the_", "the", "", None, "x-1 1x", "São Paulos", "air  strike", "naïve café é."]


def test_terms_of_one_pass_are_those_of_one_expression_each(spark, monkeypatch):
    df = spark.createDataFrame([(t,) for t in SAID], "t string")
    places = [(t, f"C{k % 3}", float(k), None if k % 4 else 1.0, k % 2 == 0) for k, t in enumerate(HELD)]
    out = []
    for few in (0, 1000):
        monkeypatch.setattr(text, "FEW", few)
        out.append([tuple(r) for r in df.select(text.matched(F.col("t"), HELD).alias("m"), text.place(F.col("t"), places).alias("p")).collect()])
    assert out[0] == out[1]
    assert out[0][0][0] == ["air strike", "o'neil", "são paulo", "air", "strike on", "paulo"]


def test_ten_thousand_aliases_in_one_pass(spark):
    import time

    rng = np.random.default_rng(1)
    names = [f"city{k} north" if k % 3 else f"town{k}" for k in range(10_000)]
    said = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 200)) + " " + names[k * 7 % 10_000] for k in range(2000)]
    took = {}
    for n in (10, 10_000):
        own, begin = text.Terms(names[:n]), time.process_time()
        found = [own.found(t) for t in said]
        took[n] = time.process_time() - begin
    assert all(k * 7 % 10_000 in f for k, f in enumerate(found)) and took[10_000] < 4 * took[10]


def test_packs_of_one_large_key_are_many_tasks(spark):
    data = [("A", 2024, k % 50, f"t{k % 700:03d}" + "x" * (k % 40)) for k in range(3000)] + [("B", 2024, 1, "one")]
    df = spark.createDataFrame(data, "country string, year int, day int, title string")
    got = text.packed(df, 400, 900).toPandas().sort_values(["country", "day", "title"])
    own = got[got.country == "A"]
    parts = own.groupby("part").title.agg(["size", lambda s: s.str.len().sum()])
    assert parts["size"].max() <= 400 and own.part.nunique() == 8
    last = -1
    for (part, sub), g in own.groupby(["part", "sub"]):
        first = (g.day.iloc[0], g.title.iloc[0])
        assert last == -1 or first >= last
        last = (g.day.iloc[-1], g.title.iloc[-1])
    for part, g in own.groupby("part"):
        k = max(1, -(-int(min(g.title.str.len().sum() / 3.5, len(g) * 256)) // 900))
        assert g["sub"].max() + 1 <= k and g.groupby("sub").size().max() == -(-len(g) // k)


def test_as_of_of_one_large_key(spark):
    from riskloom.operators import joins

    rng = np.random.default_rng(2)
    left = [("A" if k % 10 else None, int(t)) for k, t in enumerate(rng.integers(0, 500, 2000))] + [("B", 1), ("C", 3)]
    right = [("A", int(t), int(t) * 10 + j) for j in (0, 1) for t in rng.integers(0, 500, 60)] + [("A", 3, None), ("C", 4, 1), (None, 5, 7)]
    a, b = spark.createDataFrame(left, "k string, at long"), spark.createDataFrame(right, "k string, at long, v long")
    got = sorted([tuple(r) for r in joins.as_of(a, b, "k", "at", "v", "found").collect()], key=str)

    def want(k, at):
        past = [(t, v) for key, t, v in right if key == k and t <= at and v is not None]
        return max(past)[1] if past else None

    assert got == sorted([(k, at, want(k, at)) for k, at in left], key=str)


def test_hot_values_are_placed_like_others(spark):
    rows = [("g", 0.0)] * 3000 + [("g", float(k % 7)) for k in range(400)] + [("h", None)] * 2 + [(None, 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {(r.k, r.v): (r.upto, r.equal, r.rows, r.n) for r in dealt.placed(df, "v", ["k"]).groupBy("k", "v", "upto", "equal", "rows").agg(F.count("*").alias("n")).collect()}
    own = [v for k, v in rows if k == "g"]
    assert {k: got["g", k] for k in set(own)} == {v: (sum(x <= v for x in own), own.count(v), len(own), own.count(v)) for v in set(own)}
    assert got["h", None] == (2, 2, 2, 2) and got[None, 1.0] == (1, 1, 1, 1)


def test_a_missing_block_is_an_error(spark):
    pages = spark.createDataFrame([(1, '<script id="meta">{"size": 3}</script>'), (2, "<p>none</p>")], "page_id long, html string")
    assert embedded_json(pages.where("page_id = 1"), "html", {"meta": "size int"}).first().meta.size == 3
    with pytest.raises(Exception, match="block meta is missing"):
        embedded_json(pages, "html", {"meta": "size int"}).collect()


def test_running_sums_and_percentiles_of_one_large_group(spark):
    rng = np.random.default_rng(4)
    rows = [("big" if i % 3 else None, float(v)) for i, v in enumerate(rng.integers(0, 40, 900))] + [("one", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.a, r.b) for r in dealt.percentiles(df, "v", {"a": 0.9, "b": 0.5}, ["k"]).collect()}
    for k in (None, "big", "one"):
        own = [v for g, v in rows if g == k]
        assert np.allclose(got[k], (np.percentile(own, 90), np.percentile(own, 50)))
    ranks = dealt.running(df.withColumn("i", F.monotonically_increasing_id()), [F.col("v"), F.col("i")], {"n": F.lit(1)}, ["k"], {"n": "all"}).collect()
    for k in (None, "big", "one"):
        own = sorted((r.v, r.i, r.n) for r in ranks if r.k == k)
        assert [n for *_, n in own] == list(range(1, len(own) + 1)) and {r["all"] for r in ranks if r.k == k} == {len(own)}
