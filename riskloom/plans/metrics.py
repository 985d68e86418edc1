"""Evaluation, exploratory tables, and fits."""

from pyspark.sql import functions as F

from riskloom.functions import div, r6
from riskloom.operators import evaluate, learning
from riskloom.operators.windows import Roll, rolled
from riskloom.plans.fixtures import predictions
from riskloom.plans.panel import LBL, OWN, label_panel, order_panel
from riskloom.plans.registry import query
from riskloom.session import fresh_path, materialize

CUT = (
    "cu AS (SELECT p, _n, _p, sum(_n) OVER w AS n, sum(_p) OVER w AS tp, sum(_p) OVER () AS pos, sum(_n) OVER () AS tot "
    "FROM (SELECT p, count(*) AS _n, sum(y) AS _p FROM pred GROUP BY p) WINDOW w AS (ORDER BY p DESC))"
)
CUTC = (
    "cc AS (SELECT country, p, _n, _p, sum(_n) OVER w AS n, sum(_p) OVER w AS tp, sum(_p) OVER (PARTITION BY country) AS pos "
    "FROM (SELECT country, p, count(*) AS _n, sum(y) AS _p FROM pred GROUP BY ALL) WINDOW w AS (PARTITION BY country ORDER BY p DESC))"
)


@query("evl_01", "SELECT round(sum(_p / pos * tp / n), 6) AS ap FROM cu", ctes=CUT)
def evl_01(spark, sf):
    return evaluate.average_precision(predictions(spark, sf), "p", "y").select(r6("ap").alias("ap"))


@query(
    "evl_02",
    "SELECT round((sum(_p * (tot - n + (_n + 1) / 2)) - max(pos) * (max(pos) + 1) / 2) / (max(pos) * (max(tot) - max(pos))), 6) AS auc "
    "FROM cu",
    ctes=CUT,
)
def evl_02(spark, sf):
    return evaluate.roc_auc(predictions(spark, sf), "p", "y").select(r6("auc").alias("auc"))


@query(
    "evl_03",
    "SELECT round(tp / n, 6) AS precision, round(tp / pos, 6) AS recall, round(2 * tp / (n + pos), 6) AS f1, round(best, 6) AS best_f1, "
    "round(thr, 6) AS threshold FROM (SELECT count(*) FILTER (p >= 0.4 AND y = 1) AS tp, count(*) FILTER (p >= 0.4) AS n, sum(y) AS pos "
    "FROM pred), (SELECT max(2 * tp / (n + pos)) AS best, arg_max(p, (2 * tp / (n + pos), p)) AS thr FROM cu)",
    ctes=CUT,
)
def evl_03(spark, sf):
    p = predictions(spark, sf)
    a, b = evaluate.at_threshold(p, "p", "y", 0.4), evaluate.best_f1(p, "p", "y").withColumnRenamed("f1", "best_f1")
    return a.join(F.broadcast(b)).select(*[r6(c).alias(c) for c in ("precision", "recall", "f1", "best_f1", "threshold")])


@query("evl_04", "SELECT round(coalesce(max(tp / pos) FILTER (tp / n >= 0.12), 0), 6) AS recall FROM cu", ctes=CUT)
def evl_04(spark, sf):
    return evaluate.recall_at_precision(predictions(spark, sf), "p", "y", 0.12).select(r6("recall").alias("recall"))


TOPF = "(SELECT *, row_number() OVER (ORDER BY p DESC, doc_id) <= greatest(1, floor(count(*) OVER () * 0.05)) AS top FROM pred)"


@query(
    "evl_05",
    f"SELECT round(count(*) FILTER (top AND y = 1) / count(*) FILTER (top), 6) AS precision, "
    f"round(count(*) FILTER (top AND y = 1) / sum(y), 6) AS recall FROM {TOPF}",
)
def evl_05(spark, sf):
    return evaluate.at_top(predictions(spark, sf), "p", "y", 0.05, "doc_id").select(r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("evl_06", "SELECT round(avg((p - y) * (p - y)), 6) AS brier FROM pred")
def evl_06(spark, sf):
    return predictions(spark, sf).agg(r6(evaluate.brier("p", "y")).alias("brier"))


CALT = "ca AS (SELECT least(floor(p * 10), 9)::INT AS bin, count(*) AS n, avg(y) AS rate, avg(p) AS mean_p, avg(q) AS mean_q FROM pred GROUP BY ALL)"


@query("evl_07", "SELECT round(sum(n * abs(rate - mean_p)) / sum(n), 6) AS ece FROM ca", ctes=CALT)
def evl_07(spark, sf):
    return evaluate.expected_error(predictions(spark, sf), "p", "y").select(r6("ece").alias("ece"))


@query("cal_03", "SELECT bin, n, round(rate, 6) AS rate, round(mean_p, 6) AS mean_p, round(mean_q, 6) AS mean_q FROM ca", ctes=CALT)
def cal_03(spark, sf):
    return evaluate.calibration(predictions(spark, sf), "p", "y", more=["q"]).withColumns({c: r6(c) for c in ("rate", "mean_p", "mean_q")})


@query(
    "evl_08",
    "SELECT round(avg(ap), 6) AS macro, count(*) AS countries FROM (SELECT country, sum(_p / nullif(pos, 0) * tp / n) AS ap FROM cc "
    "GROUP BY country) WHERE ap IS NOT NULL",
    ctes=CUTC,
)
def evl_08(spark, sf):
    per = evaluate.average_precision(predictions(spark, sf), "p", "y", ["country"]).where("ap is not null")
    return per.agg(r6(F.avg("ap")).alias("macro"), F.count("*").alias("countries"))


@query(
    "evl_09",
    "SELECT round(median(lead), 6) AS median_lead, count(*) AS n FROM (SELECT o.day - (SELECT max(a.day) FROM pred a "
    "WHERE a.country = o.country AND a.p >= 0.95 AND a.day <= o.day) AS lead FROM (SELECT DISTINCT country, day FROM pred WHERE y = 1) o) "
    "WHERE lead IS NOT NULL",
)
def evl_09(spark, sf):
    p = predictions(spark, sf)
    lead = evaluate.lead_times(p.where("y = 1").select("country", "day").distinct(), p, 0.95)
    return lead.agg(r6(F.percentile("lead", 0.5)).alias("median_lead"), F.count("*").alias("n"))


PERS = (
    LBL
    + (
        ", pe AS (SELECT *, greatest(0, least(1, past_n / 14)) AS p FROM l), "
        "pc AS (SELECT p, sum(_n) OVER w AS n, sum(_p) OVER w AS tp, _p, sum(_p) OVER () AS pos "
        "FROM (SELECT p, count(*) AS _n, sum(y) AS _p FROM pe GROUP BY p) WINDOW w AS (ORDER BY p DESC))"
    )
)


@query("evl_10", "SELECT round(sum(_p / pos * tp / n), 6) AS ap FROM pc", ctes=PERS)
def evl_10(spark, sf):
    df = label_panel(spark, sf).withColumn("p", evaluate.persistence("past_n", 14))
    return evaluate.average_precision(df, "p", "y").select(r6("ap").alias("ap"))


@query(
    "evl_11",
    "SELECT round(p5, 6) AS p_at_5, round(p10, 6) AS p_at_10, round(p5 / base, 6) AS lift_at_5, round(al / days, 6) AS alerts_per_day, "
    "round(coalesce(alp / nullif(al, 0), 0), 6) AS alert_precision, round(alp / pos, 6) AS alert_recall "
    "FROM (SELECT count(*) FILTER (k <= 5 AND y = 1) / count(*) FILTER (k <= 5) AS p5, "
    "count(*) FILTER (k <= 10 AND y = 1) / count(*) FILTER (k <= 10) AS p10, avg(y) AS base, count(*) FILTER (p >= 0.8) AS al, "
    "count(DISTINCT day) AS days, count(*) FILTER (p >= 0.8 AND y = 1) AS alp, sum(y) AS pos "
    "FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY p DESC, doc_id) AS k FROM pred))",
)
def evl_11(spark, sf):
    df = evaluate.backtest(predictions(spark, sf), "p", "y", 0.8, "doc_id")
    return df.select(*[r6(c).alias(c) for c in df.columns])


@query(
    "evl_12",
    "SELECT 0::BIGINT AS unmatched, feature, CASE feature WHEN 'p' THEN 0.0 ELSE 0.5 END::DOUBLE AS max_diff, feature = 'p' AS passed "
    "FROM (VALUES ('p'), ('q')) AS t(feature)",
)
def evl_12(spark, sf):
    a = predictions(spark, sf)
    b = a.withColumn("q", F.when(F.col("doc_id") == F.lit(a.agg(F.min("doc_id")).first()[0]), F.col("q") + 0.5).otherwise(F.col("q")))
    return evaluate.parity(a, b, ["doc_id"], ["p", "q"]).withColumn("max_diff", r6("max_diff"))


@query(
    "evl_13",
    "SELECT a, b, round(r, 4) AS r FROM (SELECT 'p' AS a, 'q' AS b, corr(p, q) AS r FROM pred UNION ALL SELECT 'p', 'y', corr(p, y) "
    "FROM pred UNION ALL SELECT 'q', 'y', corr(q, y) FROM pred)",
)
def evl_13(spark, sf):
    return evaluate.correlations(predictions(spark, sf), ["p", "q", "y"]).withColumn("r", F.round("r", 4))


REPORT = (
    (
        "SELECT 'ap' AS metric, sum(_p / pos * tp / n) AS value FROM cu UNION ALL "
        "SELECT 'auc', (sum(_p * (tot - n + (_n + 1) / 2)) - max(pos) * (max(pos) + 1) / 2) / (max(pos) * (max(tot) - max(pos))) FROM cu "
        "UNION ALL SELECT 'brier', avg((p - y) * (p - y)) FROM pred UNION ALL SELECT 'ece', sum(n * abs(rate - mean_p)) / sum(n) FROM ca "
        "UNION ALL SELECT 'precision_top5', count(*) FILTER (top AND y = 1) / count(*) FILTER (top) FROM "
    )
    + TOPF
)


@query("evl_14", f"SELECT metric, round(value, 6) AS value FROM ({REPORT})", ctes=f"{CUT}, {CALT}")
def evl_14(spark, sf):
    return evaluate.metrics(predictions(spark, sf), "p", "y", "doc_id").withColumn("value", r6("value"))


@query("evl_15", "SELECT 0::BIGINT AS repeated, 0::BIGINT AS outside, true AS passed")
def evl_15(spark, sf):
    return evaluate.assertions(predictions(spark, sf), ["doc_id"], "p")


@query(
    "evl_16",
    f"SELECT metric, round(value, 4) AS candidate, round(value / 2, 4) AS base, round(value - value / 2, 4) AS delta FROM ({REPORT})",
    ctes=f"{CUT}, {CALT}",
)
def evl_16(spark, sf):
    m = materialize(evaluate.metrics(predictions(spark, sf), "p", "y", "doc_id"), "report")
    return evaluate.compared(m, m.withColumn("value", F.col("value") / 2))


# ---- exploratory tables ----


@query(
    "agg_22",
    "SELECT country, round(tr, 6) AS train, round(te, 6) AS test, round(te - tr, 6) + 0.0 AS drift "
    "FROM (SELECT country, avg(y) FILTER (day < DATE '2024-01-20') AS tr, avg(y) FILTER (day >= DATE '2024-01-20') AS te FROM l "
    "GROUP BY country)",
    ctes=LBL,
)
def agg_22(spark, sf):
    df = label_panel(spark, sf).withColumn("split", F.when(F.col("day") < "2024-01-20", "train").otherwise("test"))
    wide = df.groupBy("country").pivot("split", ["train", "test"]).agg(F.avg("y"))
    return wide.select("country", r6("train").alias("train"), r6("test").alias("test"), r6(F.col("test") - F.col("train")).alias("drift"))


@query("agg_23", "SELECT round(skewness(n), 5) AS n, round(skewness(amount), 5) AS amount FROM op", ctes=OWN)
def agg_23(spark, sf):
    return order_panel(spark, sf).agg(*[F.round(evaluate.adjusted_skewness(c), 5).alias(c) for c in ("n", "amount")])


@query(
    "agg_24",
    "SELECT bin, n, round(rate, 6) AS rate, round(rate / base, 6) AS lift "
    "FROM (SELECT len(list_filter(e, lambda x: x < p))::INT AS bin, count(*) AS n, avg(y) AS rate, max(base) AS base "
    "FROM pred, (SELECT list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS e, avg(y) AS base FROM pred) "
    "GROUP BY 1)",
)
def agg_24(spark, sf):
    df = evaluate.decile_lift(predictions(spark, sf), "p", "y")
    return df.select("bin", "n", r6("rate").alias("rate"), r6("lift").alias("lift"))


@query("agg_25", "SELECT a, b, round(r, 5) AS r FROM (SELECT 'n' AS a, 'amount' AS b, corr(n, amount) AS r FROM op) WHERE abs(r) > 0.5", ctes=OWN)
def agg_25(spark, sf):
    return evaluate.correlations(order_panel(spark, sf), ["n", "amount"]).where("abs(r) > 0.5").withColumn("r", F.round("r", 5))


WIDE = [f"f{k}" for k in range(24)]
WIDE_SQL = "wide AS (SELECT " + ", ".join(f"CASE WHEN (n + {k}) % 11 > 0 THEN n * {k % 5} + amount * ((n + {k}) % {k + 2}) END AS f{k}" for k in range(24)) + " FROM op)"


@query(
    "agg_25_wide",
    "SELECT a, b, round(r, 5) + 0.0 AS r FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM wide" for i, a in enumerate(WIDE) for b in WIDE[i + 1 :]) + ") WHERE abs(r) > 0.05 AND NOT isnan(r)",
    ctes=f"{OWN}, {WIDE_SQL}",
)
def agg_25_wide(spark, sf):
    op, n = order_panel(spark, sf), F.col("n")
    wide = op.select(*[F.when((n + k) % 11 > 0, n * (k % 5) + F.col("amount") * ((n + k) % (k + 2))).alias(f"f{k}") for k in range(24)])
    return evaluate.correlations(wide, WIDE).where("abs(r) > 0.05").withColumn("r", F.round("r", 5) + F.lit(0.0))


@query(
    "agg_26",
    "SELECT split, count(*) AS n, sum(y)::BIGINT AS positives, round(avg(y), 6) AS rate "
    "FROM (SELECT y, CASE WHEN day < DATE '2024-01-15' THEN 'train' WHEN day < DATE '2024-01-20' THEN 'val' ELSE 'test' END AS split "
    "FROM l) GROUP BY split",
    ctes=LBL,
)
def agg_26(spark, sf):
    split = F.when(F.col("day") < "2024-01-15", "train").when(F.col("day") < "2024-01-20", "val").otherwise("test")
    return label_panel(spark, sf).withColumn("split", split).groupBy("split").agg(F.count("*").alias("n"), F.sum("y").alias("positives"), r6(div(F.sum("y"), F.count("*"))).alias("rate"))


# ---- fits ----


def learnable(spark, sf):
    """Order panel with past features, a label (a busy day ahead) and a yearly fold."""
    df = rolled(order_panel(spark, sf), [Roll("n_7", "n", "sum", 7, 1, fill=0), Roll("n_30", "n", "sum", 30, 1, fill=0), Roll("amount_7", "amount", "avg", 7, 1, fill=0.0)])
    hot = F.when((F.col("n") >= 2) & (F.pmod(F.xxhash64("country"), F.lit(3)) > 0), 1).otherwise(0)
    return materialize(df.select("country", "day", "n_7", "n_30", "amount_7", hot.alias("y"), F.year("day").alias("fold")), "learnable")


FEATURES = ["n_7", "n_30", "amount_7"]


def splits(df):
    return df.where("fold <= 1998"), df.where("fold = 1999"), df.where("fold >= 2000")


@query("trn_01")
def trn_01(spark, sf):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array

    df, stages = learning.preprocessing(learnable(spark, sf).withColumn("n_7", F.when(F.col("n_7") > 0, F.col("n_7"))), FEATURES, "country")
    return Pipeline(stages=stages).fit(df.where("fold <= 1998")).transform(df).select("country", "day", vector_to_array("x").alias("x"))


@query("trn_02")
def trn_02(spark, sf):
    train, val, test = splits(learnable(spark, sf))
    _, model = learning.chosen_linear(train, val, FEATURES, "y")
    return learning.apply(model, test).select("country", "day", "y", "p")


@query("trn_03")
def trn_03(spark, sf):
    """All six years after the first, each predicted from the years before it; the models are written as they are fitted."""
    df = materialize(learning.folds_by_time(learnable(spark, sf).drop("fold"), "day", 6), "folds")
    return learning.out_of_fold(df, "fold", FEATURES, "y", fresh_path(spark, "fold_models")).select("country", "day", "fold", "y", "p")


@query("trn_04")
def trn_04(spark, sf):
    p = predictions(spark, sf)
    past, val = p.where("day < '2024-01-12'"), p.where("day >= '2024-01-12'")
    _, model = learning.stacked(past, val, ["p", "q"], "y")
    return learning.apply(model, val, "meta").select("doc_id", "y", "meta")


@query("trn_05")
def trn_05(spark, sf):
    df = materialize(predictions(spark, sf).withColumns({"r": (F.col("p") + F.col("q")) / 2, "fold": F.dayofmonth("day") % 3}), "folds")
    picked = learning.forward_selection(df, ["p", "q", "r"], "y", "fold")
    ap = evaluate.average_precision(df.withColumn("b", sum((F.col(c) for c in picked), F.lit(0.0))), "b", "y", ["fold"])
    return ap.withColumn("models", F.lit(",".join(picked)))


@query("trn_06")
def trn_06(spark, sf):
    train, val, _ = splits(learnable(spark, sf))
    return learning.ablation(train, val, {"counts": ["n_7", "n_30"], "amounts": ["amount_7"]}, "y")


@query(
    "trn_07",
    "SELECT country, day, round(coalesce((n - m) / nullif(s, 0), 0), 5) + 0.0 AS n_z FROM op LEFT "
    "JOIN (SELECT country, avg(n) AS m, stddev_pop(n) AS s FROM op WHERE day < DATE '2000-01-01' GROUP BY country) USING (country)",
    ctes=OWN,
)
def trn_07(spark, sf):
    df = learning.scaled_per_key(order_panel(spark, sf), ["n"], F.col("day") < "2000-01-01")
    return df.select("country", "day", (F.round("n_z", 5) + F.lit(0.0)).alias("n_z"))


@query(
    "trn_08",
    "SELECT country, count(*) AS days FROM op JOIN (SELECT country, quantile_cont(n, 0.75) AS q FROM op GROUP BY country) USING (country) "
    "WHERE n <= q AND (country <> 'NATION_1' OR day < DATE '1999-05-01' - 240) GROUP BY country",
    ctes=OWN,
)
def trn_08(spark, sf):
    cases = spark.createDataFrame([("NATION_1", "1999-05-01")], "country string, d string").select("country", F.to_date("d").alias("case_day"))
    return learning.normal_days(order_panel(spark, sf), "n", cases).groupBy("country").agg(F.count("*").alias("days"))


@query("trn_09", "SELECT round(least((1 - avg(y)) / avg(y), 20), 6) AS weight FROM pred")
def trn_09(spark, sf):
    w = learning.class_weight(predictions(spark, sf), "y")
    return spark.range(1).select(r6(F.lit(w)).alias("weight"))


@query(
    "trn_10",
    "SELECT country, day, a.n_error, a.heavy, b.n, round(b.intensity, 9) + 0.0 AS intensity "
    "FROM (SELECT country, day, count(*) FILTER (root = 'error') AS n_error, count(*) FILTER (fatalities >= 8) AS heavy FROM news "
    "GROUP BY ALL) a JOIN (SELECT country, day, count(*) AS n, avg(intensity) AS intensity FROM news WHERE mentions >= 10 "
    "GROUP BY ALL) b USING (country, day)",
)
def trn_10(spark, sf):
    from riskloom.plans.fixtures import news

    n = news(spark, sf)
    a = n.groupBy("country", "day").agg(F.count_if(F.col("root") == "error").alias("n_error"), F.count_if(F.col("fatalities") >= 8).alias("heavy"))
    b = n.where("mentions >= 10").groupBy("country", "day").agg(F.count("*").alias("n"), (F.round(F.avg("intensity"), 9) + F.lit(0.0)).alias("intensity"))
    return a.join(b, ["country", "day"])


@query("cal_01")
def cal_01(spark, sf):
    p = predictions(spark, sf)
    return learning.apply(learning.platt(p.where("day < '2024-01-12'"), "p", "y"), p, "calibrated").select("doc_id", "p", "calibrated")


@query("cal_02")
def cal_02(spark, sf):
    p = predictions(spark, sf)
    return learning.isotonic(p.where("day < '2024-01-12'"), "p", "y", p).select("doc_id", "p", "calibrated")


@query("scr_03")
def scr_03(spark, sf):
    train, val, test = splits(learnable(spark, sf).withColumn("y", 1 - F.col("y")))
    model, cut = learning.calm_fit(train, val, FEATURES, "y")
    return learning.apply(model, test).select("country", "day", "p", (F.col("p") >= cut).cast("int").alias("calm"))
