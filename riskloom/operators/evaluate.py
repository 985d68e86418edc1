"""Metrics of scored rows.

Rows with equal scores are one cut-off: they are counted first, so that cumulative sums run over distinct scores, dealt by range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import clip, div, safe
from riskloom.operators import dealt
from riskloom.session import materialize


def cutoffs(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Per distinct score: tp and n at or above it, positives in all, and the step in recall."""
    per = materialize(df.groupBy(*keys, score).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("long")).alias("_p")), "cutoffs")
    return dealt.running(per, [F.col(score).desc()], {"n": F.col("_n"), "tp": F.col("_p")}, keys, {"n": "rows", "tp": "positives"})


def average_precision(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps x precision, ties as one step; null without positives."""
    c = cutoffs(df, score, y, keys)
    return c.groupBy(*keys).agg(F.sum(div("_p", "positives") * div("tp", "n")).alias("ap"))


def roc_auc(df: DataFrame, score: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """From rank sums with mean ranks for ties."""
    c = cutoffs(df, score, y, keys)
    below = F.col("rows") - F.col("n")  # rows with a lower score
    ranks = F.sum(F.col("_p") * (below + (F.col("_n") + 1) / 2))
    p, n = F.max("positives").cast("double"), F.max("rows").cast("double")
    return c.groupBy(*keys).agg(div(ranks - p * (p + 1) / 2, p * (n - p)).alias("auc"))


def at_threshold(df: DataFrame, score: str, y: str, bound: float) -> DataFrame:
    hit = F.col(score) >= bound
    tp, n, p = F.count_if(hit & (F.col(y) == 1)), F.count_if(hit), F.count_if(F.col(y) == 1)
    return df.agg(safe(tp, n).alias("precision"), safe(tp, p).alias("recall"), safe(2 * tp, n + p).alias("f1"))


def best_f1(df: DataFrame, score: str, y: str) -> DataFrame:
    """The cut-off with the best F1; the highest score on ties."""
    c = cutoffs(df, score, y).withColumn("f1", safe(2 * F.col("tp"), F.col("n") + F.col("positives")))
    return c.agg(F.max_by(score, F.struct("f1", score)).alias("threshold"), F.max("f1").alias("f1"))


def recall_at_precision(df: DataFrame, score: str, y: str, least: float) -> DataFrame:
    c = cutoffs(df, score, y).where(div("tp", "n") >= least)
    return c.agg(F.coalesce(F.max(div("tp", "positives")), F.lit(0.0)).alias("recall"))


def at_top(df: DataFrame, score: str, y: str, fraction: float, ties: str) -> DataFrame:
    from riskloom.operators.ranks import top_fraction

    t = top_fraction(df, score, fraction, ties)
    tp = F.count_if(F.col("top") & (F.col(y) == 1))
    return t.agg(safe(tp, F.count_if("top")).alias("precision"), safe(tp, F.count_if(F.col(y) == 1)).alias("recall"))


def brier(p: str, y: str) -> Column:
    return F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y)))


def calibration(df: DataFrame, p: str, y: str, bins: int = 10, more: Sequence[str] = ()) -> DataFrame:
    """Equal bins of p, the last closed: rows, positive rate, mean scores."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), *[F.avg(c).alias(f"mean_{c}") for c in (p, *more)])


def expected_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    c = calibration(df, p, y, bins)
    return c.agg((F.sum(F.col("n") * F.abs(F.col("rate") - F.col(f"mean_{p}"))) / F.sum("n")).alias("ece"))


def lead_times(positives: DataFrame, scored: DataFrame, cut: float, key: str = "country", day: str = "day", score: str = "p") -> DataFrame:
    """Days from the latest alert at or before each positive day."""
    from riskloom.operators.joins import as_of

    alerts = scored.where(F.col(score) >= cut).select(key, day, F.col(day).alias("alert"))
    return as_of(positives.select(key, day), alerts, key, day, "alert", "alert_day").where("alert_day is not null").withColumn("lead", F.datediff(day, "alert_day"))


def backtest(df: DataFrame, score: str, y: str, cut: float, ties: str, day: str = "day") -> DataFrame:
    """Precision of each day's 5 and 10 best, lift over the base rate, alerts per day, alert precision and recall."""
    k = df.withColumn("_k", F.row_number().over(Window.partitionBy(day).orderBy(F.col(score).desc(), ties)))
    pos, al = F.col(y) == 1, F.col(score) >= cut
    base = F.avg(F.col(y).cast("double"))
    p = lambda n: safe(F.count_if((F.col("_k") <= n) & pos), F.count_if(F.col("_k") <= n))
    return k.agg(p(5).alias("p_at_5"), p(10).alias("p_at_10"), safe(p(5), base).alias("lift_at_5"), safe(F.count_if(al), F.count_distinct(day)).alias("alerts_per_day"), safe(F.count_if(al & pos), F.count_if(al)).alias("alert_precision"), safe(F.count_if(al & pos), F.count_if(pos)).alias("alert_recall"))


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], most: float = 1e-4) -> DataFrame:
    """Largest difference per column of two builds, rows that only one has, and whether it is within bounds."""
    j = a.select(*keys, *columns, F.lit(1).alias("_a")).join(b.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(1).alias("_b")), list(keys), "full")
    row = j.agg(F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("unmatched"), *[F.max(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c) for c in columns])
    return row.unpivot("unmatched", list(columns), "feature", "max_diff").withColumn("passed", (F.coalesce("max_diff", F.lit(0.0)) < most) & (F.col("unmatched") == 0))


#: Up to so many columns each pair is an aggregate of its own.
FEW = 8


def _correlation(x: str, y: str) -> Column:
    """Over rows where neither is null; null without spread, where the built-in one is an error."""
    both = lambda c, other: F.stddev_pop(F.when(F.col(other).isNotNull(), F.col(c)))
    return div(F.covar_pop(x, y), both(x, y) * both(y, x))


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every pair once: a, b, r.  Rows where either is null do not count for a pair; r is null without spread."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    if len(columns) > FEW:
        return gram_correlations(df, columns)
    row = df.agg(*[_correlation(x, y).alias(f"{x}~{y}") for x, y in pairs])
    long = row.unpivot([], [f"{x}~{y}" for x, y in pairs], "pair", "r")
    return long.select(F.split("pair", "~")[0].alias("a"), F.split("pair", "~")[1].alias("b"), "r")


#: Where sums of squares exceed the spread by this factor, their difference has lost too many places.
LOST = 1e6


def gram_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """As ``correlations``, for hundreds of columns: means first, then sums of products about them of all pairs at once, as matrices, one set for each task,
    added by pair.  NaN counts as null.  The few pairs whose common rows lie close together but far from their columns' means are computed one by one."""
    names, spark = list(columns), df.sparkSession
    rows = materialize(df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(names)]), "columns")
    facts = rows.agg(*[F.struct(F.avg(c).alias("mean"), F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in rows.columns]).first()
    centre = np.array([0.0 if f.mean is None else f.mean for f in facts])
    flat = [i for i, f in enumerate(facts) if f.low == f.high]

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for frame in frames:
            x = frame.to_numpy(float) - centre
            there = np.isfinite(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            own = np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
            total = own if total is None else total + own
        if total is not None:
            i, j = np.triu_indices(len(centre), 1)
            n, s, q, xy = total
            yield pd.DataFrame({"i": i, "j": j, "n": n[i, j], "sx": s[i, j], "sy": s[j, i], "sxx": q[i, j], "syy": q[j, i], "sxy": xy[i, j]})

    sums = ("n", "sx", "sy", "sxx", "syy", "sxy")
    per = rows.mapInPandas(products, "i int, j int, " + ", ".join(f"{c} double" for c in sums)).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in sums])
    spread = lambda s, q: F.greatest(F.col(q) - div(F.col(s) * F.col(s), "n"), F.lit(0.0))
    r = div(F.col("sxy") - div(F.col("sx") * F.col("sy"), "n"), F.sqrt(spread("sx", "sxx")) * F.sqrt(spread("sy", "syy")))
    lost = (spread("sx", "sxx") * LOST < F.col("sxx")) | (spread("sy", "syy") * LOST < F.col("syy"))
    const = F.col("i").isin(*flat) | F.col("j").isin(*flat) if flat else F.lit(False)
    found = materialize(per.select("i", "j", F.when(~const, r).alias("r"), (lost & ~const).alias("lost")), "pairs")
    again, exact = [(x.i, x.j) for x in found.where("lost").select("i", "j").collect()], []
    for k in range(0, len(again), 100):
        part = again[k : k + 100]
        row = rows.agg(*[_correlation(f"c{i}", f"c{j}").alias(f"{i}~{j}") for i, j in part]).first()
        exact += [(i, j, x) for (i, j), x in zip(part, row, strict=True)]
    out = found.where("not lost").select("i", "j", "r").unionByName(spark.createDataFrame(exact, "i int, j int, r double"))
    label = F.array(*map(F.lit, names))
    return out.select(F.get(label, F.col("i")).alias("a"), F.get(label, F.col("j")).alias("b"), "r")


def assertions(df: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
    """One row: repeated keys, values outside 0-1, passed."""
    once = df.groupBy(*keys).agg(F.count("*").alias("c"), F.count_if(~F.col(p).between(0, 1) | F.col(p).isNull()).alias("o"))
    return once.agg(F.count_if(F.col("c") > 1).alias("repeated"), F.coalesce(F.sum("o"), F.lit(0)).alias("outside")).withColumn("passed", (F.col("repeated") == 0) & (F.col("outside") == 0))


def compared(candidate: DataFrame, base: DataFrame) -> DataFrame:
    """(metric, value) tables of two models side by side, with differences."""
    j = candidate.select("metric", F.col("value").alias("candidate")).join(base.select("metric", F.col("value").alias("base")), "metric")
    return j.select("metric", F.round("candidate", 4).alias("candidate"), F.round("base", 4).alias("base"), F.round(F.col("candidate") - F.col("base"), 4).alias("delta"))


def metrics(df: DataFrame, p: str, y: str, ties: str) -> DataFrame:
    """A report: metric, value."""
    parts = [average_precision(df, p, y).select(F.lit("ap").alias("metric"), F.col("ap").alias("value")), roc_auc(df, p, y).select(F.lit("auc"), "auc"), df.agg(brier(p, y).alias("v")).select(F.lit("brier"), "v"), expected_error(df, p, y).select(F.lit("ece"), "ece"), at_top(df, p, y, 0.05, ties).select(F.lit("precision_top5"), "precision")]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


def adjusted_skewness(c: str) -> Column:
    """Bias-adjusted, as samples are; null below three rows."""
    n = F.count(c).cast("double")
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def decile_lift(df: DataFrame, score: str, y: str, bins: int = 10) -> DataFrame:
    """Equal-frequency bins between distinct quantile edges: rows, rate, lift over the base rate."""
    cuts = dealt.percentiles(df, score, {f"q{k}": k / bins for k in range(1, bins)}, ())
    edges = cuts.select(F.array_distinct(F.array(*cuts.columns)).alias("_e"))
    base = df.agg(F.avg(F.col(y).cast("double")).alias("_base"))
    b = df.join(F.broadcast(edges)).join(F.broadcast(base)).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(score))))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("rate"), F.max("_base").alias("_base")).withColumn("lift", safe("rate", "_base")).drop("_base")


def persistence(count: str, width: int) -> Column:
    return clip(F.col(count) / width, 0, 1)
