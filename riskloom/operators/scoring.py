"""Scores, tiers, registries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clip, logistic, logit
from riskloom.operators.joins import hot_neighbours
from riskloom.operators.merge import upserted
from riskloom.operators.ranks import first_rows, percentile_rank, rank_score, tier

# Bounds of tiers.
TIERS = [(70, "ALERT"), (50, "WARNING"), (25, "WATCH")]
PERCENT_TIERS = [(98, "severe"), (95, "high"), (85, "elevated")]
BADGES = [(0.75, "high"), (0.55, "medium")]
THRESHOLDS = (40.0, 70.0)


def standardised_logistic(inputs: Mapping[str, tuple[float, float, float]], bias: float, logits: bool) -> Column:
    """inputs[column] = (mean, std, weight); of the column or of its logit."""
    z = F.lit(bias)
    for c, (mean, std, weight) in inputs.items():
        x = logit(c) if logits else F.col(c)
        z = z + (x - mean) / std * weight
    return logistic(z)


def calm_gate(df: DataFrame, inputs: Mapping[str, tuple[float, float, float]], bias: float, threshold: float, past: str | None = None) -> DataFrame:
    """calm from the model where its columns are there, else from a past count of 0, else 1."""
    if all(c in df.columns for c in inputs):
        return df.withColumn("calm", (standardised_logistic(inputs, bias, False) >= threshold).cast("int"))
    return df.withColumn("calm", (F.col(past) == 0).cast("int") if past in df.columns else F.lit(1))


def alert_score(df: DataFrame, prob: str, keys: Sequence[str] = (), share: float = 0.7) -> DataFrame:
    """share x probability x 100 and the rest from the rank score."""
    return rank_score(df, prob, keys).withColumn("alert_score", clip(share * F.col(prob) * 100 + (1 - share) * F.col("rank_score"), 0, 100))


def current_state(df: DataFrame, unrest: str, parts: Sequence[str], pair: tuple[str, str], spike: tuple[str, str]) -> DataFrame:
    """Four parts of 0-100 and their mean: a percentile, a logistic of mean z-scores, a percentile mix, and today over the week's mean."""
    df = percentile_rank(df, unrest, "u")
    for i, c in enumerate(pair):
        df = percentile_rank(df, c, f"_s{i}")
    z = sum((F.col(c) for c in parts), F.lit(0.0)) / len(parts)
    ratio = F.try_divide(F.col(spike[0]), F.col(spike[1]))
    df = df.withColumns({"c": 100 * logistic(z), "s": 0.6 * F.col("_s0") + 0.4 * F.col("_s1"), "i": clip(50 * F.coalesce(ratio, F.lit(0.0)), 0, 100)}).drop("_s0", "_s1")
    return df.withColumn("state", (F.col("u") + F.col("c") + F.col("s") + F.col("i")) / 4)


def with_baseline(df: DataFrame, baseline: DataFrame | None, count: str) -> DataFrame:
    """Column ``baseline`` from a table, or from the percentile of log counts where there is none."""
    if baseline is not None:
        return df.join(baseline.select("country", "baseline"), "country", "left").na.fill(0, ["baseline"])
    return percentile_rank(df.withColumn("_l", F.log1p(count)), "_l", "baseline").drop("_l")


def composite(df: DataFrame, edges: DataFrame, hot: float = 60.0) -> DataFrame:
    """0.2 baseline + 0.4 state + 0.4 forecast + a bonus for hot neighbours, within 0-100."""
    near = hot_neighbours(edges, df.where(F.col("forecast") >= hot).select("country"))
    out = df.join(near, "country", "left").na.fill(0, ["hot_neighbours", "bonus"])
    return out.withColumn("composite", clip(0.2 * F.col("baseline") + 0.4 * F.col("state") + 0.4 * F.col("forecast") + F.col("bonus"), 0, 100))


def tiered(score: Column, steps: Sequence[tuple[float, str]] = TIERS, below: str = "STABLE") -> Column:
    return tier(score, steps, below)


def thresholds(rows: DataFrame, target: str) -> DataFrame:
    """One row: the newest active global thresholds of a target, else the defaults."""
    newest = first_rows(rows.where((F.col("target") == target) & F.col("active") & F.col("country").isNull()), [], [F.col("created").desc()])
    one = rows.sparkSession.range(1).select(F.lit(0).alias("_k"))
    return one.join(F.broadcast(newest.withColumn("_k", F.lit(0))), "_k", "left").select(F.coalesce("medium", F.lit(THRESHOLDS[0])).alias("medium"), F.coalesce("high", F.lit(THRESHOLDS[1])).alias("high"))


def activated(registry: DataFrame, version: DataFrame) -> DataFrame:
    """The registry with a version as the only active one of its target and horizon."""
    keys = ["target", "horizon"]
    others = registry.join(version.select(*keys, F.lit(True).alias("_new")), keys, "left").withColumn("active", F.col("active") & F.col("_new").isNull()).drop("_new")
    return upserted(others.select(*registry.columns), version.withColumn("active", F.lit(True)).select(*registry.columns), [*keys, "version"])
