"""Ranks, tiers, first and latest rows, top-k.  Ranks within groups of any size are dealt by range (``dealt``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators import dealt


def _over(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def percentile_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """Percentile rank x 100; ties share their mean rank; a single row has 100."""
    p = dealt.placed(df, value, keys)
    return p.withColumn(out, (F.col("upto") - F.col("equal") + (F.col("equal") + 1) / 2) / F.col("rows") * 100).drop("equal", "upto", "rows")


def rank_score(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank from 1, largest first, and 100 x (1 - (rank - 1) / (n - 1)); a single row has 100."""
    p = dealt.placed(df, value, keys, down=True).withColumn("rank", (F.col("upto") - F.col("equal") + 1).cast("int"))
    return p.withColumn("rank_score", 100 * (1 - _share(F.col("rank") - 1, F.col("rows") - 1))).drop("equal", "upto", "rows")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def shares(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    p = dealt.placed(df, value, keys)
    before = F.col("upto") - F.col("equal")
    return p.withColumns({"percent_rank": _share(before, F.col("rows") - 1), "cume_dist": F.col("upto") / F.col("rows")}).drop("equal", "upto", "rows")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows per key; the limit is pushed below the shuffle."""
    return df.withColumn("_k", F.row_number().over(_over(keys).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def at_latest(df: DataFrame, day: str, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of the table's last day, one per key."""
    last = df.agg(F.max(day).alias("_last"))
    return first_rows(df.join(F.broadcast(last), F.col(day) == F.col("_last")).drop("_last"), keys, order)


def top_fraction(df: DataFrame, score: str, fraction: float, ties: str, keys: Sequence[str] = (), up: bool = False) -> DataFrame:
    """Flag of the max(1, floor or ceil of n x fraction) best rows."""
    placed = dealt.running(df, [F.col(score).desc(), F.col(ties)], {"best place": F.lit(1)}, keys, {"best place": "all places"})
    k = F.greatest(F.lit(1), (F.ceil if up else F.floor)(F.col("all places") * fraction))
    return placed.withColumn("top", F.col("best place") <= k).drop("best place", "all places")


def tier(score: Column, steps: Sequence[tuple[float, str]], below: str) -> Column:
    """The first name whose bound is reached, from the top down."""
    out = F.when(F.lit(False), F.lit(below))
    for bound, name in steps:
        out = out.when(score >= bound, F.lit(name))
    return out.otherwise(F.lit(below))
