"""Joins with guards: assembly of feature groups, as-of by ranges, neighbours, row-count checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import clip
from riskloom.operators import dealt


def assembled(base: DataFrame, groups: Sequence[tuple[DataFrame, float, str | None]], keys: Sequence[str] = ("country", "day")) -> DataFrame:
    """Left-joins feature groups (rows, fill, name of a missing mask) to ``base`` on shared keys."""
    out = base
    for group, fill, mask in groups:
        own = [c for c in group.columns if c not in keys]
        out = out.join(group.withColumn(mask, F.lit(0)) if mask else group, list(keys), "left").na.fill(fill, own)
        if mask:
            out = out.na.fill(1, [mask])
    return out


def merged(groups: Sequence[DataFrame], keys: Sequence[str] = ("country", "day"), fill: float = 0) -> DataFrame:
    """Full outer join of groups, gaps filled."""
    out = groups[0]
    for g in groups[1:]:
        out = out.join(g, list(keys), "full")
    return out.na.fill(fill, [c for c in out.columns if c not in keys])


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """For each left row the latest right ``value`` at or before its time; of several at one time the largest, and null ones count for nothing.  A union, and
    the last known value carried along ranges of key and time: no range join, and a key with most of the rows is many ranges."""
    known = right.where(F.col(value).isNotNull()).groupBy(key, at).agg(F.max(value).alias("_v"))
    b = known.select(key, at, "_v", F.lit(0).alias("_side"))
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    both = a.unionByName(b, allowMissingColumns=True)
    return dealt.carried(both, [F.col(at).asc_nulls_first(), F.col("_side").asc()], "_v", out, [key]).where("_side = 1").drop("_side", "_v")


def unique(df: DataFrame, keys: Sequence[str]) -> bool:
    return df.groupBy(*keys).count().where("count > 1").isEmpty()


def row_preserving(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A left join that cannot add rows: the right keys must be unique."""
    if not unique(right, keys):
        raise ValueError(f"right side repeats {list(keys)}")
    return left.join(right, list(keys), "left")


def lossless(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """An inner join that must keep every row of both sides."""
    if not left.join(right, list(keys), "left_anti").isEmpty() or not right.join(left, list(keys), "left_anti").isEmpty():
        raise ValueError("rows would be lost")
    return left.join(right, list(keys))


def hot_neighbours(edges: DataFrame, hot: DataFrame, bonus: float = 1.5, most: float = 5.0) -> DataFrame:
    """edges (country, neighbour) and hot countries to country, hot_neighbours, bonus."""
    near = edges.join(hot.select(F.col("country").alias("neighbour")).distinct(), "neighbour", "left_semi")
    return near.groupBy("country").agg(F.count("*").alias("hot_neighbours")).withColumn("bonus", clip(F.col("hot_neighbours") * bonus, 0, most))
