"""Dense calendars and fills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(df: DataFrame, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """All days from the first to the last, of the whole table or per key."""
    ends = (df.groupBy(*keys) if keys else df).agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    return ends.select(*keys, F.explode(F.expr("sequence(_a, _b, interval 1 day)")).alias(day))


def dense(df: DataFrame, members: DataFrame, key: str = "country", day: str = "day") -> DataFrame:
    """Every member on every day between the table's first and last: one row of bounds goes to each member, no product of tables."""
    ends = df.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    grid = members.select(key).distinct().join(F.broadcast(ends))
    return grid.where("_a is not null").select(key, F.explode(F.expr("sequence(_a, _b, interval 1 day)")).alias(day))


def filled(grid: DataFrame, daily: DataFrame, keys: Sequence[str] = ("country", "day"), value: float = 0, only: Sequence[str] | None = None) -> DataFrame:
    """The grid with the daily rows, and ``value`` where there are none."""
    return grid.join(daily, list(keys), "left").na.fill(value, list(only) if only is not None else [c for c in daily.columns if c not in keys])


def carried(df: DataFrame, values: Sequence[str], order: str = "day", keys: Sequence[str] = (), back_first: bool = False) -> DataFrame:
    """Forward fill then back fill, or the other way round."""
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    past, coming = base.orderBy(order).rowsBetween(Window.unboundedPreceding, 0), base.orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    forth, back = {c: F.last(c, ignorenulls=True).over(past) for c in values}, {c: F.first(c, ignorenulls=True).over(coming) for c in values}
    first, second = (back, forth) if back_first else (forth, back)
    return df.select(*[F.coalesce(first[c], second[c]).alias(c) if c in values else F.col(c) for c in df.columns])


def reindexed(df: DataFrame, values: Sequence[str], day: str = "day", back_first: bool = False) -> DataFrame:
    """One row per calendar day, gaps filled from neighbours."""
    return carried(calendar(df, day).join(df, day, "left"), values, day, back_first=back_first)
