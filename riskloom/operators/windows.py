"""Rolling, lagged and standardised columns, described as data and compiled to one ``select`` per (keys, order), so that all
of them share one sort."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import clip, div, safe

_AGG = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "count": F.count}


@dataclass(frozen=True)
class Roll:
    """``agg`` of ``value`` over ``width`` rows that end ``lag`` rows before this one; null below ``least`` rows.

    ``by="rows"`` counts rows (calendar days on a dense grid); ``by="days"`` counts calendar days over sparse rows.
    """

    out: str
    value: str
    agg: str
    width: int
    lag: int = 0
    least: int = 0
    fill: float | None = None
    by: str = "rows"


def frame(keys: Sequence[str], order: str, width: int, lag: int, by: str = "rows"):
    first, last = -(width + lag - 1), -lag
    if by == "days":
        return Window.partitionBy(*keys).orderBy(F.unix_date(order)).rangeBetween(first, last)
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)


def rolled(df: DataFrame, specs: Sequence[Roll], keys: Sequence[str] = ("country",), order: str = "day") -> DataFrame:
    """``df`` with one column per spec."""
    out: list[Column] = []
    for s in specs:
        w = frame(keys, order, s.width, s.lag, s.by)
        x = _AGG[s.agg](s.value).over(w)
        if s.least:
            x = F.when(F.count(s.value).over(w) >= s.least, x)
        if s.fill is not None:
            x = F.coalesce(x, F.lit(s.fill))
        out.append(x.alias(s.out))
    return df.select("*", *out)


def ratio(df: DataFrame, parts: dict[str, tuple[str, str]], eps: float | None = None) -> DataFrame:
    """out = a / b for each out: (a, b); 0 where b is 0, or with ``eps`` added to b."""
    return df.select("*", *[(safe(a, b) if eps is None else F.col(a) / (F.col(b) + F.lit(eps))).alias(out) for out, (a, b) in parts.items()])


def accelerated(short: str, n: int, long: str, m: int, eps: float = 1e-6) -> Column:
    """The recent daily rate over the longer one."""
    return (F.col(short) / n) / (F.col(long) / m + F.lit(eps))


def zscore(df: DataFrame, value: str, out: str, width: int, lag: int, least: int, keys: Sequence[str] = ("country",), order: str = "day", bound: float | None = None, empty: float | None = 0.0) -> DataFrame:
    """(value - mean) / std over a trailing frame; ``empty`` with fewer than ``least`` rows or no spread; clipped to ``bound``."""
    w = frame(keys, order, width, lag)
    mean, std, n = F.avg(value).over(w), F.stddev_samp(value).over(w), F.count(value).over(w)
    z = F.when((n >= least) & (std > 1e-12), (F.col(value) - mean) / std)
    z = F.coalesce(z, F.lit(empty)) if empty is not None else z
    return df.withColumn(out, z if bound is None else clip(z, -bound, bound))


def changes(df: DataFrame, value: str, keys: Sequence[str] = (), order: str = "day") -> DataFrame:
    """Lagged level and percent changes over 1 and 7 rows, all known a row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    one, two, eight = (F.lag(value, n).over(w) for n in (1, 2, 8))
    return df.select("*", one.alias(f"{value}_lag1"), ((div(one, two) - 1) * 100).alias(f"{value}_chg1"), ((div(one, eight) - 1) * 100).alias(f"{value}_chg7"))


def forward(df: DataFrame, value: str, out: str, days: int, agg: str = "sum", whole: bool = True, keys: Sequence[str] = ("country",), order: str = "day", centred: bool = False) -> DataFrame:
    """``agg`` over the next ``days`` rows; null unless all are there if ``whole``.  ``centred`` takes rows -1 to 1 instead."""
    first, last = (-1, 1) if centred else (1, days)
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)
    x = _AGG[agg](value).over(w)
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) == days, x) if whole and not centred else x)


def sequences(df: DataFrame, values: Sequence[str], width: int, keys: Sequence[str] = ("country",), order: str = "day") -> DataFrame:
    """The last ``width`` rows as a matrix (array of arrays), where there are that many."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumn("matrix", F.collect_list(F.array(*[F.col(v).cast("double") for v in values])).over(w)).where(F.size("matrix") == width)
