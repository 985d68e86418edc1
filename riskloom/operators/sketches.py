"""Quantile sketches as stored rows: one per group and load, merged when they are asked, so that no load is read again.

They stand beside the exact percentiles of ``dealt``.  A sketch keeps some hundred values (k of 200), so the rank of a percentile is off by about 1.3 % at most
with 99 % confidence, however many loads are merged.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.operators import dealt


def sketched(rows: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """A load's rows to keys, n and sketch (a few kilobytes), to be appended to a table.  Null values do not count, and null keys are groups."""
    known = rows.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double")).alias("sketch"))


def merged(stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of several loads to one per group; the result may be stored in their place."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def percentiles(stored: DataFrame, q: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """Percentiles of all loads' rows, one row per group, with their number n."""
    return merged(stored, keys).select(*keys, "n", *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(x))).alias(name) for name, x in q.items()])


def off(rows: DataFrame, found: DataFrame, value: str, q: Mapping[str, float], keys: Sequence[str]) -> DataFrame:
    """How far each percentile's rank is from where it should be, at most over ``q``, per group: 0 where it lies between the ranks of its ties."""
    both = dealt.attached(rows.where(F.col(value).isNotNull()), found, keys)
    share = lambda hit: F.avg(hit.cast("int"))
    gaps = [F.greatest(share(F.col(value) < F.col(name)) - x, x - share(F.col(value) <= F.col(name)), F.lit(0.0)) for name, x in q.items()]
    return both.groupBy(*keys).agg((F.greatest(*gaps) if len(gaps) > 1 else gaps[0]).alias("off"), F.count("*").alias("n"))
