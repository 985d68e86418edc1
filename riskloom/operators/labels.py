"""Forward-looking labels on a dense panel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.windows import Roll, forward, rolled


def labelled(panel: DataFrame, horizon: int = 3, quiet: int = 14, centred: bool = False, keys: Sequence[str] = ("country",)) -> DataFrame:
    """From events and deaths per day: y (any event ahead), y_onset (after ``quiet`` days without) and y_escalation (onset, or a forward
    daily mean above mean + 2 std of the past, or a death where the past is flat at 0).  Days without a whole horizon go."""
    df = rolled(panel, [Roll("past_n", "events", "sum", quiet, 1, fill=0), Roll("past_mean", "events", "avg", quiet, 1, fill=0.0), Roll("past_std", "events", "std", quiet, 1, 2, 0.0)], keys)
    df = forward(df, "events", "ahead", horizon, keys=keys, centred=centred)
    df = forward(df, "deaths", "ahead_deaths", horizon, keys=keys, centred=centred).where("ahead is not null")
    onset = (F.col("past_n") == 0) & (F.col("ahead") > 0)
    jump = F.col("ahead") / horizon > F.col("past_mean") + 2 * F.col("past_std")
    flat = (F.col("past_mean") == 0) & (F.col("past_std") == 0) & (F.col("ahead_deaths") > 0)
    return df.withColumns({"y": (F.col("ahead") > 0).cast("int"), "y_onset": onset.cast("int"), "y_escalation": (onset | jump | flat).cast("int")})


def any_ahead(df: DataFrame, flag: str, days: int, out: str, keys: Sequence[str] = ("country",)) -> DataFrame:
    """1 if the flag is set in any of the next rows; null unless all of them are there."""
    return forward(df, flag, out, days, "max", keys=keys)


def before_peaks(df: DataFrame, value: str, bound: float, days: int, out: str, keys: Sequence[str] = ("country",), order: str = "day") -> DataFrame:
    """Marks the ``days`` rows before a row whose value is over ``bound``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, days)
    return df.withColumn(out, F.coalesce((F.max(value).over(w) > bound).cast("int"), F.lit(0)))
