"""Hand-computed series, and identities of dense-grid frames."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from riskloom.operators import grid, ingest, labels
from riskloom.operators.windows import Roll, forward, rolled, zscore


def series(spark, values, key="A"):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(key, day + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(values)], "country string, day date, v double")


def column(df, c):
    return [r[c] for r in df.orderBy("country", "day").collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=40), width=st.integers(1, 10), lag=st.integers(0, 7))
def test_frames_equal_shift_and_rolling(spark, values, width, lag):
    got = column(rolled(series(spark, values), [Roll("s", "v", "sum", width, lag), Roll("m", "v", "avg", width, lag)]), "s")
    want = pd.Series(values, dtype=float).shift(lag).rolling(width, min_periods=1).sum()
    assert [None if np.isnan(x) else x for x in want] == got


def test_forward_label_and_the_centred_variant(spark):
    df = series(spark, [1, 2, 4, 8, 16, 32])
    assert column(forward(df, "v", "f", 3), "f")[:3] == [14.0, 28.0, 56.0]
    assert column(forward(df, "v", "f", 3), "f")[3:] == [None, None, None]
    assert column(forward(df, "v", "f", 3, whole=False), "f") == [14.0, 28.0, 56.0, 48.0, 32.0, None]
    assert column(forward(df, "v", "f", 3, centred=True), "f")[1:5] == [7.0, 14.0, 28.0, 56.0]


def test_market_change(spark):
    df = series(spark, [20, 22, None, 33]).drop("country").withColumnRenamed("v", "vix")
    got = [r.vix_pct for r in ingest.market_changes(df, ["vix"]).orderBy("day").collect()]
    assert got[0] is None and got[1] == pytest.approx(10.0) and got[2] == pytest.approx(0.0) and got[3] == pytest.approx(50.0)


def test_fill_orders(spark):
    df = series(spark, [None, 1, None, 3, None]).drop("country").withColumn("country", __import__("pyspark").sql.functions.lit("A"))
    assert column(grid.carried(df, ["v"]), "v") == [1.0, 1.0, 1.0, 3.0, 3.0]
    assert column(grid.carried(df, ["v"], back_first=True), "v") == [1.0, 1.0, 3.0, 3.0, 3.0]


def test_zscore_needs_rows_and_spread(spark):
    assert column(zscore(series(spark, [1, 2, 3, 4, 5, 6]), "v", "z", 90, 0, 5), "z")[:4] == [0.0] * 4
    assert column(zscore(series(spark, [2] * 8), "v", "z", 90, 0, 5), "z") == [0.0] * 8


def test_labels_of_a_quiet_then_busy_series(spark):
    df = series(spark, [0] * 15 + [3, 0, 0, 0, 0]).withColumnRenamed("v", "events").withColumn("deaths", __import__("pyspark").sql.functions.lit(0.0))
    out = labels.labelled(df).orderBy("day").collect()
    assert len(out) == 17 and [r.y for r in out][11:15] == [0, 1, 1, 1]
    assert [r.y_onset for r in out][12:16] == [1, 1, 1, 0]


def test_days_and_rows_differ_on_sparse_rows(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, 1 + d), 1.0) for d in (0, 2, 9)], "country string, day date, v double")
    out = rolled(df, [Roll("r", "v", "sum", 2), Roll("d", "v", "sum", 7, by="days")])
    assert column(out, "r") == [1.0, 2.0, 2.0] and column(out, "d") == [1.0, 2.0, 1.0]
