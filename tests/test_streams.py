"""Streams whose rows come late, again or after a failure."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom import streaming
from riskloom.operators.grid import dense
from riskloom.operators.windows import Roll
from riskloom.streaming.jobs import merged_moments, reach

EVENTS = "event_id long, ingested timestamp, day date, v long"


def at(hour, minute=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute)


def event(i, stamp, v=0):
    return (i, stamp, stamp.date() if stamp else dt.date(2024, 1, 9), v)


def land(spark, path, rows):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def stored(spark, path):
    return sorted((r.event_id, r.v) for r in spark.read.schema(EVENTS).parquet(path).collect())


@pytest.mark.parametrize("fixed", [False, True])
def test_late_events_are_stored_once(spark, tmp_path, fixed):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("land", "events", "checkpoint"))

    def run():
        streaming.insert_events(streaming.landed(spark, landing, EVENTS, 1), path, checkpoint=checkpoint, fixed_stamps=fixed)

    steps = [[event(1, at(12))], [event(2, at(13)), event(2, at(13))], [event(3, at(9))], [event(3, at(9)), event(1, at(12)), event(2, at(13)), event(4, None)], [event(4, None), event(None, at(14)), event(None, at(8))]]
    want = [[1], [1, 2], [1, 2, 3], [1, 2, 3, 4], [1, 2, 3, 4, None, None]]
    for rows, ids in zip(steps, want, strict=True):
        land(spark, landing, rows)
        run()
        assert sorted((r.event_id for r in spark.read.schema(EVENTS).parquet(path).collect()), key=lambda i: (i is None, i or 0)) == ids


def test_an_event_under_a_new_stamp_is_stored_once(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("land", "events", "checkpoint"))
    for rows in ([event(1, at(1))], [event(2, at(9))], [(1, at(10), dt.date(2024, 1, 1), 7)]):
        land(spark, landing, rows)
        streaming.insert_events(streaming.landed(spark, landing, EVENTS, 1), path, checkpoint=checkpoint)
    assert stored(spark, path) == [(1, 0), (2, 0)]


@pytest.mark.parametrize(("fixed", "broken"), [(False, "noted"), (False, "prompt"), (True, "parted"), (True, "prompt"), (True, "late")])
def test_a_failure_between_the_paths_repeats_nothing(spark, tmp_path, fixed, broken):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("land", "events", "checkpoint"))
    land(spark, landing, [event(1, at(12)), event(2, at(13))])
    stream = lambda: streaming.landed(spark, landing, EVENTS, 1)
    streaming.insert_events(stream(), path, checkpoint=checkpoint, fixed_stamps=fixed)
    land(spark, landing, [event(3, at(13, 30)), event(2, at(13)), event(4, at(2)), event(1, at(12)), event(5, at(13, 40))])

    def lost(name, number):
        if name == broken:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        streaming.insert_events(stream(), path, checkpoint=checkpoint, fixed_stamps=fixed, step=lost)
    streaming.insert_events(stream(), path, checkpoint=checkpoint, fixed_stamps=fixed)
    assert [i for i, _ in stored(spark, path)] == [1, 2, 3, 4, 5]


def test_keys_of_old_batches_are_forgotten(spark, tmp_path):
    landing, path, checkpoint = (str(tmp_path / x) for x in ("land", "events", "checkpoint"))
    for k in range(5):
        land(spark, landing, [event(k, at(k * 2))])
        streaming.insert_events(streaming.landed(spark, landing, EVENTS, 1), path, checkpoint=checkpoint)
    assert spark.read.parquet(f"{checkpoint}-recent").count() < 4 and len(stored(spark, path)) == 5


def test_moments_of_batches_are_those_of_all_rows():
    rng = np.random.default_rng(3)
    x = 1e6 + rng.normal(size=700)
    state, means, spread = (0, 0.0, 0.0), [], []
    for part in np.split(x, [1, 2, 50, 300]):
        m, s, state = merged_moments(part, state)
        means += m.tolist()
        spread += s.tolist()
    assert np.allclose(means, np.cumsum(x) / np.arange(1, 701), rtol=1e-12)
    assert np.allclose(spread[1:], [x[: k + 1].std(ddof=1) for k in range(1, 700)], rtol=1e-6) and spread[0] == 0


def test_keyed_state_leaves_the_session_as_it_was(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(key, None)
    with streaming.keyed_state(spark, 3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3" and "RocksDB" in spark.conf.get(key)
    assert (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get(key, None)) == was


ROLLS = [Roll("n3", "n", "sum", 3, 1, fill=0), Roll("v5", "v", "avg", 5), Roll("top", "v", "max", 4, 2, fill=0)]
PANEL = "event_id long, ingested timestamp, country string, day date, v long"


def panel_rows(seed):
    rng = random.Random(seed)
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in rng.sample(range(40), 12)]
    return [(i, dt.datetime.combine(d, dt.time(rng.randrange(24))), rng.choice("ABC"), d, rng.randrange(9)) for i, d in enumerate(rng.choices(days, k=60))]


def test_a_fed_panel_is_the_batch_panel_after_any_order(spark, tmp_path):
    seed = 1
    landing, root, checkpoint = (str(tmp_path / x) for x in ("land", "fed", "checkpoint"))
    rows = panel_rows(seed)
    random.Random(seed).shuffle(rows)
    members = spark.createDataFrame([(c,) for c in "ABCD"], "country string")
    measures = {"n": F.count("*"), "v": F.sum("v")}
    for part in (rows[:20], rows[20:25] + rows[3:6], rows[25:]):
        spark.createDataFrame(part, PANEL).coalesce(1).write.mode("append").parquet(landing)
        streaming.feed_panel(streaming.landed(spark, landing, PANEL, 1), root, members, measures, ROLLS, checkpoint=checkpoint)
        so_far = rows[:20] if part is not rows[25:] and part[0] is rows[0] else rows[:25] if part[0] is rows[20] else rows
        ev = spark.createDataFrame(so_far, PANEL)
        daily = ev.groupBy("country", "day").agg(*[c.alias(k) for k, c in measures.items()])
        want = streaming.panel_of(daily, dense(ev, members), ROLLS)
        got = spark.read.schema(want.schema).parquet(f"{root}/panel").select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_change_writes_only_the_days_it_reaches(spark, tmp_path):
    landing, root, checkpoint = (str(tmp_path / x) for x in ("land", "fed", "checkpoint"))
    members = spark.createDataFrame([("A",), ("B",)], "country string")
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(k), "A", dt.date(2024, 1, 1) + dt.timedelta(k), 1) for k in range(60)]

    def feed(part):
        spark.createDataFrame(part, PANEL).coalesce(1).write.mode("append").parquet(landing)
        streaming.feed_panel(streaming.landed(spark, landing, PANEL, 1), root, members, {"n": F.count("*"), "v": F.sum("v")}, ROLLS, checkpoint=checkpoint)

    def files():
        return {r[0]: r[1] for r in spark.read.parquet(f"{root}/panel").select("day", "_metadata.file_modification_time").distinct().collect()}

    feed(rows)
    before = files()
    feed([(100, dt.datetime(2024, 1, 20, 5), "B", dt.date(2024, 1, 20), 5)])
    after = files()
    changed = {d for d in after if after[d] != before.get(d)}
    assert changed == {dt.date(2024, 1, 20) + dt.timedelta(k) for k in range(reach(ROLLS) + 1)}


def test_the_last_half_second_of_a_bucket_is_its_own(spark, tmp_path):
    """Against the query's SQL, on stamps just before and at the ends of buckets, before 1970 too."""
    stamps = [dt.datetime(2024, 1, 1, 11, 59, 59, 700_000), dt.datetime(2024, 1, 1, 12), dt.datetime(2024, 1, 1, 23, 59, 59, 999_999), dt.datetime(1969, 12, 31, 11, 59, 59, 700_000), dt.datetime(1969, 12, 31, 12)]
    rows = [(i, t, 0, "view", 1.0, '{"k": 1}') for i, t in enumerate(stamps)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, "NATION_0", 0)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    con = duckdb.connect()
    for t in ("events", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(con.execute(f"SELECT country, start, n FROM ({entry.oracle_sql()['st_05']})").fetchall())
    got = sorted((r.country, r.start, r.n) for r in entry.queries()["st_05"](spark, str(tmp_path)).select("country", F.col("start").cast("timestamp_ntz").alias("start"), "n").collect())
    assert got == want and [n for _, _, n in got] == [1, 1, 1, 2]
