"""Streams over landed files.  Each has a batch twin with the same result.

Sinks merge by key inside ``foreachBatch``, so that a batch that is run again after a failure changes nothing; offsets and state are
kept in the checkpoint that the caller names, under the shared folder.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from riskloom.operators import merge
from riskloom.operators.grid import filled
from riskloom.operators.text import extracted
from riskloom.operators.windows import Roll, rolled
from riskloom.session import by_value, fresh_path, materialize
from riskloom.sources import gathered, replace_partitions

by_value(__name__)


def landed(spark: SparkSession, path: str, schema, files_per_batch: int = 4, kind: str = "parquet") -> DataFrame:
    """Files as they land in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(kind).load(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Handles all that is there, then stops.  With the same ``checkpoint`` a later call goes on where the last one, or its failure, left off;
    without one, everything is read anew."""
    where = checkpoint or fresh_path(stream.sparkSession, "stream")
    stream.writeStream.outputMode(mode).option("checkpointLocation", where).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _there(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def _before(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame | None:
    """What the batches before this one noted, each in a folder of its own; None if there are none."""
    if not number or not _there(spark, path):
        return None
    return spark.read.schema(f"{schema}, batch int").parquet(path).where(F.col("batch") < number)


def insert_events(
    stream: DataFrame, path: str, stamp: str = "ingested", key: str = "event_id", partition: str = "day", delay: str = "30 minutes", checkpoint: str | None = None, fixed_stamps: bool = False,
    then: Callable[[list, int], None] | None = None, step: Callable[[str, int], None] | None = None,
) -> None:
    """Events once each by their key, in two paths that are parted before any state is asked.

    The watermark of a batch is the latest stamp of the batches before it less ``delay``.  Rows from it on lose the repeats of keys that came
    within the delay; these keys and their stamps are kept by batch beside the checkpoint.  Rows before it, or without a stamp, are never dropped for
    their age: they are held against the keys of the stored partitions that they touch.  The others are so too, since an event may come again under a
    new stamp, unless ``fixed_stamps`` says that the repeats of an event carry its stamp; then they are only added.

    A batch that runs again reads the same keys of the batches before it, and holds all its rows against what is stored, so nothing repeats
    wherever it stopped.  Rows without a key match nothing and are all stored.  ``then`` gets the partitions of each batch when its rows are stored,
    ``step`` is told how far a batch is.
    """
    spark = stream.sparkSession
    where = checkpoint or fresh_path(spark, "stream")
    recent, told = f"{where}-recent", step or (lambda name, number: None)
    micros = F.unix_micros(F.col(stamp).cast("timestamp"))

    def each(df: DataFrame, number: int) -> None:
        again = _there(spark, f"{recent}/batch={number}")
        rows = materialize(df, "rows")
        batch = materialize(rows.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(rows.where(F.col(key).isNull())), "batch")
        known = _before(spark, recent, f"`{key}` {df.schema[key].dataType.simpleString()}, at long", number)
        mark = known and known.agg(F.unix_micros(F.timestamp_micros(F.max("at")) - F.expr(f"interval {delay}"))).first()[0]
        late = micros.isNull() if mark is None else micros.isNull() | (micros < mark)
        prompt = batch.where(~late)
        if mark is not None:
            prompt = materialize(merge.unseen(prompt, known.where(F.col("at") >= mark), [key]), "prompt")
        told("parted", number)
        prompt.select(key, micros.alias("at")).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{recent}/batch={number}")
        told("noted", number)
        if fixed_stamps and not again:
            gathered(prompt, partition).write.mode("append").partitionBy(partition).parquet(path)
        else:
            merge.append_unseen(spark, path, prompt, [key], partition)
        told("prompt", number)
        merge.append_unseen(spark, path, materialize(batch.where(late), "late"), [key], partition)
        told("late", number)
        if then:
            then(merge.touched(batch, partition), number)
        if mark is not None:
            # no later batch asks for these again
            for old in known.groupBy("batch").agg(F.max("at").alias("last")).where(F.col("last") < mark).collect():
                files, folder = _folder(spark, f"{recent}/batch={old.batch}")
                files.delete(folder, True)

    drain(stream, each, checkpoint=where)


def reach(specs: Sequence[Roll]) -> int:
    """How many rows back the frames go."""
    return max([s.width + s.lag - 1 for s in specs], default=0)


def panel_of(daily: DataFrame, grid: DataFrame, specs: Sequence[Roll], key: str = "country", day: str = "day") -> DataFrame:
    """Rolling columns of daily totals on a dense grid, gaps 0."""
    return rolled(filled(grid, daily, [key, day]), specs, [key], day)


def _spans(ranges: Sequence[tuple[dt.date, dt.date]], back: int, on: int, first: dt.date, last: dt.date) -> list[tuple[dt.date, dt.date]]:
    """Ranges of days that begin ``back`` days earlier and end ``on`` days later, within bounds, joined where they meet."""
    out: list[tuple[dt.date, dt.date]] = []
    for a, b in sorted(ranges):
        a, b = max(a - dt.timedelta(back), first), min(b + dt.timedelta(on), last)
        if out and a <= out[-1][1] + dt.timedelta(1):
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        elif a <= b:
            out.append((a, b))
    return out


def _inside(day: str, spans: Sequence[tuple[dt.date, dt.date]]) -> Column:
    out = F.lit(False)
    for a, b in spans:
        out = out | F.col(day).between(F.lit(a), F.lit(b))
    return out


def feed_panel(
    stream: DataFrame, root: str, members: DataFrame, measures: Mapping[str, Column], specs: Sequence[Roll], key: str = "country", checkpoint: str | None = None, **how
) -> None:
    """Events to a panel that is whole after every batch: ``root``/events (by day, each event once), ``root``/totals (one row per key and day) and
    ``root``/panel (every one of ``members`` on every day from the first to the last, with rolling columns).

    A batch changes some days.  Their totals are computed again from the stored events of just these days; the panel's days whose frames reach
    them, and days by which the calendar grows, from the totals of those days and of a frame's length before them.  Each table's days are
    replaced whole, so a batch that runs again changes nothing, and late events move what they should.  Events without a day are stored and
    in no total."""
    spark = stream.sparkSession
    where = checkpoint or fresh_path(spark, "panel")
    events, totals, panel, bounds = (f"{root}/{x}" for x in ("events", "totals", "panel", "bounds"))
    back, schema = reach(specs), stream.schema

    def then(parts: list, number: int) -> None:
        days = sorted(d for d in parts if d is not None)
        was = _before(spark, bounds, "first date, last date", number)
        old = was and was.agg(F.min("first"), F.max("last")).first()
        old = old if old and old[0] is not None else None
        if not days:
            return
        first, last = (min(days[0], old[0]), max(days[-1], old[1])) if old else (days[0], days[-1])
        spark.createDataFrame([(first, last)], "first date, last date").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{bounds}/batch={number}")
        per = spark.read.schema(schema).parquet(events).where(merge.within("day", days)).groupBy(key, "day").agg(*[c.alias(n) for n, c in measures.items()])
        replace_partitions(materialize(per, "totals").select(key, *measures, "day"), totals, "day")
        grown = [(first, last)] if old is None else [(old[1], last)] * (last > old[1]) + [(first, old[0])] * (first < old[0])
        fresh = _spans([*[(d, d) for d in days], *grown], 0, back, first, last)
        need = _spans(fresh, back, 0, first, last)
        sequences = F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in need])
        grid = members.select(key).distinct().select(key, F.explode(F.flatten(sequences)).alias("day"))
        daily = spark.read.schema(per.schema).parquet(totals).where(_inside("day", need))
        rows = panel_of(daily, grid, specs, key).where(_inside("day", fresh))
        replace_partitions(materialize(rows, "panel").select(*[c for c in rows.columns if c != "day"], "day"), panel, "day")

    insert_events(stream, events, checkpoint=where, then=then, **how)


def upsert_articles(
    stream: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame], keys: Sequence[str], order: str, partition: str = "day", checkpoint: str | None = None
) -> None:
    """Raw articles, transformed, the last per key in a batch, checked, then merged with updates."""
    from riskloom.operators.ranks import first_rows

    spark = stream.sparkSession

    def each(df: DataFrame, _: int) -> None:
        rows = materialize(first_rows(transform(df), keys, [F.col(order).desc()]), "articles")
        merge.merge_into(spark, path, merge.checked(rows, keys), list(keys), partition, update=True, order=order)

    drain(stream, each, checkpoint=checkpoint)


def upsert_messages(stream: DataFrame, path: str, after: str, checkpoint: str | None = None, **lexicon) -> None:
    """Messages to events by id, older ones skipped."""
    spark = stream.sparkSession

    def each(df: DataFrame, _: int) -> None:
        events = extracted(df.where(F.col("sent_at") >= F.lit(after).cast("timestamp")), **lexicon).withColumn("day", F.to_date("sent_at")).dropDuplicates(["event_id"])
        merge.merge_into(spark, path, events, ["event_id", "day"], "day", update=True)

    drain(stream, each, checkpoint=checkpoint)


def _watched(stream: DataFrame, stamp: str, delay: str | None) -> DataFrame:
    return stream if delay is None else stream.withWatermark(stamp, delay)


def buckets(stream: DataFrame, stamp: str = "ts", size: str = "12 hours", delay: str | None = "1 day") -> DataFrame:
    """Tumbling counts per country, from the epoch.  Buckets close ``delay`` after the latest stamp and count no row that comes later; with None they stay
    open, and their state is kept."""
    w = F.window(stamp, size)
    return _watched(stream, stamp, delay).groupBy(w.alias("w"), "country").agg(F.count("*").alias("n")).select("country", F.col("w.start").alias("start"), "n")


def daily_totals(stream: DataFrame, stamp: str = "ts", delay: str | None = "1 day") -> DataFrame:
    """Totals per country and day that grow while the day lasts (update mode).  Days close as buckets do; ``feed_panel`` counts rows however late they are."""
    w = F.window(stamp, "1 day")
    totals = _watched(stream, stamp, delay).groupBy(w.alias("w"), "country").agg(F.count("*").alias("events"), F.sum("fatalities").alias("deaths"))
    return totals.select("country", F.to_date("w.start").alias("day"), "events", "deaths")


class Moments(StatefulProcessor):
    """Count, mean and sum of squared deviations per key.  A batch is merged into them at once, and the values after each of its rows follow from its
    running sums about the mean so far: with d = x - mean, mean' = mean + sum(d) / n' and m2' = m2 + sum(d * d) - sum(d)^2 / n'."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("moments", "n long, mean double, m2 double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        batch = pd.concat(parts).sort_values("day")
        means, spread, state = merged_moments(batch["value"].to_numpy(float), self.state.get() if self.state.exists() else (0, 0.0, 0.0))
        self.state.update(state)
        z = np.divide(batch["value"].to_numpy(float) - means, spread, out=np.zeros(len(batch)), where=spread > 1e-12)
        yield pd.DataFrame({"country": key[0], "day": batch["day"], "value": batch["value"], "mean": means, "z": z})

    def close(self) -> None:
        pass


def merged_moments(x: np.ndarray, state: tuple[int, float, float]) -> tuple[np.ndarray, np.ndarray, tuple[int, float, float]]:
    """Mean and standard deviation after each of some values, given count, mean and squared deviations before them; and the new state."""
    n0, mean0, m20 = state
    base = mean0 if n0 else x[0]
    n = n0 + np.arange(1, len(x) + 1)
    d, d2 = np.cumsum(x - base), np.cumsum((x - base) ** 2)
    means, m2 = base + d / n, np.maximum(m20 + d2 - d * d / n, 0.0)
    spread = np.sqrt(m2 / np.maximum(n - 1, 1)) * (n > 1)
    return means, spread, (int(n[-1]), float(means[-1]), float(m2[-1]))


@contextmanager
def keyed_state(spark: SparkSession, partitions: int) -> Iterator[None]:
    """Stateful queries that begin inside keep their state in so many stores; the session's settings are as before when it ends."""
    own = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    was = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def online_scores(stream: DataFrame) -> DataFrame:
    """(country, day, value) in day order to running mean, z and a score of 0-100."""
    z = stream.groupBy("country").transformWithStateInPandas(Moments(), "country string, day date, value double, mean double, z double", "Append", "None")
    return z.withColumn("score", F.round(100 / (1 + F.exp(-F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col("z"))))), 2))
