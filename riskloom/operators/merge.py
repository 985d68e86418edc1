"""Merges into Parquet tables, incremental windows, and checks around them.

A merge reads only the partitions that the new rows touch, writes the result aside, and then replaces just those partitions;
applying a batch twice changes nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators.ranks import first_rows
from riskloom.session import materialize
from riskloom.sources import gathered, replace_partitions

#: A merge takes up so many partitions at a time.
MOST_PARTITIONS = 10_000


def _no_null(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def single(new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new``; reading it is an error if one of its keys has several rows, since which of them counts would be open.  Dealt by the keys, as the
    merge needs it anyway.  Rows with a null in their key match nothing and may repeat; they are not dealt."""
    count = "rows of key"  # a name that no table of this library has
    counted = new.where(_no_null(keys)).withColumn(count, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    one = counted.where(F.when(F.col(count) > 1, F.raise_error(F.lit("a key of the batch has several rows"))).otherwise(F.lit(True))).drop(count)
    return one.unionByName(new.where(~_no_null(keys)))


def unseen(new: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``new`` whose keys ``target`` lacks; those with a null in their key match nothing, and are not moved for it."""
    known = new.where(_no_null(keys)).join(target.where(_no_null(keys)).select(*keys), list(keys), "left_anti")
    return known.select(*new.columns).unionByName(new.where(~_no_null(keys)))


def inserted(target: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """target and those new rows whose keys it lacks; a key that repeats in ``new`` is an error."""
    return target.unionByName(unseen(single(new, keys), target, keys))


def upserted(target: DataFrame, new: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """target with new rows in place of those with their keys; with ``order`` the row with the largest value stays, so that batches
    may come in any order and repeat keys, which is an error without it."""
    if order is not None:
        own = first_rows(target.unionByName(new).where(_no_null(keys)), keys, [F.col(order).desc()])
        return own.unionByName(target.unionByName(new).where(~_no_null(keys)))
    return unseen(target, new, keys).unionByName(single(new, keys))


def touched(new: DataFrame, partition: str, most: int = 10_000) -> list:
    """The partitions that hold new rows, null among them; a batch that touches more than ``most`` is refused."""
    found = [r[0] for r in new.select(partition).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"the batch touches over {most} partitions")
    return found


def touched_in_turn(new: DataFrame, partition: str) -> Iterator[list]:
    """The partitions that hold new rows in ascending order, null first, MOST_PARTITIONS at a time."""
    every = new.select(partition).distinct()
    rest, found = every, [None] * MOST_PARTITIONS
    while len(found) == MOST_PARTITIONS:
        found = [r[0] for r in rest.orderBy(F.col(partition).asc_nulls_first()).limit(MOST_PARTITIONS).collect()]
        if found:
            yield found
            rest = every.where(F.col(partition) > F.lit(found[-1])) if found[-1] is not None else every.where(F.col(partition).isNotNull())


def within(partition: str, parts: Sequence) -> Column:
    """Rows of some partitions; pruned when it is a table's partition column."""
    known = F.col(partition).isin(*[p for p in parts if p is not None])
    return known | F.col(partition).isNull() if None in parts else known


def stored(spark: SparkSession, path: str, like: DataFrame, partition: str, parts: Sequence) -> DataFrame:
    """The stored rows of some partitions; none if there is no table yet."""
    try:
        return spark.read.schema(like.schema).parquet(path).where(within(partition, parts))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.where(F.lit(False))


def merge_into(spark: SparkSession, path: str, new: DataFrame, keys: Sequence[str], partition: str, update: bool, order: str | None = None) -> int:
    """Insert-only or upsert into a table partitioned by ``partition``, which must be one of the keys or follow from them.  The batch is evaluated
    once.  Rows of a null partition, and those with a null in their key, are stored like others; the latter match nothing.  Returns how many
    partitions were written."""
    batch = materialize(new, "batch")
    results, n = [], 0
    for parts in touched_in_turn(batch, partition):
        own, target = batch.where(within(partition, parts)) if n or len(parts) == MOST_PARTITIONS else batch, stored(spark, path, batch, partition, parts)
        results.append(materialize(upserted(target, own, keys, order) if update else inserted(target, own, keys), "merge"))
        n += len(parts)
    for result in results:  # only when all keys are known to be single
        replace_partitions(result.select(*new.columns), path, partition)
    return n


def append_unseen(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], partition: str) -> None:
    """Adds those rows of ``batch``, a written table, whose keys the partitions that they touch lack.  Of these only the keys are read, and nothing is
    written anew.  Run again after a failure it adds what is not there yet."""
    for parts in touched_in_turn(batch, partition):
        own = batch.where(within(partition, parts))
        rows = materialize(unseen(single(own, keys), stored(spark, path, batch, partition, parts), keys), "unseen")
        gathered(rows, partition).write.mode("append").partitionBy(partition).parquet(path)


def reloaded(old: DataFrame, new: DataFrame, within: Column) -> DataFrame:
    """Delete what ``within`` holds for, then insert."""
    return old.where(~F.coalesce(within, F.lit(False))).unionByName(new)


def staging_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, null_keys, repeated_keys, passed; an empty batch passes."""
    nulls = F.count_if(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) > 0)
    once = df.groupBy(*keys).agg(F.count("*").alias("c"), nulls.alias("nl"))
    out = once.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("nl"), F.lit(0)).alias("null_keys"), F.count_if(F.col("c") > 1).alias("repeated_keys"))
    return out.withColumn("passed", (F.col("null_keys") == 0) & (F.col("repeated_keys") == 0))


def checked(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = staging_report(df, keys).first()
    if not r.passed:
        raise ValueError(f"{r.null_keys} null keys, {r.repeated_keys} repeated keys")
    return df


def load_report(df: DataFrame, day: str, key: str, today: str, stale_days: int = 7) -> DataFrame:
    """One row of totals and the issues found: null or future dates, an old last date, no rows."""
    now = F.lit(today).cast("date")
    t = df.agg(
        F.count("*").alias("n_rows"), F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(key).alias("keys"),
        F.count_if(F.col(day).isNull()).alias("null_days"), F.count_if(F.col(day) > now).alias("future_days"),
    )
    rules = {"no rows": F.col("n_rows") == 0, "null dates": F.col("null_days") > 0, "future dates": F.col("future_days") > 0, "stale": F.datediff(now, F.col("last")) > stale_days}
    issues = F.concat_ws(", ", *[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return t.withColumn("issues", issues).withColumn("passed", F.col("issues") == "")


def coverage_report(df: DataFrame, expected: DataFrame, key: str, day: str) -> DataFrame:
    """Every expected key with its rows and days, and whether it is missing."""
    have = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(day).alias("first"), F.max(day).alias("last"))
    return expected.select(key).distinct().join(have, key, "left").na.fill(0, ["n_rows"]).withColumn("missing", F.col("n_rows") == 0)


def appended_last(batches: DataFrame, keys: Sequence[str], batch: str) -> DataFrame:
    """Aggregates of several batches: the last batch's row per key."""
    return first_rows(batches, keys, [F.col(batch).desc()])


# ---- incremental windows ----


def last_day(df: DataFrame, day: str, recent: int | None = None) -> DataFrame:
    """One row ``last``.  With ``recent`` only days that close to the partition bound are read (pruned on a day-partitioned table)."""
    if recent is not None:
        top = df.agg(F.max(day).alias("_top"))
        df = df.join(F.broadcast(top), F.col(day) >= F.date_sub("_top", recent))
    return df.agg(F.max(day).alias("last"))


def date_window(last: dt.date | None, overlap: int, today: dt.date, first: dt.date | None = None, end: dt.date | None = None) -> tuple[dt.date, dt.date]:
    """[last - overlap, yesterday] unless forced; without a last day, or backwards, it is an error."""
    if first is None:
        if last is None:
            raise ValueError("the table has no last day and none is given")
        first = last - dt.timedelta(days=overlap)
    end = end or today - dt.timedelta(days=1)
    if first > end:
        raise ValueError(f"window {first} to {end} runs backwards")
    return first, end


def time_window(watermark: dt.datetime | None, now: dt.datetime, overlap_min: int = 30, without_h: int = 2) -> tuple[dt.datetime, dt.datetime]:
    return (watermark - dt.timedelta(minutes=overlap_min) if watermark else now - dt.timedelta(hours=without_h)), now


def watermark(marks: DataFrame, source: str, data: DataFrame, day: str) -> DataFrame:
    """One row ``mark``: the source's last success, else the table's last day at midnight."""
    own = marks.where(F.col("source") == source).agg(F.max("last_success_at").alias("a"))
    return own.join(F.broadcast(data.agg(F.max(day).cast("timestamp").alias("b")))).select(F.coalesce("a", "b").alias("mark"))


def ingested(df: DataFrame, stamp: str, first: int, last: int, day: str, lookback: int = 1) -> DataFrame:
    """Rows by ingestion stamp (14 digits), and by event day back to ``lookback`` days before it, which prunes partitions."""
    bound = F.date_sub(F.to_date(F.lit(str(first)[:8]), "yyyyMMdd"), lookback)
    return df.where(F.col(stamp).between(first, last) & (F.col(day) >= bound))


def advanced(marks: DataFrame, source: str, at: dt.datetime, run: str, success: bool, dry: bool = False) -> DataFrame:
    """Watermarks with the source's new one, only after a success that was no dry run."""
    if not success or dry:
        return marks
    row = marks.sparkSession.createDataFrame([(source, at, at, run)], marks.schema)
    return upserted(marks, row, ["source"])


def months(first: str, last: str, spark: SparkSession) -> DataFrame:
    """Month slices (first, last) of a date range."""
    ends = spark.range(1).select(F.lit(first).cast("date").alias("a"), F.lit(last).cast("date").alias("b"))
    m = ends.select("a", "b", F.explode(F.expr("sequence(trunc(a, 'MM'), b, interval 1 month)")).alias("m"))
    return m.select(F.greatest("m", "a").alias("first"), F.least(F.last_day("m"), "b").alias("last"))


def guarded_append(stored: DataFrame, new: DataFrame, day: str) -> DataFrame:
    """stored and new; new must begin after stored ends."""
    low, high = new.agg(F.min(day)).first()[0], stored.agg(F.max(day)).first()[0]
    if low is not None and high is not None and low <= high:
        raise ValueError(f"new rows begin at {low}, stored ones end at {high}")
    return stored.unionByName(new)
