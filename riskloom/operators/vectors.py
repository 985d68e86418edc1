"""Title embeddings: means, anchors, pooling, trailing means and deviations.

Vectors stay arrays.  Titles meet anchors in matrix products, one per Arrow batch and block of anchors; the long (title, anchor) form is written
once where several aggregates read it, and anchors are pivoted last.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import array_mean, cosine, dot, norm, scaled
from riskloom.operators import dealt
from riskloom.operators.windows import Roll, accelerated, frame, rolled
from riskloom.session import materialize

#: Bytes of the anchors that go to every task at once, and of the similarities that a task holds at once.
MOST_BYTES = 1 << 26


def daily_means(titles: DataFrame, keys: Sequence[str] = ("country", "day")) -> DataFrame:
    return titles.groupBy(*keys).agg(F.count("*").alias("n"), array_mean("vec").alias("mean"))


def merged_means(parts: DataFrame, keys: Sequence[str] = ("country", "day")) -> DataFrame:
    """Partial (n, mean) rows to one: weighted by n."""
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), array_mean("mean", "n").alias("mean"))


def anchors_of(labelled: DataFrame, label: str = "label") -> DataFrame:
    """anchor, vec: unit mean vector per label."""
    return labelled.groupBy(F.col(label).alias("anchor")).agg(array_mean("vec").alias("vec")).select("anchor", scaled(F.col("vec")).alias("vec"))


def anchor_blocks(anchors: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Ids and vectors (as rows of a matrix), in order of the ids, in blocks of at most MOST_BYTES; blocks are read one at a time."""
    stored = materialize(anchors.where("vec is not null").select("anchor", F.col("vec").cast("array<double>").alias("vec")), "anchors")
    n, dims = stored.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return
    per = max(1, MOST_BYTES // (8 * max(dims, 1)))
    block = F.floor((F.row_number().over(Window.orderBy("anchor")) - 1) / per)  # one row per anchor, without vectors
    placed = materialize(stored.select("anchor").withColumn("block", block), "blocks")
    for k in range(-(-n // per)):
        rows = stored.join(F.broadcast(placed.where(F.col("block") == k).select("anchor")), "anchor").orderBy("anchor").collect()
        yield [r.anchor for r in rows], np.array([list(r.vec) for r in rows], float).reshape(len(rows), -1)


def _products(shared):
    """A function of batches of vectors: their cosines with the rows of a broadcast matrix."""

    @F.pandas_udf("array<double>")
    def products(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        size, dims = np.sqrt(np.einsum("ij,ij->i", own, own)), own.shape[1]
        at_once = max(1, MOST_BYTES // (8 * max(len(own), dims)))
        for batch in batches:
            out = []
            for k in range(0, len(batch), at_once):
                part = batch.iloc[k : k + at_once].tolist()
                fits = [v is not None and len(v) == dims for v in part]
                x = np.array([v for v, ok in zip(part, fits, strict=True) if ok], float).reshape(-1, dims)
                cos = iter((x @ own.T) / (np.sqrt(np.einsum("ij,ij->i", x, x))[:, None] * size + 1e-12))
                out += [next(cos) if ok else [None] * len(own) for ok in fits]
            yield pd.Series(out, dtype=object, index=batch.index)

    return products


def similarities(rows: DataFrame, anchors: DataFrame, vec: str = "vec", keep: Sequence[str] = ("country", "day")) -> DataFrame:
    """Long form: one row per row and anchor (one row per ``anchor``) with its cosine.  Each Arrow batch of vectors meets a block of anchors in one
    matrix product; a vector that is null or of another length has null cosines."""
    spark, parts, place = rows.sparkSession, [], "place in block"
    for names, matrix in anchor_blocks(anchors):
        products = _products(spark.sparkContext.broadcast(matrix))
        label = spark.createDataFrame(list(enumerate(names)), f"`{place}` int, anchor {anchors.schema['anchor'].dataType.simpleString()}")
        each = rows.select(*keep, F.posexplode(products(F.col(vec).cast("array<double>"))).alias(place, "cos"))
        parts.append(each.join(F.broadcast(label), place).select(*keep, "anchor", "cos"))  # ids of one block
    if not parts:
        return rows.select(*keep, F.lit(None).cast(anchors.schema["anchor"].dataType).alias("anchor"), F.lit(None).cast("double").alias("cos")).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def similarities_in_place(rows: DataFrame, anchors: DataFrame, vec: str = "vec", keep: Sequence[str] = ("country", "day")) -> DataFrame:
    """As ``similarities``, without Python, for a few short anchors: they are one row, and each pair is computed by array functions."""
    listed = anchors.where("vec is not null").agg(F.array_sort(F.collect_list(F.struct("anchor", "vec"))).alias("_a"))
    if (anchors.agg(F.sum(F.size("vec"))).first()[0] or 0) > MOST_BYTES // 8:
        raise ValueError("too many anchors for one row")
    each = rows.join(F.broadcast(listed)).select(*keep, F.col(vec).alias("_v"), F.explode("_a").alias("_x"))
    return each.select(*keep, F.col("_x.anchor").alias("anchor"), cosine(F.col("_v"), F.col("_x.vec")).alias("cos"))


def thresholds(sims: DataFrame, q: float = 0.9, keys: Sequence[str] = ("country", "anchor"), exact: bool = True) -> DataFrame:
    """A percentile of the cosines per group.  Groups may be of any size: exact ones of large groups come from ranges of values, the others from
    a sketch."""
    if exact:
        return dealt.percentiles(sims, "cos", {"threshold": q}, keys, small=SMALL)
    return sims.groupBy(*keys).agg(F.percentile_approx("cos", q).alias("threshold"))


#: Groups of up to so many rows are put in order in one task.
SMALL = 100_000


def pooled(sims: DataFrame, limits: DataFrame, keys: Sequence[str] = ("country", "day", "anchor"), exact: bool = True) -> DataFrame:
    """Per day and anchor: largest, p95 and p99 cosine, count over the country's threshold.  In one pass, but for days of over SMALL rows, whose
    exact percentiles come from ranges of values."""
    ends = {"p95": 0.95, "p99": 0.99}
    joined = sims.join(limits, ["country", "anchor"])
    extremes = [F.max("cos").alias("top"), F.count_if(F.col("cos") > F.col("threshold")).alias("over")]
    if not exact:
        return joined.groupBy(*keys).agg(*extremes, *[F.percentile_approx("cos", q).alias(name) for name, q in ends.items()]).select(*keys, "top", *ends, "over")
    large = dealt.large(sims, keys, SMALL)
    own = lambda rows: rows.groupBy(*keys).agg(*extremes, F.percentile("cos", F.array(*[F.lit(q) for q in ends.values()])).alias("_p"))
    named = [F.col("_p")[i].alias(name) for i, name in enumerate(ends)]
    if large is None:
        return own(joined).select(*keys, "top", *named, "over")
    rest = own(dealt.outside(joined, large, keys)).select(*keys, "top", *named, "over")
    per = dealt.inside(joined, large, keys).groupBy(*keys).agg(*extremes)
    per = per.join(dealt.percentiles(dealt.inside(sims, large, keys), "cos", ends, keys), list(keys))
    return rest.unionByName(per.select(*keys, "top", *ends, "over"))


def day_signals(pool: DataFrame, pair: tuple[int, int], keys: Sequence[str] = ("country", "day")) -> DataFrame:
    """Anchors with any title over the threshold, mean of the three largest maxima, smaller of two named maxima."""
    ranked = pool.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("top").desc(), "anchor")))
    at = lambda a: F.max(F.when(F.col("anchor") == a, F.col("top")))
    return ranked.groupBy(*keys).agg(F.count_if(F.col("over") > 0).alias("hot"), F.avg(F.when(F.col("_k") <= 3, F.col("top"))).alias("top3"), F.least(at(pair[0]), at(pair[1])).alias("both"))


def any_share(sims: DataFrame, limits: DataFrame, some: Sequence[int], row: str, keys: Sequence[str] = ("country", "day")) -> DataFrame:
    """Share and count of rows over the threshold of any of some anchors."""
    flags = sims.where(F.col("anchor").isin(*some)).join(limits, ["country", "anchor"])
    per = flags.groupBy(*keys, row).agg(F.max((F.col("cos") > F.col("threshold")).cast("int")).alias("f"))
    return per.groupBy(*keys).agg(F.avg("f").alias("share"), F.sum("f").alias("n"))


def wide(pool: DataFrame, names: Sequence[int], metrics: Sequence[str], keys: Sequence[str] = ("country", "day")) -> DataFrame:
    """One column per anchor and metric, gaps 0."""
    out = [F.coalesce(F.max(F.when(F.col("anchor") == a, F.col(m))), F.lit(0)).alias(f"a{a}_{m}") for a in names for m in metrics]
    return pool.groupBy(*keys).agg(*out)


def deltas(means: DataFrame, lags: Sequence[int] = (3, 7), key: str = "country", day: str = "day") -> DataFrame:
    """Rows back, not days: length of the difference and 1 - cosine; 0 for the first rows."""
    w = Window.partitionBy(key).orderBy(day)
    out = []
    for k in lags:
        old = F.lag("mean", k).over(w)
        out += [F.coalesce(norm(F.zip_with("mean", old, lambda a, b: a - b)), F.lit(0.0)).alias(f"l2_{k}"), F.coalesce(1 - cosine(F.col("mean"), old), F.lit(0.0)).alias(f"cos_{k}")]
    return means.select("*", *out)


def trailing_mean(df: DataFrame, vec: str, out: str, rows: int, current: bool, least: int = 1, key: str = "country", day: str = "day") -> DataFrame:
    """Mean of the last ``rows`` vectors, by place in the vector: rows x dims small values in frames, never all vectors of a frame."""
    w = Window.partitionBy(key, "_pos").orderBy(day).rowsBetween(-(rows - 1), 0) if current else Window.partitionBy(key, "_pos").orderBy(day).rowsBetween(-rows, -1)
    long = df.select(key, day, F.posexplode(vec).alias("_pos", "_x"))
    m = long.select(key, day, "_pos", F.when(F.count("_x").over(w) >= least, F.avg("_x").over(w)).alias("_m"))
    back = m.groupBy(key, day).agg(F.array_sort(F.collect_list(F.struct("_pos", "_m"))).alias("_s"))
    back = back.select(key, day, F.when(F.col("_s")[0]["_m"].isNotNull(), F.transform("_s", lambda s: s["_m"])).alias(out))
    return df.join(back, [key, day])


def deviations(means: DataFrame, rows: int = 30, least: int = 5) -> DataFrame:
    """Distance to the mean of the rows before, its week's mean and acceleration; 0 with too few rows."""
    df = trailing_mean(means, "mean", "_past", rows, False, least)
    l2 = F.coalesce(norm(F.zip_with("mean", "_past", lambda a, b: a - b)), F.lit(0.0))
    df = df.withColumns({"dev_l2": l2, "dev_cos": F.coalesce(1 - cosine(F.col("mean"), F.col("_past")), F.lit(0.0))}).drop("_past")
    df = rolled(df, [Roll("dev_7", "dev_l2", "avg", 7), Roll("dev_30", "dev_l2", "avg", 30)])
    return df.withColumn("dev_accel", accelerated("dev_7", 1, "dev_30", 1))


def signature(rows: DataFrame, label: str, width: int = 14) -> DataFrame:
    """Centroids of the trailing mean vector per label (0, 1) and the unit direction between them, as one row."""
    t = trailing_mean(rows, "mean", "_t", width, True)
    mean = t.groupBy(label).agg(array_mean("_t").alias("c")).groupBy().agg(F.max(F.when(F.col(label) == 1, F.col("c"))).alias("pos"), F.max(F.when(F.col(label) == 0, F.col("c"))).alias("neg"))
    return mean.withColumn("direction", scaled(F.zip_with("pos", "neg", lambda a, b: a - b)))


def projected(means: DataFrame, direction: DataFrame) -> DataFrame:
    """Projection on a fixed direction, its week's mean over the size of the month's."""
    df = means.join(F.broadcast(direction.select("direction"))).withColumn("proj", dot(F.col("mean"), F.col("direction"))).drop("direction")
    df = rolled(df, [Roll("_7", "proj", "avg", 7), Roll("_30", "proj", "avg", 30)])
    return df.withColumn("proj_accel", F.col("_7") / (F.abs("_30") + F.lit(1e-6))).drop("_7", "_30")


def count_changes(means: DataFrame, value: str = "n", key: str = "country", day: str = "day") -> DataFrame:
    """Row deltas, a week's maximum, and a z-score over 30 rows (at least 5; no spread counts as 1, the least is 0.001)."""
    w, f = Window.partitionBy(key).orderBy(day), frame([key], day, 30, 0)
    std = F.greatest(F.coalesce(F.when(F.count(value).over(f) >= 5, F.stddev_samp(value).over(f)), F.lit(1.0)), F.lit(1e-3))
    mean = F.coalesce(F.when(F.count(value).over(f) >= 5, F.avg(value).over(f)), F.col(value))
    return means.select("*", *[F.coalesce(F.col(value) - F.lag(value, k).over(w), F.lit(0)).alias(f"d{k}") for k in (3, 7)], F.max(value).over(frame([key], day, 7, 0)).alias("top7"), ((F.col(value) - mean) / std).alias("z30"))


def exceedances(daily_cos: DataFrame, limits: DataFrame, widths: Sequence[int] = (1, 7, 30)) -> DataFrame:
    """(country, day, anchor, cos) on a daily grid: days over the threshold in trailing frames; no threshold counts as 0."""
    j = daily_cos.join(limits, ["country", "anchor"], "left").withColumn("over", (F.col("cos") > F.coalesce("threshold", F.lit(0.0))).cast("int"))
    return rolled(j, [Roll(f"over_{w}", "over", "sum", w) for w in widths], ("country", "anchor"))

