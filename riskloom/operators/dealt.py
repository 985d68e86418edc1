"""Running sums, ranks and percentiles of groups of any size.

Rows are dealt by range of their group and order, so that a group that holds most of the rows, or a table without groups, spreads over tasks;
only one sum per range and group is put in order in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import materialize

_RANGE = "dealt range"  # names that no expression of the library uses


def running(rows: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], keys: Sequence[str] = (), totals: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with, for each of ``sums``, the sum of its column from the group's first row to this one; ``totals`` names those whose sum over the
    group is wanted too.  Rows that are equal in ``order`` must be equal in ``sums``, or their order is open."""
    first = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    dealt = materialize(rows.repartitionByRange(*first, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    per = dealt.groupBy(_RANGE, *keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per range
    before = group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(
        F.col(_RANGE).alias("r"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"s{i}") for i, name in enumerate(sums)],
        *[F.sum(name).over(group).alias(f"t{i}") for i, name in enumerate(totals or {})],
    )
    own = Window.partitionBy(_RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select(F.struct(*[F.col(c) for c in rows.columns]).alias("row"), _RANGE, *[F.col(k).alias(f"g{i}") for i, k in enumerate(keys)], *[F.sum(c).over(own).alias(f"i{i}") for i, c in enumerate(sums.values())])
    same = F.col(_RANGE) == F.col("r")
    for i in range(len(keys)):
        same = same & F.col(f"g{i}").eqNullSafe(F.col(f"k{i}"))
    out = inside.join(starts, same)
    new = [(F.col(f"i{i}") + F.col(f"s{i}")).alias(name) for i, name in enumerate(sums)] + [F.col(f"t{i}").alias(t) for i, t in enumerate((totals or {}).values())]
    return out.select("row.*", *new)


#: No more values than this are hot: those with over this part of all rows.
SHARES = 1000


def _same(keys: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def looked_up(df: DataFrame, facts: DataFrame, keys: Sequence[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """``df`` (``total`` rows) with the other columns of ``facts``, a written table with one row for each of ``keys`` (nulls are keys too) and the number
    ``n`` of its rows.  Keys with more than one row in SHARES, at most SHARES of them, are joined by broadcast, so none of the shuffled rest is large."""
    own = [f"p{i}" for i in range(len(keys))]
    named = facts.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[c for c in facts.columns if c not in keys])
    hot, cold = named.where(F.col(n) * SHARES > total), named.where(F.col(n) * SHARES <= total)
    if hot.isEmpty():
        return df.join(cold, _same(keys, "p"), how).drop(*own)
    rest = df.join(F.broadcast(hot.select(*own)), _same(keys, "p"), "left_anti")
    return df.join(F.broadcast(hot), _same(keys, "p")).drop(*own).unionByName(rest.join(cold, _same(keys, "p"), how).drop(*own))


def placed(df: DataFrame, value: str, keys: Sequence[str] = (), down: bool = False) -> DataFrame:
    """``df`` with upto (rows of the group up to and with this value), equal (rows with this value) and rows (of the group), from one row
    per distinct value.  Nulls come first, or last if ``down``.  Values that many rows share are joined by broadcast."""
    per = materialize(df.groupBy(*keys, value).agg(F.count("*").alias("equal")), "distinct")
    order = F.col(value).desc_nulls_last() if down else F.col(value).asc_nulls_first()
    ranked = materialize(running(per, [order], {"upto": F.col("equal")}, keys, {"upto": "rows"}), "ranked")
    total = ranked.agg(F.coalesce(F.sum("equal"), F.lit(0))).first()[0]
    return looked_up(df, ranked.select(*keys, value, "equal", "upto", "rows"), [*keys, value], "equal", total)


def carried(rows: DataFrame, order: Sequence[Column], value: str, out: str, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the last ``value`` that is not null from the group's first row to this one, in ``order``.  Rows are dealt by range, as in
    ``running``; from each range only its groups' last values are put in order.  Rows that are equal in ``order`` must be equal in ``value`` or have none."""
    first = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    dealt = materialize(rows.repartitionByRange(*first, *order).withColumn(_RANGE, F.spark_partition_id()), "ranges")
    own = Window.partitionBy(_RANGE, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = materialize(dealt.withColumn("carried so far", F.last(value, ignorenulls=True).over(own)).withColumn("place in range", F.row_number().over(own)), "carried")
    ends = inside.groupBy(_RANGE, *keys).agg(F.max_by("carried so far", "place in range").alias("last"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # one row per range
    before = ends.withColumn("before", F.last("last", ignorenulls=True).over(group.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)))
    starts = before.where("before is not null").select(F.col(_RANGE).alias("r"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], "before")
    # a range holds the beginning or the end of at most two groups that go on beyond it, so its rows meet few of these
    both = inside.join(starts, (F.col(_RANGE) == F.col("r")) & _same(keys, "k"), "left")
    return both.select(*rows.columns, F.coalesce("carried so far", "before").alias(out))


def large(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The groups of over ``most`` rows, written; None if there are none."""
    found = materialize(df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*[F.col(k).alias(f"p{i}") for i, k in enumerate(keys)]), "large")
    return None if found.isEmpty() else found


def inside(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(groups, _same(keys, "p"), "left_semi")


def outside(df: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(groups, _same(keys, "p"), "left_anti")


def attached(df: DataFrame, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``facts`` (one row per group at most); null keys are groups too."""
    named = facts.select(*[F.col(k).alias(f"p{i}") for i, k in enumerate(keys)], *[c for c in facts.columns if c not in keys])
    return df.join(named, _same(keys, "p"), "left").drop(*[f"p{i}" for i in range(len(keys))])


def percentiles(df: DataFrame, value: str, q: Mapping[str, float], keys: Sequence[str], small: int = 0) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group.  Groups of up to ``small`` rows are put in order in one task each; larger ones,
    and all if it is 0, are dealt by range."""
    known = df.where(F.col(value).isNotNull())
    if small and keys:
        own = lambda rows: rows.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(x)) for x in q.values()])).alias("_p")).select(*keys, *[F.col("_p")[i].alias(name) for i, name in enumerate(q)])
        big = large(known, keys, small)
        return own(known) if big is None else own(outside(known, big, keys)).unionByName(percentiles(inside(known, big, keys), value, q, keys))
    per = materialize(known.groupBy(*keys, value).agg(F.count("*").alias("equal")), "distinct")
    ranked = running(per, [F.col(value).asc()], {"upto": F.col("equal")}, keys, {"upto": "rows"})

    def at(share: float) -> Column:
        place = F.lit(share) * (F.col("rows") - 1)
        low, high = (F.min(F.when(F.col("upto") > f(place), F.col(value))) for f in (F.floor, F.ceil))
        part = F.max(place - F.floor(place))
        return low + (high - low) * part

    return ranked.groupBy(*keys).agg(*[at(share).alias(name) for name, share in q.items()])
