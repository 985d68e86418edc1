"""From raw rows to clean tables: codes, parsing, first and last rows, cleaning, replacement."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import div
from riskloom.operators.ranks import first_rows


def keyed(df: DataFrame, bridge: DataFrame, code: str) -> DataFrame:
    """Rows whose code belongs to a key; a key may own several codes."""
    return df.join(bridge, code)


def int_day(col: str) -> Column:
    return F.to_date(F.col(col).cast("string"), "yyyyMMdd")


def matched_codes(locations: str, codes: Sequence[str], field: int = 2) -> Column:
    """Distinct known codes in a ``;`` list of ``#`` records."""
    found = F.transform(F.split(locations, ";"), lambda x: F.get(F.split(x, "#"), F.lit(field)))
    return F.array_distinct(F.filter(found, lambda c: c.isin(*codes)))


def exploded(df: DataFrame, locations: str, codes: Sequence[str], out: str = "code") -> DataFrame:
    """One row per known code; a coarse test of the raw string comes first, and changes nothing."""
    coarse = F.col(locations).rlike("#(" + "|".join(codes) + ")(#|;|$)")
    return df.where(coarse).withColumn(out, F.explode(matched_codes(locations, codes)))


def title_of(xml: str, tag: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(xml, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def language_of(info: str, default: str = "eng") -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(info, "srclc:([A-Za-z]+)", 1)), F.lit("")), F.lit(default))


def first_number(col: str) -> Column:
    return F.get(F.split(col, ","), F.lit(0)).try_cast("double")


def first_seen(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_rows(df, keys, [F.col(c).asc() for c in order])


def last_seen(df: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    return first_rows(df, keys, [F.col(c).desc() for c in order])


def whole_number(col: str) -> Column:
    """Text to a count: bad, missing and negative become 0."""
    return F.greatest(F.coalesce(F.col(col).try_cast("double").cast("int"), F.lit(0)), F.lit(0))


def coded(col: str, codes: Mapping[str, int]) -> Column:
    """A label's code; a number stays, anything else is 0."""
    out = F.col(col).try_cast("int")
    for name, code in codes.items():
        out = F.when(F.lower(F.trim(F.col(col))) == name.lower(), F.lit(code)).otherwise(out)
    return F.coalesce(out, F.lit(0))


def in_range(col: str, low: float | None = None, high: float | None = None, members: Sequence | None = None) -> Column:
    ok = F.col(col).isin(*members) if members is not None else F.col(col).between(low, high)
    return F.when(ok, F.col(col))


def synthetic(daily: DataFrame, counts: Mapping[int, str], keys: Sequence[str]) -> DataFrame:
    """Day totals to event rows: one per event and class, with the day's mentions spread evenly, and negative ids in key order.

    Ids are counted from running totals over days, not over the rows that they give."""
    from pyspark.sql import Window

    classes = F.explode(F.array(*[F.struct(F.lit(k).alias("klass"), F.col(c).cast("int").alias("cnt")) for k, c in counts.items()]))
    rows = daily.withColumn("_x", classes).select(*[c for c in daily.columns if c not in counts.values()], "_x.klass", "_x.cnt").where("cnt > 0")
    before = Window.partitionBy(keys[0]).orderBy(*keys[1:], "klass").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_base", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
    each = numbered.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("cnt")))).withColumn("event_no", -(F.col("_base") + F.col("_i")))
    return each.drop("_base", "_i")


def replaced_period(old: DataFrame, new: DataFrame, first: str, last: str, day: str = "day") -> DataFrame:
    within = F.col(day).between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return old.where(~within | F.col(day).isNull()).unionByName(new.where(within))


def wide_markets(long: DataFrame, names: Sequence[str], day: str = "day", name: str = "indicator", value: str = "close") -> DataFrame:
    """One column per name, with the first value of a day in name order; names without rows are null."""
    return long.groupBy(day).pivot(name, list(names)).agg(F.min(value))


def market_changes(df: DataFrame, values: Sequence[str], day: str = "day", proxy: tuple[str, str] | None = None) -> DataFrame:
    """Percent change to the row before (gaps carried forward first), and the root of the product of two of them."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy(day)  # one row per day
    known = {v: F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for v in values}
    df = df.withColumns({f"_{v}": c for v, c in known.items()})
    df = df.withColumns({f"{v}_pct": (div(f"_{v}", F.lag(f"_{v}").over(w)) - 1) * 100 for v in values}).drop(*[f"_{v}" for v in values])
    return df.withColumn("volatility", F.sqrt(F.abs(F.col(f"{proxy[0]}_pct")) * F.abs(F.col(f"{proxy[1]}_pct")))) if proxy else df
