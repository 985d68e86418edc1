"""Event rows to one row per country and day, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import div
from riskloom.operators import dealt

KEYS = ("country", "day")


def conflict_totals(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return events.groupBy(*keys).agg(F.count("*").alias("events"), F.sum("fatalities").alias("deaths"), F.max("fatalities").alias("deaths_max"))


def category_counts(events: DataFrame, groups: Mapping[str, Mapping[str, object]], either: Mapping[str, tuple[Sequence[str], object]] | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """One ``count_if`` per category: groups[column][out] = value; either[out] = (columns, value) counts rows where any column has it."""
    out = [F.count_if(F.col(c) == v).alias(o) for c, names in groups.items() for o, v in names.items()]
    for o, (cols, v) in (either or {}).items():
        hit = F.lit(False)
        for c in cols:
            hit = hit | F.coalesce(F.col(c) == v, F.lit(False))
        out.append(F.count_if(hit).alias(o))
    return events.groupBy(*keys).agg(*out)


def news_totals(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean and spread of intensity (spread of one row is 0), mean tone, mentions, count, and counts per class."""
    return events.groupBy(*keys).agg(
        F.avg("intensity").alias("intensity_mean"), F.coalesce(F.stddev_samp("intensity"), F.lit(0.0)).alias("intensity_std"), F.avg("tone").alias("tone_mean"),
        F.sum("mentions").alias("mentions"), F.count("*").alias("n"), *[F.count_if(F.col("klass") == k).alias(f"class{k}") for k in (1, 2, 3, 4)],
    )


def violence_totals(events: DataFrame, roots: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    return events.groupBy(*keys).agg(
        F.count_if(F.col("klass") == 4).alias("material"), F.count_if(F.col("root").isin(*roots)).alias("fights"), F.count("*").alias("n"),
        F.min("intensity").alias("intensity_min"), F.coalesce(F.sum(F.when(F.col("klass") == 4, F.col("mentions"))), F.lit(0)).alias("material_mentions"),
    )


def mirror_totals(events: DataFrame, roots: Mapping[str, str], actors: Mapping[str, Sequence[int]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Signals of a conflict log read from news: counts per root, per actor list on either side, negative mass, conflict mentions."""
    out = [F.count_if(F.col("root") == v).alias(k) for k, v in roots.items()]
    out += [F.count_if(F.col("actor1").isin(*v) | F.col("actor2").isin(*v)).alias(k) for k, v in actors.items()]
    out += [
        F.sum(F.when(F.col("intensity") < 0, -F.col("intensity")).otherwise(F.lit(0.0))).alias("negative_mass"),
        F.sum(F.when(F.col("klass") >= 3, F.col("mentions")).otherwise(F.lit(0))).alias("conflict_mentions"), F.count("*").alias("n"),
    ]
    return events.groupBy(*keys).agg(*out)


def spread(events: DataFrame, area: str = "area", keys: Sequence[str] = KEYS) -> DataFrame:
    """Counts per area first, then areas, largest area, total and sum of squares."""
    per = events.groupBy(*keys, area).agg(F.count("*").alias("c"))
    return per.groupBy(*keys).agg(F.count("*").alias("areas"), F.max("c").alias("largest"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("squares"))


def concentration(daily: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Herfindahl index and share of the largest area."""
    n = F.col("total") + F.lit(eps)
    return daily.withColumns({"herfindahl": F.col("squares") / (n * n), "top_share": F.col("largest") / n})


def article_totals(articles: DataFrame, themes: Mapping[str, str], exact: bool = True, keys: Sequence[str] = KEYS) -> DataFrame:
    """Count, distinct domains and languages, tone's tenth percentile, and articles whose themes hold a token with a prefix."""
    p10 = [] if exact else [F.percentile_approx("tone", 0.1).alias("tone_p10")]
    marks = [F.count_if(F.col("themes").rlike(rf"(^|;){p}[^;]*")).alias(o) for o, p in themes.items()]
    totals = articles.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.count_distinct("language").alias("languages"), *p10, *marks)
    if exact:
        totals = dealt.attached(totals, dealt.percentiles(articles, "tone", {"tone_p10": 0.1}, keys), keys)
    return totals.select(*keys, "n", "domains", "languages", "tone_p10", *themes)


def person_totals(articles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Tokens per person (the part before a comma), then persons, most tokens of one, all tokens."""
    token = F.explode(F.split("persons", ";"))
    tokens = articles.where("persons is not null").select(*keys, token.alias("t"))
    names = tokens.select(*keys, F.trim(F.get(F.split("t", ","), F.lit(0))).alias("person")).where("person <> ''")
    per = names.groupBy(*keys, "person").agg(F.count("*").alias("c"))
    return per.groupBy(*keys).agg(F.count("*").alias("persons"), F.max("c").alias("person_top"), F.sum("c").alias("person_tokens"))


def title_rollup(articles: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return articles.groupBy(*keys, "title").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.min("language").alias("language"), F.avg("tone").alias("tone"))


def baseline(events: DataFrame, key: str = "country", day: str = "day", value: str = "fatalities") -> DataFrame:
    """Mean of yearly sums, its log, and its percentile rank x 100 (ties share their mean rank)."""
    from riskloom.operators.ranks import percentile_rank

    yearly = events.groupBy(key, F.year(day).alias("year")).agg(F.sum(value).alias("s"))
    mean = yearly.groupBy(key).agg(F.avg("s").alias("yearly_mean")).withColumn("log_mean", F.log1p("yearly_mean"))
    return percentile_rank(mean, "log_mean", "baseline").withColumn("baseline", F.round("baseline", 2))


def coverage(events: DataFrame, years: Sequence[int], key: str = "country", day: str = "day") -> DataFrame:
    """Events per key and year, and how many years have any."""
    wide = events.groupBy(key).agg(*[F.count_if(F.year(day) == y).alias(f"y{y}") for y in years])
    return wide.withColumn("years", sum((F.when(F.col(f"y{y}") > 0, 1).otherwise(0) for y in years), F.lit(0)))


def rates(df: DataFrame, flag: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(flag).alias("positives"), div(F.sum(flag), F.count("*")).alias("rate"))
