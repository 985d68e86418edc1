"""Daily aggregates, calendars, rolling features, labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.functions import clip, div, logistic, r6
from riskloom.operators import daily, grid, labels
from riskloom.operators.windows import Roll, accelerated, ratio, rolled, sequences, zscore
from riskloom.plans.fixtures import articles, nations, news, orders
from riskloom.plans.registry import query

WIDTHS = (7, 14, 30)
GRID = "g AS (SELECT country, CAST(d AS DATE) AS day FROM nat, (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM news))"
ROOTS = {"view": "view", "signup": "signup", "click": "click", "error": "error", "purchase": "purchase"}


def news_grid(spark, sf):
    return grid.dense(news(spark, sf), nations(spark, sf))


# ---- daily aggregates ----


@query("agg_01", "SELECT country, day, count(*) AS events, sum(fatalities)::BIGINT AS deaths, max(fatalities) AS deaths_max FROM news GROUP BY ALL")
def agg_01(spark, sf):
    return daily.conflict_totals(news(spark, sf))


@query(
    "agg_02",
    "SELECT country, day, "
    + ", ".join(f"count(*) FILTER (root = '{r}') AS n_{r}" for r in ROOTS)
    + ", "
    + ", ".join(f"count(*) FILTER (actor1 = {a} OR actor2 = {a}) AS actor_{a}" for a in range(8))
    + " FROM news GROUP BY ALL",
)
def agg_02(spark, sf):
    return daily.category_counts(news(spark, sf), {"root": {f"n_{r}": r for r in ROOTS}}, {f"actor_{a}": (("actor1", "actor2"), a) for a in range(8)})


AGG_03 = """SELECT country, day, avg(intensity) AS intensity_mean, coalesce(stddev_samp(intensity), 0) AS intensity_std, avg(tone) AS tone_mean, sum(mentions)::BIGINT AS mentions,
  count(*) AS n, count(*) FILTER (klass = 1) AS class1, count(*) FILTER (klass = 2) AS class2, count(*) FILTER (klass = 3) AS class3, count(*) FILTER (klass = 4) AS class4 FROM news GROUP BY ALL"""


@query(
    "agg_03",
    f"SELECT * REPLACE (round(intensity_mean, 6) + 0.0 AS intensity_mean, round(intensity_std, 6) AS intensity_std, "
    f"round(tone_mean, 6) + 0.0 AS tone_mean) FROM ({AGG_03})",
)
def agg_03(spark, sf):
    df = daily.news_totals(news(spark, sf))
    return df.withColumns({c: r6(c) for c in ("intensity_mean", "intensity_std", "tone_mean")})


@query(
    "agg_04",
    "SELECT country, day, count(*) FILTER (klass = 4) AS material, count(*) FILTER (root IN ('error', 'click')) AS fights, count(*) AS n, "
    "round(min(intensity), 6) AS intensity_min, coalesce(sum(mentions) FILTER (klass = 4), 0)::BIGINT AS material_mentions FROM news "
    "GROUP BY ALL",
)
def agg_04(spark, sf):
    return daily.violence_totals(news(spark, sf), ["error", "click"]).withColumn("intensity_min", r6("intensity_min"))


ACTORS = {"state": [0, 1], "rebel": [2, 3, 4], "civil": [5]}
AGG_05 = ("SELECT country, day, " + ", ".join(f"count(*) FILTER (root = '{r}') AS m_{r}" for r in ROOTS) + ", " + ", ".join(f"count(*) FILTER (actor1 IN ({', '.join(map(str, v))}) OR actor2 IN ({', '.join(map(str, v))})) AS {k}" for k, v in ACTORS.items())
  + ", round(sum(greatest(-intensity, 0)), 6) AS negative_mass, sum(CASE WHEN klass >= 3 THEN mentions ELSE 0 END)::BIGINT AS conflict_mentions, count(*) AS n FROM news GROUP BY ALL")


def mirror(spark, sf):
    return daily.mirror_totals(news(spark, sf), {f"m_{r}": r for r in ROOTS}, ACTORS).withColumn("negative_mass", r6("negative_mass"))


@query("agg_05", AGG_05)
def agg_05(spark, sf):
    return mirror(spark, sf)


AGG_06 = (
    "SELECT country, day, count(*) AS areas, max(c) AS largest, sum(c)::BIGINT AS total, sum(c * c)::BIGINT AS squares "
    "FROM (SELECT country, day, area, count(*) AS c FROM ord GROUP BY ALL) GROUP BY ALL"
)


@query("agg_06", AGG_06)
def agg_06(spark, sf):
    return daily.spread(orders(spark, sf))


@query(
    "agg_07",
    f"SELECT *, round(squares / ((total + 1e-6) * (total + 1e-6)), 6) AS herfindahl, round(largest / (total + 1e-6), 6) AS top_share "
    f"FROM ({AGG_06})",
)
def agg_07(spark, sf):
    return daily.concentration(daily.spread(orders(spark, sf))).withColumns({c: r6(c) for c in ("herfindahl", "top_share")})


THEMES = {"theme_the": "[Tt]h", "theme_er": "er"}
AGG_08 = (
    "SELECT country, day, count(*) AS n, count(DISTINCT domain) AS domains, count(DISTINCT language) AS languages, "
    "round(quantile_cont(tone, 0.1), 6) + 0.0 AS tone_p10, count(*) FILTER (regexp_matches(themes, '(^|;)[Tt]h[^;]*')) AS theme_the, "
    "count(*) FILTER (regexp_matches(themes, '(^|;)er[^;]*')) AS theme_er FROM art GROUP BY ALL"
)


@query("agg_08", AGG_08)
def agg_08(spark, sf):
    return daily.article_totals(articles(spark, sf), THEMES).withColumn("tone_p10", r6("tone_p10"))


@query(
    "agg_09",
    "SELECT country, day, count(*) AS persons, max(c) AS person_top, sum(c)::BIGINT AS person_tokens "
    "FROM (SELECT country, day, person, count(*) AS c FROM (SELECT country, day, "
    "trim(split_part(unnest(string_split(persons, ';')), ',', 1)) AS person FROM art) WHERE person <> '' GROUP BY ALL) GROUP BY ALL",
)
def agg_09(spark, sf):
    return daily.person_totals(articles(spark, sf))


@query(
    "agg_10",
    "SELECT country, day, title, count(*) AS n, count(DISTINCT domain) AS domains, min(language) AS language, "
    "round(avg(tone), 6) + 0.0 AS tone FROM art GROUP BY ALL",
)
def agg_10(spark, sf):
    return daily.title_rollup(articles(spark, sf)).withColumn("tone", r6("tone"))


BASE = (
    "(SELECT country, avg(s) AS yearly_mean, ln(1 + avg(s)) AS log_mean FROM (SELECT country, year(day) AS y, sum(fatalities) AS s "
    "FROM news GROUP BY ALL) GROUP BY ALL)"
)


@query(
    "agg_19",
    f"SELECT country, round(yearly_mean, 6) AS yearly_mean, round(log_mean, 6) AS log_mean, "
    f"round((rank() OVER (ORDER BY yearly_mean) + (count(*) OVER (PARTITION BY yearly_mean) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, "
    f"2) AS baseline FROM {BASE}",
)
def agg_19(spark, sf):
    return daily.baseline(news(spark, sf)).withColumns({c: r6(c) for c in ("yearly_mean", "log_mean")})


YEARS = tuple(range(1995, 2002))


@query(
    "agg_21",
    "SELECT country, "
    + ", ".join(f"count(*) FILTER (year(day) = {y}) AS y{y}" for y in YEARS)
    + ", "
    + " + ".join(f"(count(*) FILTER (year(day) = {y}) > 0)::INT" for y in YEARS)
    + " AS years FROM ord GROUP BY ALL",
)
def agg_21(spark, sf):
    return daily.coverage(orders(spark, sf), YEARS)


# ---- calendars ----


@query(
    "win_01",
    f"SELECT country, day, coalesce(n, 0) AS n FROM g LEFT JOIN (SELECT country, day, count(*) AS n FROM news "
    f"GROUP BY ALL) USING (country, day)",
    ctes=GRID,
)
def win_01(spark, sf):
    return grid.filled(news_grid(spark, sf), news(spark, sf).groupBy("country", "day").agg(F.count("*").alias("n")))


OWN = (
    "og AS (SELECT country, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ord GROUP BY country), "
    "oc AS (SELECT country, day, count(*) AS n, sum(amount) AS amount FROM ord GROUP BY ALL), "
    "op AS (SELECT country, day, coalesce(n, 0) AS n, coalesce(amount, 0) AS amount FROM og LEFT JOIN oc USING (country, day))"
)


def order_panel(spark, sf):
    rows = orders(spark, sf)
    per = rows.groupBy("country", "day").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    return grid.filled(grid.calendar(rows, keys=["country"]), per)


@query("win_02", "SELECT country, day, n, round(amount, 2) AS amount FROM op", ctes=OWN)
def win_02(spark, sf):
    return order_panel(spark, sf).withColumn("amount", F.round("amount", 2))


@query(
    "jn_05",
    f"SELECT country, day, coalesce(events, 0) AS events, coalesce(deaths, 0)::BIGINT AS deaths, coalesce(deaths_max, 0) AS deaths_max "
    f"FROM g LEFT JOIN (SELECT country, day, count(*) AS events, sum(fatalities) AS deaths, max(fatalities) AS deaths_max FROM news "
    f"GROUP BY ALL) USING (country, day)",
    ctes=GRID,
)
def jn_05(spark, sf):
    return grid.filled(news_grid(spark, sf), daily.conflict_totals(news(spark, sf)))


@query("src_04", "SELECT country, day, 0::BIGINT AS events, 0::BIGINT AS deaths FROM g", ctes=GRID)
def src_04(spark, sf):
    from riskloom.sources import empty_like

    none = daily.conflict_totals(empty_like(news(spark, sf))).drop("deaths_max")
    return grid.filled(news_grid(spark, sf), none)


# ---- rolling features on the dense grid ----

PANEL = (
    GRID
    + ", p AS (SELECT country, day, coalesce(events, 0) AS events, coalesce(deaths, 0)::BIGINT AS deaths, "
    + ", ".join(f"coalesce(n_{r}, 0) AS n_{r}" for r in ROOTS)
    + " FROM g LEFT JOIN (SELECT country, day, count(*) AS events, sum(fatalities) AS deaths, "
    + ", ".join(f"count(*) FILTER (root = '{r}') AS n_{r}" for r in ROOTS)
    + " FROM news GROUP BY ALL) USING (country, day))"
)


def conflict_panel(spark, sf):
    per = news(spark, sf).groupBy("country", "day").agg(F.count("*").alias("events"), F.sum("fatalities").alias("deaths"), *[F.count_if(F.col("root") == r).alias(f"n_{r}") for r in ROOTS])
    return grid.filled(news_grid(spark, sf), per)


def rows(a, b):
    return f"OVER (PARTITION BY country ORDER BY day ROWS BETWEEN {a} AND {b})"


def back(width, lag):
    return rows(f"{width + lag - 1} PRECEDING", f"{lag} PRECEDING" if lag else "CURRENT ROW")


@query(
    "win_03",
    "SELECT country, day, "
    + ", ".join(f"coalesce(sum({v}) {back(w, 7)}, 0)::BIGINT AS {v}_{w}, coalesce(max({v}) {back(w, 7)}, 0) AS {v}_max_{w}" for v in ("events", "deaths") for w in WIDTHS)
    + " FROM p",
    ctes=PANEL,
)
def win_03(spark, sf):
    specs = [Roll(f"{v}{'' if a == 'sum' else '_max'}_{w}", v, a, w, 7, fill=0) for v in ("events", "deaths") for w in WIDTHS for a in ("sum", "max")]
    return rolled(conflict_panel(spark, sf), specs).select("country", "day", *[s.out for s in specs])


@query(
    "win_04",
    "SELECT country, day, "
    + ", ".join(f"coalesce(round(sum(n_{r}) {back(30, 7)} / nullif(sum(events) {back(30, 7)}, 0), 6), 0) AS share_{r}" for r in ROOTS)
    + " FROM p",
    ctes=PANEL,
)
def win_04(spark, sf):
    names = ["events", *[f"n_{r}" for r in ROOTS]]
    df = rolled(conflict_panel(spark, sf), [Roll(f"{v}_w", v, "sum", 30, 7) for v in names])
    df = ratio(df, {f"share_{r}": (f"n_{r}_w", "events_w") for r in ROOTS})
    return df.select("country", "day", *[r6(f"share_{r}").alias(f"share_{r}") for r in ROOTS])


@query(
    "win_05",
    "SELECT country, day, (first IS NULL OR day < first + 7)::INT AS missing "
    "FROM (SELECT country, day, min(CASE WHEN events > 0 THEN day END) OVER (PARTITION BY country) AS first FROM p)",
    ctes=PANEL,
)
def win_05(spark, sf):
    first = F.min(F.when(F.col("events") > 0, F.col("day"))).over(Window.partitionBy("country"))
    return conflict_panel(spark, sf).withColumn("first", first).select("country", "day", F.when(F.col("first").isNull() | (F.col("day") < F.date_add("first", 7)), 1).otherwise(0).alias("missing"))


NEWS_PANEL = (
    GRID
    + (
        f", a3 AS ({AGG_03}), np AS (SELECT country, day, intensity_mean, intensity_std, tone_mean, coalesce(mentions, 0) AS mentions, "
        f"coalesce(n, 0) AS n, "
    )
    + ", ".join(f"coalesce(class{k}, 0) AS class{k}" for k in (1, 2, 3, 4))
    + " FROM g LEFT JOIN a3 USING (country, day))"
)
MEANS = ("intensity_mean", "intensity_std", "tone_mean")
SUMS = ("mentions", "n")


def news_panel(spark, sf):
    counts = ["mentions", "n", *[f"class{k}" for k in (1, 2, 3, 4)]]
    return grid.filled(news_grid(spark, sf), daily.news_totals(news(spark, sf)), only=counts)


def flagship_features(df):
    """Means ignore empty days, sums do not; class shares over 30 days; all end a day before."""
    specs = [Roll(f"{v}_{w}", v, "avg", w, 1, fill=0.0) for v in MEANS for w in WIDTHS] + [Roll(f"{v}_{w}", v, "sum", w, 1, fill=0) for v in SUMS for w in WIDTHS]
    specs += [Roll(f"class{k}_30", f"class{k}", "sum", 30, 1, fill=0) for k in (1, 2, 3, 4)]
    df = ratio(rolled(df, specs), {f"class{k}_share": (f"class{k}_30", "n_30") for k in (1, 2, 3, 4)})
    keep = [f"{v}_{w}" for v in (*MEANS, *SUMS) for w in WIDTHS] + [f"class{k}_share" for k in (1, 2, 3, 4)]
    return df.select("country", "day", *[r6(c).alias(c) if not c.startswith(SUMS) else F.col(c) for c in keep])


W06 = (
    ", ".join(f"coalesce(round(avg({v}) {back(w, 1)}, 6), 0) + 0.0 AS {v}_{w}" for v in MEANS for w in WIDTHS)
    + ", "
    + ", ".join(f"coalesce(sum({v}) {back(w, 1)}, 0)::BIGINT AS {v}_{w}" for v in SUMS for w in WIDTHS)
)
W07 = ", ".join(f"coalesce(round(sum(class{k}) {back(30, 1)} / nullif(sum(n) {back(30, 1)}, 0), 6), 0) AS class{k}_share" for k in (1, 2, 3, 4))


@query("flagship", f"SELECT country, day, {W06}, {W07} FROM np", ctes=NEWS_PANEL)
def flagship(spark, sf):
    return flagship_features(news_panel(spark, sf))


@query("win_06", f"SELECT country, day, {W06} FROM np", ctes=NEWS_PANEL)
def win_06(spark, sf):
    return flagship_features(news_panel(spark, sf)).drop(*[f"class{k}_share" for k in (1, 2, 3, 4)])


@query("win_07", f"SELECT country, day, {W07} FROM np", ctes=NEWS_PANEL)
def win_07(spark, sf):
    return flagship_features(news_panel(spark, sf)).select("country", "day", *[f"class{k}_share" for k in (1, 2, 3, 4)])


ART_PANEL = (
    f"ag AS (SELECT country, CAST(d AS DATE) AS day FROM (SELECT DISTINCT country "
    f"FROM art), (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS d FROM art)), a8 AS ({AGG_08}), "
    f"ap AS (SELECT country, day, coalesce(n, 0) AS n, coalesce(domains, 0) AS domains, tone_p10, coalesce(theme_the, 0) AS theme_the "
    f"FROM ag LEFT JOIN a8 USING (country, day))"
)


@query(
    "win_09",
    f"SELECT country, day, sum(n) {back(1, 1)}::BIGINT AS n_1, sum(n) {back(7, 1)}::BIGINT AS n_7, "
    f"round(avg(domains) {back(7, 1)}, 6) AS domains_7, round(avg(tone_p10) {back(7, 1)}, 6) + 0.0 AS tone_7, "
    f"round(sum(theme_the) {back(7, 1)} / nullif(sum(n) {back(7, 1)}, 0), 6) AS theme_7 FROM ap",
    ctes=ART_PANEL,
)
def win_09(spark, sf):
    rows_ = articles(spark, sf)
    per = daily.article_totals(rows_, THEMES).withColumn("tone_p10", r6("tone_p10")).select("country", "day", "n", "domains", "tone_p10", "theme_the")
    df = grid.filled(grid.dense(rows_, rows_), per, only=["n", "domains", "theme_the"])
    df = rolled(df, [Roll("n_1", "n", "sum", 1, 1), Roll("n_7", "n", "sum", 7, 1), Roll("domains_7", "domains", "avg", 7, 1), Roll("tone_7", "tone_p10", "avg", 7, 1), Roll("t7", "theme_the", "sum", 7, 1)])
    return df.select("country", "day", "n_1", "n_7", r6("domains_7").alias("domains_7"), r6("tone_7").alias("tone_7"), r6(div("t7", "n_7")).alias("theme_7"))


A4P = (
    GRID
    + (
        ", vp AS (SELECT country, day, coalesce(material, 0) AS material, coalesce(n, 0) AS n, coalesce(intensity_min, 0) AS intensity_min "
        "FROM g LEFT JOIN (SELECT country, day, count(*) FILTER (klass = 4) AS material, count(*) AS n, min(intensity) AS intensity_min "
        "FROM news GROUP BY ALL) USING (country, day))"
    )
)


@query(
    "win_10",
    f"SELECT country, day, m7::BIGINT AS material_7, m30::BIGINT AS material_30, round(lowest, 6) + 0.0 AS intensity_low, "
    f"round((m7 / 7) / (m30 / 30 + 1e-6), 6) AS material_accel, round(m7 / (n7 + 1e-6), 6) AS material_share "
    f"FROM (SELECT country, day, sum(material) {back(7, 0)} AS m7, sum(material) {back(30, 0)} AS m30, "
    f"min(intensity_min) {back(7, 0)} AS lowest, sum(n) {back(7, 0)} AS n7 FROM vp)",
    ctes=A4P,
)
def win_10(spark, sf):
    per = daily.violence_totals(news(spark, sf), ["error", "click"]).select("country", "day", "material", "n", "intensity_min")
    specs = [Roll("material_7", "material", "sum", 7), Roll("material_30", "material", "sum", 30), Roll("intensity_low", "intensity_min", "min", 7), Roll("n7", "n", "sum", 7)]
    df = rolled(grid.filled(news_grid(spark, sf), per), specs)
    df = ratio(df.withColumn("material_accel", accelerated("material_7", 7, "material_30", 30)), {"material_share": ("material_7", "n7")}, eps=1e-6)
    return df.select("country", "day", "material_7", "material_30", *[r6(c).alias(c) for c in ("intensity_low", "material_accel", "material_share")])


MIRROR = (
    GRID
    + (
        f", m5 AS ({AGG_05}), mp AS (SELECT country, day, coalesce(m_error, 0) AS m_error, coalesce(state, 0) AS state, "
        f"coalesce(rebel, 0) AS rebel, coalesce(negative_mass, 0) AS negative_mass, coalesce(conflict_mentions, 0) AS conflict_mentions "
        f"FROM g LEFT JOIN m5 USING (country, day))"
    )
)
FULL, HALF, WEEK = ("m_error", "negative_mass"), ("state",), ("rebel", "conflict_mentions")


def mirror_panel(spark, sf):
    return grid.filled(news_grid(spark, sf), mirror(spark, sf).select("country", "day", *FULL, *HALF, *WEEK))


@query(
    "win_11",
    "SELECT country, day, "
    + ", ".join(f"round({v}, 6) AS {v}_1, round(sum({v}) {back(7, 0)}, 6) AS {v}_7, round(sum({v}) {back(30, 0)}, 6) AS {v}_30, round((sum({v}) {back(7, 0)} / 7) / (sum({v}) {back(30, 0)} / 30 + 1e-6), 6) AS {v}_accel" for v in FULL)
    + f", round(sum(state) {back(7, 0)}, 6) AS state_7, round(sum(state) {back(30, 0)}, 6) AS state_30, "
    + ", ".join(f"round(sum({v}) {back(7, 0)}, 6) AS {v}_7" for v in WEEK)
    + " FROM mp",
    ctes=MIRROR,
)
def win_11(spark, sf):
    specs = [Roll(f"{v}_{w}", v, "sum", w) for v in (*FULL, *HALF) for w in (7, 30)] + [Roll(f"{v}_7", v, "sum", 7) for v in WEEK] + [Roll(f"{v}_1", v, "sum", 1) for v in FULL]
    df = rolled(mirror_panel(spark, sf), specs).withColumns({f"{v}_accel": accelerated(f"{v}_7", 7, f"{v}_30", 30) for v in FULL})
    return df.select("country", "day", *[r6(c).alias(c) for c in [*[s.out for s in specs], *[f"{v}_accel" for v in FULL]]])


def z_sql(value, width, lag, least, bound=None):
    w = back(width, lag)
    z = (
        f"coalesce(CASE WHEN count({value}) {w} >= {least} AND stddev_samp({value}) {w} > 1e-12 THEN ({value} - avg({value}) {w}) / "
        f"stddev_samp({value}) {w} END, 0)"
    )
    return f"round({z if bound is None else f'greatest(-{bound}, least({bound}, {z}))'}, 5) + 0.0"


@query("win_12", f"SELECT country, day, n, {z_sql('n', 90, 0, 5)} AS z FROM op", ctes=OWN)
def win_12(spark, sf):
    return zscore(order_panel(spark, sf), "n", "z", 90, 0, 5).select("country", "day", "n", (F.round("z", 5) + F.lit(0.0)).alias("z"))


SPREAD = (
    OWN
    + (
        f", a6 AS ({AGG_06}), sp AS (SELECT country, day, coalesce(areas, 0) AS areas, coalesce(largest, 0) AS largest, "
        f"coalesce(squares / ((total + 1e-6) * (total + 1e-6)), 0) AS herfindahl FROM og LEFT JOIN a6 USING (country, day))"
    )
)


@query(
    "win_13",
    f"SELECT country, day, "
    + ", ".join(f"round(avg({v}) {back(w, 0)}, 6) AS {v}_{w}" for v in ("areas", "largest", "herfindahl") for w in (7, 30))
    + f", round((avg(areas) {back(7, 0)}) / (avg(areas) {back(30, 0)} + 1e-6), 6) AS areas_accel FROM sp",
    ctes=SPREAD,
)
def win_13(spark, sf):
    src = orders(spark, sf)
    per = daily.concentration(daily.spread(src)).select("country", "day", "areas", "largest", "herfindahl")
    specs = [Roll(f"{v}_{w}", v, "avg", w) for v in ("areas", "largest", "herfindahl") for w in (7, 30)]
    df = rolled(grid.filled(grid.calendar(src, keys=["country"]), per), specs).withColumn("areas_accel", accelerated("areas_7", 1, "areas_30", 1))
    return df.select("country", "day", *[r6(c).alias(c) for c in [*[s.out for s in specs], "areas_accel"]])


REL = OWN + f", rz AS (SELECT country, day, {z_sql('n', 90, 1, 30, 8)} AS z_n, {z_sql('amount', 90, 1, 30, 8)} AS z_amount FROM op)"


def relative(spark, sf):
    df = order_panel(spark, sf)
    for v in ("n", "amount"):
        df = zscore(df, v, f"z_{v}", 90, 1, 30, bound=8)
    return df.select("country", "day", *[(F.round(f"z_{v}", 5) + F.lit(0.0)).alias(f"z_{v}") for v in ("n", "amount")])


@query("win_14", "SELECT * FROM rz", ctes=REL)
def win_14(spark, sf):
    return relative(spark, sf)


@query(
    "win_15",
    f"SELECT country, day, hot, round(mass, 5) AS mass, max(hot) {back(7, 0)} AS hot_7 "
    f"FROM (SELECT country, day, (z_n > 1.5)::INT + (z_amount > 1.5)::INT AS hot, greatest(z_n, 0) + greatest(z_amount, 0) AS mass "
    f"FROM rz)",
    ctes=REL,
)
def win_15(spark, sf):
    zs = ("z_n", "z_amount")
    df = relative(spark, sf).withColumn("hot", sum(((F.col(z) > 1.5).cast("int") for z in zs), F.lit(0))).withColumn("mass", sum((F.greatest(F.col(z), F.lit(0.0)) for z in zs), F.lit(0.0)))
    return rolled(df, [Roll("hot_7", "hot", "max", 7)]).select("country", "day", "hot", F.round("mass", 5).alias("mass"), "hot_7")


def score_sql(v):
    w = back(90, 0)
    return (
        f"CASE WHEN count({v}) {w} >= 30 THEN round(100 / (1 + exp(-greatest(-3, "
        f"least(3, CASE WHEN stddev_samp({v}) {w} > 1e-12 THEN ({v} - avg({v}) {w}) / stddev_samp({v}) {w} ELSE 0 END)))), 2) END"
    )


def scored(df, value, out):
    """Causal 0-100 score of a series: z over 90 rows, at least 30, clipped to 3."""
    w = Window.partitionBy("country").orderBy("day").rowsBetween(-89, 0)
    z = F.when(F.stddev_samp(value).over(w) > 1e-12, (F.col(value) - F.avg(value).over(w)) / F.stddev_samp(value).over(w)).otherwise(F.lit(0.0))
    return df.withColumn(out, F.when(F.count(value).over(w) >= 30, F.round(100 * logistic(clip(z, -3, 3)), 2)))


SCORED = OWN + f", sc AS (SELECT country, day, {score_sql('n')} AS s_n, {score_sql('amount')} AS s_amount FROM op)"


@query("win_16", "SELECT * FROM sc", ctes=SCORED)
def win_16(spark, sf):
    return scored(scored(order_panel(spark, sf), "n", "s_n"), "amount", "s_amount").select("country", "day", "s_n", "s_amount")


@query(
    "win_17",
    "SELECT country, day, s_n AS u, s_amount AS c, round(0.6 * s_n + 0.4 * s_amount, 4) AS s, "
    "round((s_n + s_amount + 0.6 * s_n + 0.4 * s_amount) / 3, 4) AS total FROM sc",
    ctes=SCORED,
)
def win_17(spark, sf):
    df = scored(scored(order_panel(spark, sf), "n", "u"), "amount", "c")
    s = F.lit(0.6) * F.col("u") + F.lit(0.4) * F.col("c")
    return df.select("country", "day", "u", "c", F.round(s, 4).alias("s"), F.round((F.col("u") + F.col("c") + s) / 3, 4).alias("total"))


ONLINE = rows("UNBOUNDED PRECEDING", "CURRENT ROW")


@query(
    "win_18",
    f"SELECT country, day, n, round(avg(n) {ONLINE}, 6) AS mean, round(coalesce(CASE WHEN stddev_samp(n) {ONLINE} > 1e-12 THEN (n - "
    f"avg(n) {ONLINE}) / stddev_samp(n) {ONLINE} END, 0), 5) + 0.0 AS z FROM op",
    ctes=OWN,
)
def win_18(spark, sf):
    w = Window.partitionBy("country").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    std = F.stddev_samp("n").over(w)
    z = F.coalesce(F.when(std > 1e-12, (F.col("n") - F.avg("n").over(w)) / std), F.lit(0.0))
    return order_panel(spark, sf).select("country", "day", "n", r6(F.avg("n").over(w)).alias("mean"), (F.round(z, 5) + F.lit(0.0)).alias("z"))


# ---- labels ----

LBL = PANEL + f""", l0 AS (SELECT country, day, events, deaths, coalesce(sum(events) {back(14, 1)}, 0)::BIGINT AS past_n, coalesce(avg(events) {back(14, 1)}, 0) AS past_mean,
  coalesce(CASE WHEN count(*) {back(14, 1)} >= 2 THEN stddev_samp(events) {back(14, 1)} END, 0) AS past_std,
  CASE WHEN count(*) {rows('1 FOLLOWING', '3 FOLLOWING')} = 3 THEN sum(events) {rows('1 FOLLOWING', '3 FOLLOWING')} END::BIGINT AS ahead,
  CASE WHEN count(*) {rows('1 FOLLOWING', '3 FOLLOWING')} = 3 THEN sum(deaths) {rows('1 FOLLOWING', '3 FOLLOWING')} END::BIGINT AS ahead_deaths FROM p),
l AS (SELECT *, (ahead > 0)::INT AS y, (past_n = 0 AND ahead > 0)::INT AS y_onset,
  ((past_n = 0 AND ahead > 0) OR ahead / 3 > past_mean + 2 * past_std OR (past_mean = 0 AND past_std = 0 AND ahead_deaths > 0))::INT AS y_escalation FROM l0 WHERE ahead IS NOT NULL)"""


def label_panel(spark, sf):
    return labels.labelled(conflict_panel(spark, sf).select("country", "day", "events", "deaths"))


for _name, _cols in {"win_34": "ahead, ahead_deaths", "lbl_01": "y", "lbl_02": "past_n, y_onset", "lbl_03": "y_onset, y_escalation"}.items():

    def _labels(spark, sf, cols=_cols):
        return label_panel(spark, sf).select("country", "day", *cols.split(", "))

    query(_name, f"SELECT country, day, {_cols} FROM l", ctes=LBL)(_labels)


@query("win_35", "SELECT country, day, past_n, round(past_mean, 6) AS past_mean, round(past_std, 6) AS past_std FROM l", ctes=LBL)
def win_35(spark, sf):
    return label_panel(spark, sf).select("country", "day", "past_n", r6("past_mean").alias("past_mean"), r6("past_std").alias("past_std"))


@query(
    "lbl_04",
    "SELECT country, min(day) AS first, max(day) AS last, count(*) AS days, sum(y)::BIGINT AS positives FROM l GROUP BY country",
    ctes=LBL,
)
def lbl_04(spark, sf):
    return label_panel(spark, sf).groupBy("country").agg(F.min("day").alias("first"), F.max("day").alias("last"), F.count("*").alias("days"), F.sum("y").alias("positives"))


@query(
    "win_36",
    f"SELECT country, day, CASE WHEN count(*) {rows('1 FOLLOWING', '7 FOLLOWING')} = 7 THEN max((n_error > "
    f"0)::INT) {rows('1 FOLLOWING', '7 FOLLOWING')} END AS error_ahead FROM p",
    ctes=PANEL,
)
def win_36(spark, sf):
    df = conflict_panel(spark, sf).withColumn("flag", (F.col("n_error") > 0).cast("int"))
    return labels.any_ahead(df, "flag", 7, "error_ahead").select("country", "day", "error_ahead")


@query(
    "win_37",
    "SELECT country, day, cells FROM (SELECT country, day, string_agg(events || ',' || deaths || ',' || n_error, ',') OVER w AS cells, "
    "count(*) OVER w AS c FROM p WINDOW w AS (PARTITION BY country ORDER BY day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)) WHERE c = 14",
    ctes=PANEL,
)
def win_37(spark, sf):
    """The matrix of each day, row by row, as text."""
    df = sequences(conflict_panel(spark, sf), ["events", "deaths", "n_error"], 14)
    return df.select("country", "day", F.array_join(F.flatten("matrix").cast("array<bigint>").cast("array<string>"), ",").alias("cells"))


@query("win_38", f"SELECT country, day, round(avg((events > 0)::INT) {back(30, 0)}, 6) AS rate FROM p", ctes=PANEL)
def win_38(spark, sf):
    df = conflict_panel(spark, sf).withColumn("flag", (F.col("events") > 0).cast("int"))
    return rolled(df, [Roll("rate", "flag", "avg", 30)]).select("country", "day", r6("rate").alias("rate"))


@query("win_39", f"SELECT country, day, coalesce((max(deaths) {rows('1 FOLLOWING', '5 FOLLOWING')} > 8)::INT, 0) AS before_peak FROM p", ctes=PANEL)
def win_39(spark, sf):
    return labels.before_peaks(conflict_panel(spark, sf), "deaths", 8, 5, "before_peak").select("country", "day", "before_peak")


# ---- assembly ----


@query(
    "jn_01",
    f"SELECT country, day, n_7, y, y_onset FROM (SELECT country, day, coalesce(sum(n) {back(7, 1)}, 0)::BIGINT AS n_7 FROM np) "
    f"JOIN l USING (country, day)",
    ctes=NEWS_PANEL + LBL.removeprefix(GRID),
)
def jn_01(spark, sf):
    feats = rolled(news_panel(spark, sf), [Roll("n_7", "n", "sum", 7, 1, fill=0)]).select("country", "day", "n_7")
    return feats.join(label_panel(spark, sf), ["country", "day"]).select("country", "day", "n_7", "y", "y_onset")


@query(
    "jn_02",
    "SELECT country, day, coalesce(n, 0) AS n, coalesce(material, 0) AS material, coalesce(art_n, 0) AS art_n, "
    "(art_n IS NULL)::INT AS art_missing, (day >= DATE '2024-01-11')::INT AS art_available FROM g LEFT "
    "JOIN (SELECT country, day, count(*) AS n FROM news GROUP BY ALL) USING (country, day) LEFT "
    "JOIN (SELECT country, day, count(*) FILTER (klass = 4) AS material FROM news GROUP BY ALL) USING (country, day) LEFT "
    "JOIN (SELECT country, day, count(*) AS art_n FROM art GROUP BY ALL) USING (country, day)",
    ctes=GRID,
)
def jn_02(spark, sf):
    from riskloom.operators.joins import assembled

    base, src = news_grid(spark, sf), news(spark, sf)
    groups = [
        (src.groupBy("country", "day").agg(F.count("*").alias("n")), 0, None),
        (src.groupBy("country", "day").agg(F.count_if(F.col("klass") == 4).alias("material")), 0, None),
        (articles(spark, sf).groupBy("country", "day").agg(F.count("*").alias("art_n")), 0, "art_missing"),
    ]
    return assembled(base, groups).withColumn("art_available", (F.col("day") >= F.lit("2024-01-11").cast("date")).cast("int"))


@query("dt_03", "SELECT country, day, (day >= DATE '2024-01-16')::INT AS available FROM g", ctes=GRID)
def dt_03(spark, sf):
    return news_grid(spark, sf).withColumn("available", F.when(F.col("day") >= F.lit("2024-01-16").cast("date"), 1).otherwise(0))


@query("flt_04", "SELECT country, day, count(*) AS n, round(avg(intensity), 9) + 0.0 AS intensity FROM news WHERE mentions >= 10 GROUP BY ALL")
def flt_04(spark, sf):
    return news(spark, sf).where("mentions >= 10").groupBy("country", "day").agg(F.count("*").alias("n"), (F.round(F.avg("intensity"), 9) + F.lit(0.0)).alias("intensity"))


@query(
    "mth_02",
    "SELECT country, day, CASE WHEN error = 0 THEN NULL ELSE round(purchase / error, 6) END AS ratio "
    "FROM (SELECT country, day, count(*) FILTER (root = 'purchase') AS purchase, count(*) FILTER (root = 'error') AS error FROM news "
    "GROUP BY ALL)",
)
def mth_02(spark, sf):
    per = daily.category_counts(news(spark, sf), {"root": {"purchase": "purchase", "error": "error"}})
    return per.select("country", "day", r6(div("purchase", "error")).alias("ratio"))
