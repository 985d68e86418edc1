"""Vector features."""

from pyspark.sql import functions as F

from riskloom.functions import norm, r6
from riskloom.operators import grid, joins, sketches, vectors
from riskloom.operators.windows import Roll, rolled
from riskloom.plans.fixtures import articles, titles
from riskloom.plans.registry import query
from riskloom.session import fresh_path, materialize

TRAIN = "2024-01-25"
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
NORM = "sqrt(list_sum(list_transform({a}, lambda x: x * x)))"
COS = f"({DOT} / ({NORM.format(a='{a}')} * {NORM.format(a='{b}')} + 1e-12))"
VEC = f"""ax AS (SELECT label AS anchor, i, avg(vec[i]) AS m FROM (SELECT label, vec, unnest(range(1, len(vec) + 1)) AS i FROM tit) GROUP BY ALL),
anc0 AS (SELECT anchor, list(m ORDER BY i) AS v FROM ax GROUP BY anchor), anc AS (SELECT anchor, list_transform(v, lambda x: x / ({NORM.format(a='v')} + 1e-12)) AS vec FROM anc0),
mx AS (SELECT country, day, i, avg(vec[i]) AS m, count(*) AS n FROM (SELECT country, day, vec, unnest(range(1, len(vec) + 1)) AS i FROM tit) GROUP BY ALL),
mean AS (SELECT country, day, max(n) AS n, list(m ORDER BY i) AS mean FROM mx GROUP BY ALL),
sims AS (SELECT vec_id, country, day, anchor, {COS.format(a='t.vec', b='anc.vec')} AS cos FROM tit t, anc),
lim AS (SELECT country, anchor, quantile_cont(cos, 0.9) AS threshold FROM sims WHERE day <= DATE '{TRAIN}' GROUP BY ALL),
pool AS (SELECT country, day, anchor, max(cos) AS top, quantile_cont(cos, 0.95) AS p95, quantile_cont(cos, 0.99) AS p99, count(*) FILTER (cos > threshold) AS over FROM sims JOIN lim USING (country, anchor) GROUP BY ALL)"""


def sims(spark, sf):
    t = titles(spark, sf)
    return vectors.similarities(t, vectors.anchors_of(t), keep=["vec_id", "country", "day"])


def limits(spark, sf, rows=None):
    rows = sims(spark, sf) if rows is None else rows
    return vectors.thresholds(rows.where(f"day <= '{TRAIN}'"))


def pool(spark, sf):
    rows = materialize(sims(spark, sf), "similarities")  # for thresholds and for the days
    return vectors.pooled(rows, limits(spark, sf, rows))


def means(spark, sf):
    return vectors.daily_means(titles(spark, sf))


def back(width, current=True, key="country"):
    return (
        f"OVER (PARTITION BY {key} ORDER BY day ROWS BETWEEN {width - 1 if current else width} PRECEDING "
        f"AND {'CURRENT ROW' if current else '1 PRECEDING'})"
    )


# ---- functions ----


@query("vec_01", "SELECT vec_id, anchor, round(cos, 6) + 0.0 AS cos FROM sims", ctes=VEC)
def vec_01(spark, sf):
    return sims(spark, sf).select("vec_id", "anchor", r6("cos").alias("cos"))


query("jn_06", "SELECT country, anchor, count(*) AS n, round(avg(cos), 6) + 0.0 AS mean FROM sims GROUP BY ALL", ctes=VEC)(
    lambda spark, sf: sims(spark, sf).groupBy("country", "anchor").agg(F.count("*").alias("n"), r6(F.avg("cos")).alias("mean"))
)


@query("vec_02", f"SELECT vec_id, round({DOT.format(a='t.vec', b='anc.vec')}, 6) + 0.0 AS proj FROM tit t, anc WHERE anchor = 0", ctes=VEC)
def vec_02(spark, sf):
    from riskloom.functions import dot

    t = titles(spark, sf)
    one = vectors.anchors_of(t).where("anchor = 0").select(F.col("vec").alias("fixed"))
    return t.join(F.broadcast(one)).select("vec_id", r6(dot(F.col("vec"), F.col("fixed"))).alias("proj"))


@query("vec_03", f"SELECT vec_id, round({NORM.format(a='vec')}, 6) AS size FROM tit")
def vec_03(spark, sf):
    return titles(spark, sf).select("vec_id", r6(norm(F.col("vec"))).alias("size"))


# ---- aggregates ----


def exploded(df, c):
    return df.select(*[x for x in df.columns if x != c], F.posexplode(c).alias("i", "x"))


@query("agg_11", "SELECT country, day, i - 1 AS i, n, round(m, 6) + 0.0 AS x FROM mx", ctes=VEC)
def agg_11(spark, sf):
    return exploded(means(spark, sf), "mean").withColumn("x", r6("x"))


@query("agg_12", "SELECT country, day, i - 1 AS i, n, round(m, 6) + 0.0 AS x FROM mx", ctes=VEC)
def agg_12(spark, sf):
    t = titles(spark, sf)
    parts = [vectors.daily_means(t.where(F.col("vec_id") % 3 == k)) for k in range(3)]
    return exploded(vectors.merged_means(parts[0].unionByName(parts[1]).unionByName(parts[2])), "mean").withColumn("x", r6("x"))


@query("agg_13", "SELECT country, anchor, round(threshold, 6) + 0.0 AS threshold FROM lim", ctes=VEC)
def agg_13(spark, sf):
    return limits(spark, sf).withColumn("threshold", r6("threshold"))


DAYLIM = (
    ", dcos AS (SELECT country, day, anchor, "
    + COS.format(a="mean.mean", b="anc.vec")
    + " AS cos FROM mean, anc), dlim AS (SELECT country, anchor, quantile_cont(cos, 0.9) AS threshold FROM dcos WHERE day <= DATE '"
    + TRAIN
    + "' GROUP BY ALL)"
)


def day_cos(spark, sf):
    return vectors.similarities(means(spark, sf), vectors.anchors_of(titles(spark, sf)), "mean")


@query("agg_14", "SELECT country, anchor, round(threshold, 6) + 0.0 AS threshold FROM dlim", ctes=VEC + DAYLIM)
def agg_14(spark, sf):
    return vectors.thresholds(day_cos(spark, sf).where(f"day <= '{TRAIN}'")).withColumn("threshold", r6("threshold"))


LOADS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def loads_sketched(rows, value, keys, by, n=3):
    """Sketches of ``n`` loads, stored one by one."""
    path = fresh_path(rows.sparkSession, "sketches")
    for k in range(n):
        sketches.sketched(rows.where(F.pmod(F.col(by), F.lit(n)) == k), value, keys).write.mode("append").parquet(path)
    return rows.sparkSession.read.parquet(path)


@query("agg_13_sketches", "SELECT country, anchor, true AS near, count(*) AS n FROM sims GROUP BY ALL", ctes=VEC)
def agg_13_sketches(spark, sf):
    """Percentiles from the stored sketches of three loads: whether their ranks among all rows are within 3 % of what they should be."""
    rows, keys = materialize(sims(spark, sf), "similarities"), ["country", "anchor"]
    found = sketches.percentiles(loads_sketched(rows, "cos", keys, "vec_id"), LOADS, keys).drop("n")
    return sketches.off(rows, found, "cos", LOADS, keys).select(*keys, (F.col("off") <= 0.03).alias("near"), "n")


@query("agg_08_sketches", "SELECT country, day, true AS near, count(*) AS n FROM art WHERE tone IS NOT NULL GROUP BY ALL")
def agg_08_sketches(spark, sf):
    rows, keys, q = articles(spark, sf).select("doc_id", "country", "day", "tone"), ["country", "day"], {"tone_p10": 0.1}
    found = sketches.percentiles(loads_sketched(rows, "tone", keys, "doc_id"), q, keys).drop("n")
    return sketches.off(rows, found, "tone", q, keys).select(*keys, (F.col("off") <= 0.03).alias("near"), "n")


R_POOL = "SELECT country, day, anchor, round(top, 6) + 0.0 AS top, round(p95, 6) + 0.0 AS p95, round(p99, 6) + 0.0 AS p99, over FROM pool"


@query("agg_15", R_POOL, ctes=VEC)
def agg_15(spark, sf):
    return pool(spark, sf).withColumns({c: r6(c) for c in ("top", "p95", "p99")})


@query("jn_07", "SELECT country, anchor, count(*) AS n, sum(over)::BIGINT AS over FROM pool GROUP BY ALL", ctes=VEC)
def jn_07(spark, sf):
    return pool(spark, sf).groupBy("country", "anchor").agg(F.count("*").alias("n"), F.sum("over").alias("over"))


@query(
    "agg_16",
    "SELECT country, day, count(*) FILTER (over > 0) AS hot, round(avg(top) FILTER (k <= 3), 6) + 0.0 AS top3, "
    "round(least(max(top) FILTER (anchor = 1), max(top) FILTER (anchor = 4)), 6) + 0.0 AS both "
    "FROM (SELECT *, row_number() OVER (PARTITION BY country, day ORDER BY top DESC, anchor) AS k FROM pool) GROUP BY ALL",
    ctes=VEC,
)
def agg_16(spark, sf):
    return vectors.day_signals(pool(spark, sf), (1, 4)).withColumns({c: r6(c) for c in ("top3", "both")})


@query(
    "agg_17",
    "SELECT country, day, round(avg(f), 6) AS share, sum(f)::BIGINT AS n "
    "FROM (SELECT country, day, vec_id, max((cos > threshold)::INT) AS f FROM sims JOIN lim USING (country, anchor) WHERE anchor < 5 "
    "GROUP BY ALL) GROUP BY ALL",
    ctes=VEC,
)
def agg_17(spark, sf):
    rows = materialize(sims(spark, sf), "similarities")
    return vectors.any_share(rows, limits(spark, sf, rows), range(5), "vec_id").withColumn("share", r6("share"))


@query(
    "agg_18",
    "SELECT country, day, "
    + ", ".join(f"round(coalesce(max({m}) FILTER (anchor = {a}), 0), 6)::DOUBLE + 0.0 AS a{a}_{m}" for a in range(3) for m in ("top", "p95", "p99", "over"))
    + " FROM pool GROUP BY ALL",
    ctes=VEC,
)
def agg_18(spark, sf):
    df = vectors.wide(pool(spark, sf), range(3), ["top", "p95", "p99", "over"])
    return df.select("country", "day", *[r6(c).alias(c) for c in df.columns[2:]])


@query(
    "win_25",
    "SELECT country, day, anchor, sum(over) OVER w::BIGINT AS over_7, round(max(top) OVER w, 6) + 0.0 AS top_7, "
    "round(avg(p95) OVER w, 6) + 0.0 AS p95_7 FROM pool WINDOW w AS (PARTITION BY country, "
    "anchor ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)",
    ctes=VEC,
)
def win_25(spark, sf):
    specs = [Roll("over_7", "over", "sum", 7, by="days"), Roll("top_7", "top", "max", 7, by="days"), Roll("p95_7", "p95", "avg", 7, by="days")]
    return rolled(pool(spark, sf), specs, ("country", "anchor")).select("country", "day", "anchor", "over_7", r6("top_7").alias("top_7"), r6("p95_7").alias("p95_7"))


DELTA = ", ".join(f"round(coalesce({NORM.format(a=f'list_transform(list_zip(mean, o{k}), lambda z: z[1] - z[2])')}, 0), 6) + 0.0 AS l2_{k}, round(coalesce(1 - {COS.format(a='mean', b=f'o{k}')}, 0), 6) + 0.0 AS cos_{k}" for k in (3, 7))


@query(
    "win_26",
    f"SELECT country, day, {DELTA} FROM (SELECT *, lag(mean, 3) OVER w AS o3, lag(mean, 7) OVER w AS o7 "
    f"FROM mean WINDOW w AS (PARTITION BY country ORDER BY day))",
    ctes=VEC,
)
def win_26(spark, sf):
    df = vectors.deltas(means(spark, sf))
    return df.select("country", "day", *[r6(f"{m}_{k}").alias(f"{m}_{k}") for k in (3, 7) for m in ("l2", "cos")])


NN = ", nn AS (SELECT country, day, n + day(day) % 4 AS n FROM mean)"


@query(
    "win_27",
    f"SELECT country, day, coalesce(n - lag(n, 3) OVER w, 0) AS d3, coalesce(n - lag(n, 7) OVER w, 0) AS d7, max(n) {back(7)} AS top7, "
    f"round((n - coalesce(CASE WHEN count(n) {back(30)} >= 5 THEN avg(n) {back(30)} END, "
    f"n)) / greatest(coalesce(CASE WHEN count(n) {back(30)} >= 5 THEN stddev_samp(n) {back(30)} END, 1), 1e-3), 6) + 0.0 AS z30 "
    f"FROM nn WINDOW w AS (PARTITION BY country ORDER BY day)",
    ctes=VEC + NN,
)
def win_27(spark, sf):
    df = means(spark, sf).withColumn("n", F.col("n") + F.dayofmonth("day") % 4)
    return vectors.count_changes(df).select("country", "day", "d3", "d7", "top7", r6("z30").alias("z30"))


TRAIL = (
    ", tr AS (SELECT country, day, i, avg(m) "
    + back(5, key="country, i")
    + " AS incl, avg(m) "
    + back(5, False, "country, i")
    + " AS excl FROM mx)"
)


@query("win_28", "SELECT country, day, round(sum(incl), 5) + 0.0 AS incl, round(sum(excl), 5) + 0.0 AS excl FROM tr GROUP BY ALL", ctes=VEC + TRAIL)
def win_28(spark, sf):
    df = vectors.trailing_mean(vectors.trailing_mean(means(spark, sf), "mean", "a", 5, True), "mean", "b", 5, False)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda x, y: x + y), 5) + F.lit(0.0)
    return df.select("country", "day", total("a").alias("incl"), total("b").alias("excl"))


DEV = (
    (
        ", pv AS (SELECT country, day, list(past ORDER BY i) AS past, list(m ORDER BY i) AS mean "
        "FROM (SELECT country, day, i, m, CASE WHEN count(m) "
    )
    + back(30, False, "country, i")
    + " >= 5 THEN avg(m) "
    + back(30, False, "country, i")
    + " END AS past FROM mx) GROUP BY ALL), dv AS (SELECT country, day, CASE WHEN past[1] IS NULL THEN 0 ELSE "
    + NORM.format(a="list_transform(list_zip(mean, past), lambda z: z[1] - z[2])")
    + " END AS dev_l2, CASE WHEN past[1] IS NULL THEN 0 ELSE 1 - "
    + COS.format(a="mean", b="past")
    + " END AS dev_cos FROM pv)"
)


@query(
    "win_29",
    f"SELECT country, day, round(dev_l2, 6) AS dev_l2, round(dev_cos, 6) + 0.0 AS dev_cos, round(avg(dev_l2) {back(7)}, 6) AS dev_7, "
    f"round(avg(dev_l2) {back(7)} / (avg(dev_l2) {back(30)} + 1e-6), 6) AS dev_accel FROM dv",
    ctes=VEC + DEV,
)
def win_29(spark, sf):
    return vectors.deviations(means(spark, sf)).select("country", "day", *[r6(c).alias(c) for c in ("dev_l2", "dev_cos", "dev_7", "dev_accel")])


CGRID = (
    DAYLIM
    + (
        ", cg AS (SELECT country, anchor, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM dcos "
        "GROUP BY country, anchor), cd AS (SELECT country, day, anchor, coalesce(cos, 0) AS cos FROM cg LEFT "
        "JOIN dcos USING (country, day, anchor))"
    )
)


def cos_grid(spark, sf, rows=None):
    d = materialize(day_cos(spark, sf), "day_cos") if rows is None else rows
    return grid.filled(grid.calendar(d, keys=["country", "anchor"]), d, ["country", "day", "anchor"])


KA = "country, anchor"


@query(
    "win_30",
    f"SELECT country, day, anchor, round(avg(cos) {back(7, key=KA)}, 6) + 0.0 AS mean_7, "
    f"round(avg(cos) {back(30, key=KA)}, 6) + 0.0 AS mean_30, round(coalesce(stddev_samp(cos) {back(7, key=KA)}, 0), 6) + 0.0 AS std_7 "
    f"FROM cd",
    ctes=VEC + CGRID,
)
def win_30(spark, sf):
    specs = [Roll("mean_7", "cos", "avg", 7), Roll("mean_30", "cos", "avg", 30), Roll("std_7", "cos", "std", 7, fill=0.0)]
    return rolled(cos_grid(spark, sf), specs, ("country", "anchor")).select("country", "day", "anchor", *[r6(s.out).alias(s.out) for s in specs])


RISK = CGRID + ", rk AS (SELECT country, day, avg(cos) AS risk FROM cd WHERE anchor < 5 GROUP BY ALL)"


@query(
    "win_31",
    f"SELECT country, day, round(risk, 6) + 0.0 AS risk, round(avg(risk) {back(7)}, 6) + 0.0 AS mean_7, "
    f"round(max(risk) {back(7)}, 6) + 0.0 AS max_7, round(avg(risk) {back(30)}, 6) + 0.0 AS mean_30 FROM rk",
    ctes=VEC + RISK,
)
def win_31(spark, sf):
    df = cos_grid(spark, sf).where("anchor < 5").groupBy("country", "day").agg(F.avg("cos").alias("risk"))
    df = rolled(df, [Roll("mean_7", "risk", "avg", 7), Roll("max_7", "risk", "max", 7), Roll("mean_30", "risk", "avg", 30)])
    return df.select("country", "day", *[r6(c).alias(c) for c in ("risk", "mean_7", "max_7", "mean_30")])


@query(
    "win_32",
    f"SELECT country, day, anchor, f AS over_1, sum(f) {back(7, key=KA)}::BIGINT AS over_7, sum(f) {back(30, key=KA)}::BIGINT AS over_30 "
    f"FROM (SELECT country, day, anchor, (cos > coalesce(threshold, 0))::INT AS f FROM cd LEFT JOIN dlim USING (country, anchor))",
    ctes=VEC + CGRID,
)
def win_32(spark, sf):
    rows = materialize(day_cos(spark, sf), "day_cos")
    d = vectors.exceedances(cos_grid(spark, sf, rows), vectors.thresholds(rows.where(f"day <= '{TRAIN}'")))
    return d.select("country", "day", "anchor", F.col("over_1").cast("int").alias("over_1"), "over_7", "over_30")


SIG = (
    ", sg AS (SELECT country, day, i, (country IN ('NATION_0', 'NATION_1'))::INT AS y, avg(m) "
    + back(14, key="country, i")
    + (
        " AS t FROM mx), cent AS (SELECT i, avg(t) FILTER (y = 1) AS pos, avg(t) FILTER (y = 0) AS neg FROM sg GROUP BY i), "
        "dir AS (SELECT i, (pos - neg) / (sqrt(sum((pos - neg) * (pos - neg)) OVER ()) + 1e-12) AS d FROM cent)"
    )
)


def sig(spark, sf):
    return vectors.signature(means(spark, sf).withColumn("y", F.col("country").isin("NATION_0", "NATION_1").cast("int")), "y")


@query("agg_20", "SELECT (i - 1)::INT AS i, round(d, 6) + 0.0 AS x FROM dir", ctes=VEC + SIG)
def agg_20(spark, sf):
    return sig(spark, sf).select(F.posexplode("direction").alias("i", "x")).withColumn("x", r6("x"))


@query(
    "win_33",
    f"SELECT country, day, round(proj, 6) + 0.0 AS proj, round(avg(proj) {back(7)} / (abs(avg(proj) {back(30)}) + 1e-6), "
    f"4) + 0.0 AS proj_accel FROM (SELECT country, day, sum(m * d) AS proj FROM mx JOIN dir USING (i) GROUP BY ALL)",
    ctes=VEC + SIG,
)
def win_33(spark, sf):
    df = vectors.projected(means(spark, sf), sig(spark, sf))
    return df.select("country", "day", r6("proj").alias("proj"), (F.round("proj_accel", 4) + F.lit(0.0)).alias("proj_accel"))


@query(
    "jn_03",
    "SELECT country, day, coalesce(n, 0) AS n, coalesce(a, 0) AS a, (n IS NULL)::INT AS missing FROM (SELECT country, day, n FROM mean "
    "WHERE day < DATE '2024-02-01') FULL JOIN (SELECT country, day, count(*) AS a FROM art GROUP BY ALL) USING (country, day)",
    ctes=VEC,
)
def jn_03(spark, sf):
    a = means(spark, sf).select("country", "day", "n").where("day < '2024-02-01'")
    b = articles(spark, sf).groupBy("country", "day").agg(F.count("*").alias("a"))
    return joins.merged([a.withColumn("_there", F.lit(1)), b]).withColumn("missing", 1 - F.col("_there")).drop("_there")


# ---- fitted ----


@query("vec_04")
def vec_04(spark, sf):
    """Principal components of training rows, applied to all; a mean and a basis, not the rows, are kept."""
    from riskloom.operators.learning import principal

    return principal(titles(spark, sf), "vec", F.col("day") <= F.lit(TRAIN).cast("date"), 8).select("vec_id", "country", "day", "pc")


@query("vec_05")
def vec_05(spark, sf):
    from riskloom.operators.learning import clustered, principal

    df = principal(titles(spark, sf), "vec", F.col("day") <= F.lit(TRAIN).cast("date"), 8)
    return clustered(materialize(df, "pcs"), "pc", F.col("day") <= F.lit(TRAIN).cast("date"), 10).select("vec_id", "distances", "nearest", "mean_distance")
