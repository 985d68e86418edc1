"""Scans, ingest transforms, merges and incremental windows."""

import datetime as dt

from pyspark.sql import functions as F

from riskloom.functions import epoch14, r6
from riskloom.operators import grid, ingest, merge
from riskloom.plans.fixtures import articles, nations, news, orders, titles
from riskloom.plans.panel import order_panel
from riskloom.plans.registry import query
from riskloom.session import fresh_path, materialize, table
from riskloom.sources import append_run, by_file_name, coded_csv, embedded_json, harmonised, json_documents, non_empty, optional, overwrite, resolved, text_metrics, windowed

BRIDGE = "(VALUES ('F', 'north'), ('O', 'north'), ('P', 'south')) AS b(status, zone)"


@query("src_01", "SELECT count(*) AS n, round(sum(p_retailprice), 2) AS total, 'part' AS stem FROM part")
def src_01(spark, sf):
    t = table(spark, sf, "part")
    return by_file_name(spark, f"{sf}/part.parquet", t.schema, "stem").groupBy("stem").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@query(
    "src_02",
    f"SELECT zone, count(*) AS n, round(sum(amount), 2) AS amount FROM ord JOIN {BRIDGE} ON b.status = ord.status WHERE ord.status <> 'P' "
    f"GROUP BY ALL",
)
def src_02(spark, sf):
    path = fresh_path(spark, "csv")
    orders(spark, sf).select("order_id", "status", "amount").write.option("header", True).csv(path)
    codes = spark.createDataFrame([("F", "north"), ("O", "north")], "status string, zone string")
    return coded_csv(spark, path, "order_id long, status string, amount double", codes, "status").groupBy("zone").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))


@query(
    "src_03",
    "SELECT event_id, CAST(klass AS VARCHAR) AS klass, 0 AS src_priority FROM news WHERE day < DATE '2024-01-15' UNION ALL "
    "SELECT event_id, root AS klass, 1 AS src_priority FROM news WHERE day >= DATE '2024-01-10'",
)
def src_03(spark, sf):
    n = news(spark, sf)
    return harmonised([n.where("day < '2024-01-15'").select("event_id", "klass"), n.where("day >= '2024-01-10'").select("event_id", F.col("root").alias("klass"))])


@query("src_05", "SELECT event_id, country, day, root FROM news WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def src_05(spark, sf):
    return windowed(news(spark, sf), "2024-01-05", "2024-01-12", ["event_id", "country", "day", "root"])


@query("src_06", "SELECT vec_id, country, day, len(vec)::INT AS dims, round(vec[1], 6) + 0.0 AS head FROM tit WHERE day >= DATE '2024-01-05'")
def src_06(spark, sf):
    df = non_empty(titles(spark, sf).where("day >= '2024-01-05'"), "titles")
    return df.select("vec_id", "country", "day", F.size("vec").alias("dims"), r6(F.col("vec")[0]).alias("head"))


@query("src_07", "SELECT role, count(*) AS n, sum(turn)::BIGINT AS turns FROM conversations GROUP BY ALL")
def src_07(spark, sf):
    path = fresh_path(spark, "json")
    table(spark, sf, "conversations").write.json(path)
    return json_documents(spark, path, "conv_id long, turn long, role string, text string", multi_line=False).groupBy("role").agg(F.count("*").alias("n"), F.sum("turn").alias("turns"))


@query("src_08", "SELECT page_id, length(url) AS size, page_id % 7 AS k FROM pages")
def src_08(spark, sf):
    """The given pages hold no JSON blocks, so each gets two, at the end of its body."""
    block = lambda name, key, value: F.concat(F.lit(f'<script id="{name}" type="application/json">{{"{key}": '), value.cast("string"), F.lit("}</script>"))
    body = F.concat("html", block("meta", "size", F.length("url")), block("extra", "k", F.col("page_id") % 7))
    pages = table(spark, sf, "pages").select("page_id", body.alias("html"))
    return embedded_json(pages, "html", {"meta": "size int", "extra": "k long"}).select("page_id", "meta.size", "extra.k")


@query("src_09", "SELECT country, count(*) AS n FROM news GROUP BY ALL")
def src_09(spark, sf):
    return optional(spark, "no_such_scores", news(spark, sf)).groupBy("country").agg(F.count("*").alias("n"))


@query("src_10", "SELECT c_custkey AS entity, c_acctbal AS score, NULL::INT AS horizon FROM customer")
def src_10(spark, sf):
    fields = {"entity": (["iso3", "C_CUSTKEY"], ...), "score": (["calibrated", "c_acctBal"], ...), "horizon": (["horizon_days"], None)}
    return resolved(table(spark, sf, "customer"), fields).withColumn("horizon", F.col("horizon").cast("int"))


@query("snk_01", "SELECT root, count(*) AS n FROM news GROUP BY ALL")
def snk_01(spark, sf):
    path = fresh_path(spark, "overwrite")
    for _ in range(2):
        overwrite(news(spark, sf).select("event_id", "root"), path, "root")
    return spark.read.parquet(path).groupBy("root").agg(F.count("*").alias("n"))


@query("snk_02", "SELECT run AS run_ts, count(*) AS n FROM news, (VALUES ('r1'), ('r2')) AS t(run) GROUP BY ALL")
def snk_02(spark, sf):
    path = fresh_path(spark, "runs")
    for run in ("r1", "r2", "r1"):
        append_run(news(spark, sf).select("event_id"), path, run)
    return spark.read.schema("event_id long, run_ts string").parquet(path).groupBy("run_ts").agg(F.count("*").alias("n"))


@query("snk_03", "SELECT country, count(DISTINCT day)::INT AS days, count(*) AS n, min(day) AS first, max(doc_id) AS last_doc FROM art GROUP BY ALL")
def snk_03(spark, sf):
    path = fresh_path(spark, "docs")
    # a history holds days, as many as the calendar has, never all documents of a country
    daily = articles(spark, sf).groupBy("country", "day").agg(F.count("*").alias("n"), F.max("doc_id").alias("last_doc"))
    daily.groupBy("country").agg(F.max("last_doc").alias("last_doc"), F.sort_array(F.collect_list(F.struct("day", "n"))).alias("history")).write.json(path)
    back = spark.read.schema("country string, last_doc long, history array<struct<day:date,n:long>>").json(path)
    total = F.aggregate("history", F.lit(0).cast("long"), lambda a, h: a + h["n"])
    return back.select("country", F.size("history").alias("days"), total.alias("n"), F.col("history")[0]["day"].alias("first"), "last_doc")


@query("snk_04", "SELECT root, count(*) AS n FROM news GROUP BY ALL")
def snk_04(spark, sf):
    path = fresh_path(spark, "metrics")
    text_metrics(news(spark, sf).groupBy("root").agg(F.count("*").alias("n")), path)
    return spark.read.schema("root string, n long").option("header", True).csv(path)


# ---- ingest ----


@query("ing_01", f"SELECT order_id, zone FROM ord JOIN {BRIDGE} ON b.status = ord.status WHERE b.status <> 'P'")
def ing_01(spark, sf):
    bridge = spark.createDataFrame([("F", "north"), ("O", "north")], "status string, zone string")
    return ingest.keyed(orders(spark, sf), bridge, "status").select("order_id", "zone")


@query("ing_02", "SELECT order_id, day FROM ord")
def ing_02(spark, sf):
    raw = orders(spark, sf).select("order_id", F.date_format("day", "yyyyMMdd").cast("int").alias("sqldate"))
    return raw.select("order_id", ingest.int_day("sqldate").alias("day"))


RAW = (
    "raw AS (SELECT page_id, '1#A#N' || (page_id % 4) || '#x;2#B#N' || (page_id % 3) || '#y;1#C#Z9#z' AS locations, "
    "'<PAGE_TITLE> ' || CASE WHEN page_id % 5 = 0 THEN '' ELSE url END || ' </PAGE_TITLE>' AS extras, "
    "CASE WHEN page_id % 3 = 0 THEN 'eng:x' ELSE 'srclc:DEU;eng:y' END AS info, "
    "CASE WHEN page_id % 7 = 0 THEN 'bad' ELSE (page_id % 11 - 5.5)::VARCHAR || ',1,2' END AS tone FROM pages)"
)


def raw_articles(spark, sf):
    p, s = F.col("page_id"), lambda x: x.cast("string")
    return table(spark, sf, "pages").select(
        "page_id", F.concat(F.lit("1#A#N"), s(p % 4), F.lit("#x;2#B#N"), s(p % 3), F.lit("#y;1#C#Z9#z")).alias("locations"),
        F.concat(F.lit("<PAGE_TITLE> "), F.when(p % 5 == 0, F.lit("")).otherwise(F.col("url")), F.lit(" </PAGE_TITLE>")).alias("extras"),
        F.when(p % 3 == 0, F.lit("eng:x")).otherwise(F.lit("srclc:DEU;eng:y")).alias("info"),
        F.when(p % 7 == 0, F.lit("bad")).otherwise(F.concat(s(p % 11 - F.lit(5.5)), F.lit(",1,2"))).alias("tone"),
    )


CODES = ["N0", "N1", "N2"]
ING_03 = (
    "SELECT DISTINCT page_id, code FROM (SELECT page_id, split_part(unnest(string_split(locations, ';')), '#', 3) AS code FROM raw) "
    "WHERE code IN ('N0', 'N1', 'N2')"
)


@query("ing_03", ING_03, ctes=RAW)
def ing_03(spark, sf):
    return raw_articles(spark, sf).select("page_id", F.explode(ingest.matched_codes("locations", CODES)).alias("code"))


@query("ing_04", ING_03, ctes=RAW)
def ing_04(spark, sf):
    return ingest.exploded(raw_articles(spark, sf), "locations", CODES).select("page_id", "code")


@query("ing_05", "SELECT page_id, nullif(trim(regexp_extract(extras, '<PAGE_TITLE>(.*?)</PAGE_TITLE>', 1)), '') AS title FROM raw", ctes=RAW)
def ing_05(spark, sf):
    return raw_articles(spark, sf).select("page_id", ingest.title_of("extras", "PAGE_TITLE").alias("title"))


@query("ing_06", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'eng' ELSE 'deu' END AS language FROM raw", ctes=RAW)
def ing_06(spark, sf):
    return raw_articles(spark, sf).select("page_id", ingest.language_of("info").alias("language"))


@query("ing_07", "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN NULL ELSE (page_id % 11 - 5.5)::DOUBLE END AS tone FROM raw", ctes=RAW)
def ing_07(spark, sf):
    return raw_articles(spark, sf).select("page_id", ingest.first_number("tone").alias("tone"))


@query("ing_08", "SELECT doc_id, country, url, day FROM art QUALIFY row_number() OVER (PARTITION BY country, url ORDER BY day, doc_id) = 1")
def ing_08(spark, sf):
    return ingest.first_seen(articles(spark, sf).select("doc_id", "country", "url", "day"), ["country", "url"], "day", "doc_id")


@query("ing_09", "SELECT doc_id, country, url, day FROM art QUALIFY row_number() OVER (PARTITION BY day, country, url ORDER BY doc_id) = 1")
def ing_09(spark, sf):
    return ingest.first_seen(articles(spark, sf).select("doc_id", "country", "url", "day"), ["day", "country", "url"], "doc_id")


DOUBLED = "dup AS (SELECT event_id, value, 0 AS src FROM news UNION ALL SELECT event_id, value + 1, 1 FROM news WHERE event_id % 10 = 0)"


def doubled(spark, sf):
    n = news(spark, sf).select("event_id", "value")
    return n.withColumn("src", F.lit(0)).unionByName(n.where("event_id % 10 = 0").withColumns({"value": F.col("value") + 1, "src": F.lit(1)}))


@query(
    "ing_10",
    "SELECT event_id, round(value, 6) AS value FROM dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY src) = 1",
    ctes=DOUBLED,
)
def ing_10(spark, sf):
    return ingest.first_seen(doubled(spark, sf), ["event_id"], "src").select("event_id", r6("value").alias("value"))


@query(
    "ing_11",
    "SELECT event_id, round(value, 6) AS value FROM dup QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY src DESC) = 1",
    ctes=DOUBLED,
)
def ing_11(spark, sf):
    return ingest.last_seen(doubled(spark, sf), ["event_id"], "src").select("event_id", r6("value").alias("value"))


@query(
    "ing_12",
    "SELECT day, round(v, 4) AS v FROM (SELECT day, avg(amount) AS v, 0 AS src FROM ord GROUP BY day UNION ALL SELECT day, max(amount), 1 "
    "FROM ord WHERE month(day) = 6 GROUP BY day) QUALIFY row_number() OVER (PARTITION BY day ORDER BY src DESC) = 1",
)
def ing_12(spark, sf):
    o = orders(spark, sf)
    old = o.groupBy("day").agg(F.avg("amount").alias("v"), F.lit(0).alias("src"))
    new = o.where("month(day) = 6").groupBy("day").agg(F.max("amount").alias("v"), F.lit(1).alias("src"))
    return ingest.last_seen(old.unionByName(new), ["day"], "src").select("day", F.round("v", 4).alias("v"))


@query(
    "ing_13",
    "SELECT event_id, greatest(coalesce(CASE WHEN event_id % 6 = 0 THEN NULL WHEN event_id % 4 = 0 THEN -3 ELSE fatalities END, 0), "
    "0) AS deaths FROM news",
)
def ing_13(spark, sf):
    raw = F.when(F.col("event_id") % 6 == 0, F.lit("n/a")).when(F.col("event_id") % 4 == 0, F.lit("-3")).otherwise(F.col("fatalities").cast("string"))
    return news(spark, sf).withColumn("raw", raw).select("event_id", ingest.whole_number("raw").alias("deaths"))


@query(
    "ing_14",
    "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 7 ELSE CASE root WHEN 'view' THEN 1 WHEN 'click' THEN 3 ELSE 0 END END AS code "
    "FROM news",
)
def ing_14(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit("7")).otherwise(F.initcap("root"))
    return news(spark, sf).withColumn("raw", raw).select("event_id", ingest.coded("raw", {"view": 1, "click": 3}).alias("code"))


@query(
    "ing_15",
    "SELECT event_id, CASE WHEN intensity BETWEEN -4 AND 4 THEN round(intensity, 6) END AS intensity, "
    "CASE WHEN klass IN (1, 2, 3) THEN klass END AS klass FROM news",
)
def ing_15(spark, sf):
    return news(spark, sf).select("event_id", F.round(ingest.in_range("intensity", -4, 4), 6).alias("intensity"), ingest.in_range("klass", members=[1, 2, 3]).alias("klass"))


@query(
    "ing_16",
    "SELECT country, day, klass, cnt, -(b + unnest(range(1, cnt + 1)))::BIGINT AS event_no "
    "FROM (SELECT *, coalesce(sum(cnt) OVER (PARTITION BY country ORDER BY day, klass ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), "
    "0)::BIGINT AS b FROM (SELECT country, day, klass, count(*)::INT AS cnt FROM news WHERE klass IN (3, 4) GROUP BY ALL))",
)
def ing_16(spark, sf):
    per = news(spark, sf).groupBy("country", "day").agg(*[F.count_if(F.col("klass") == k).alias(f"c{k}") for k in (3, 4)])
    return ingest.synthetic(per, {3: "c3", 4: "c4"}, ["country", "day"])


@query(
    "ing_17",
    "SELECT event_id, day, round(value + CASE WHEN day BETWEEN DATE '2024-01-10' AND DATE '2024-01-15' THEN 1 ELSE 0 END, 6) AS value "
    "FROM news",
)
def ing_17(spark, sf):
    old = news(spark, sf).select("event_id", "day", "value")
    return ingest.replaced_period(old, old.withColumn("value", F.col("value") + 1), "2024-01-10", "2024-01-15").withColumn("value", r6("value"))


def markets(spark, sf):
    """One row per day, a column per priority level m1 to m5, from daily means."""
    long = orders(spark, sf).groupBy("day", F.concat(F.lit("m"), F.substring("priority", 1, 1)).alias("indicator")).agg(F.round(F.avg("amount"), 4).alias("close"))
    return ingest.wide_markets(long, [f"m{k}" for k in range(1, 6)])


MARKETS = (
    "mk AS (SELECT day, "
    + ", ".join(f"round(avg(amount) FILTER (substr(priority, 1, 1) = '{k}'), 4) AS m{k}" for k in range(1, 6))
    + " FROM ord GROUP BY day)"
)
query("ing_18", "SELECT * FROM mk", ctes=MARKETS)(markets)


@query(
    "ing_19",
    "SELECT day, a.m1, b.m2 FROM (SELECT day, m1 FROM mk WHERE day < DATE '2000-01-01') a FULL JOIN (SELECT day, m2 FROM mk "
    "WHERE day >= DATE '1997-01-01') b USING (day) WHERE day BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
    ctes=MARKETS,
)
def ing_19(spark, sf):
    m = materialize(markets(spark, sf), "markets")
    a, b = m.where("day < '2000-01-01'").select("day", "m1"), m.where("day >= '1997-01-01'").select("day", "m2")
    return windowed(a.join(b, "day", "full"), "1996-01-01", "2000-12-31", ["day", "m1", "m2"])


FF = "last_value({c} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BF = "first_value({c} IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
PCT = (
    MARKETS
    + ", mf AS (SELECT day, m1, m2, "
    + ", ".join(f"{FF.format(c=c)} AS f_{c}" for c in ("m1", "m2"))
    + " FROM mk), mc AS (SELECT day, "
    + ", ".join(f"(f_{c} / nullif(lag(f_{c}) OVER (ORDER BY day), 0) - 1) * 100 AS {c}_pct" for c in ("m1", "m2"))
    + " FROM mf)"
)


@query(
    "ing_20",
    "SELECT day, round(m1_pct, 6) + 0.0 AS m1_pct, round(m2_pct, 6) + 0.0 AS m2_pct, "
    "round(sqrt(abs(m1_pct) * abs(m2_pct)), 6) AS volatility FROM mc",
    ctes=PCT,
)
def ing_20(spark, sf):
    df = ingest.market_changes(markets(spark, sf), ["m1", "m2"], proxy=("m1", "m2"))
    return df.select("day", *[r6(c).alias(c) for c in ("m1_pct", "m2_pct", "volatility")])


CAL = (
    MARKETS
    + (
        ", cal AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM mk), "
        "mr AS (SELECT * FROM cal LEFT JOIN mk USING (day))"
    )
)


@query(
    "ing_21",
    "SELECT day, " + ", ".join(f"coalesce({FF.format(c=c)}, {BF.format(c=c)}) AS {c}" for c in ("m1", "m2", "m3", "m4", "m5")) + " FROM mr",
    ctes=CAL,
)
def ing_21(spark, sf):
    return grid.reindexed(markets(spark, sf), [f"m{k}" for k in range(1, 6)])


@query(
    "ing_22",
    "SELECT day, " + ", ".join(f"coalesce({BF.format(c=c)}, {FF.format(c=c)}) AS {c}" for c in ("m1", "m2", "m3", "m4", "m5")) + " FROM mr",
    ctes=CAL,
)
def ing_22(spark, sf):
    return grid.reindexed(markets(spark, sf), [f"m{k}" for k in range(1, 6)], back_first=True)


WIN08 = CAL + ", m8 AS (SELECT day, " + f"coalesce({FF.format(c='m1')}, {BF.format(c='m1')}) AS m1 FROM mr)"


@query(
    "win_08",
    "SELECT day, lag(m1, 1) OVER (ORDER BY day) AS m1_lag1, round((lag(m1, 1) OVER (ORDER BY day) / lag(m1, "
    "2) OVER (ORDER BY day) - 1) * 100, 6) + 0.0 AS m1_chg1, round((lag(m1, 1) OVER (ORDER BY day) / lag(m1, "
    "8) OVER (ORDER BY day) - 1) * 100, 6) + 0.0 AS m1_chg7 FROM m8",
    ctes=WIN08,
)
def win_08(spark, sf):
    from riskloom.operators.windows import changes

    df = grid.reindexed(markets(spark, sf).select("day", "m1"), ["m1"]).withColumn("_one", F.lit(0))
    return changes(df, "m1", ["_one"]).select("day", "m1_lag1", r6("m1_chg1").alias("m1_chg1"), r6("m1_chg7").alias("m1_chg7"))


@query(
    "jn_04",
    "SELECT country, day, n, m1 FROM op LEFT JOIN mk USING (day)",
    ctes="og AS (SELECT country, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM ord GROUP BY country), op AS (SELECT country, day, coalesce(n, 0) AS n FROM og LEFT JOIN (SELECT country, day, count(*) AS n FROM ord GROUP BY ALL) USING (country, day)), " + MARKETS,
)
def jn_04(spark, sf):
    return order_panel(spark, sf).select("country", "day", "n").join(F.broadcast(markets(spark, sf).select("day", "m1")), "day", "left").select("country", "day", "n", "m1")


# ---- merges ----

MERGED = (
    "t AS (SELECT event_id, day, value FROM news WHERE event_id % 3 <> 0), "
    "s AS (SELECT event_id, day, value + 1 AS value FROM news WHERE event_id % 3 = 0 OR event_id % 10 = 0)"
)
INSERTED = (
    "SELECT event_id, day, round(value, 6) AS value FROM (SELECT * FROM t UNION ALL SELECT * FROM s "
    "WHERE event_id NOT IN (SELECT event_id FROM t))"
)
UPSERTED = (
    "SELECT event_id, day, round(value, 6) AS value FROM (SELECT * FROM s UNION ALL SELECT * FROM t "
    "WHERE event_id NOT IN (SELECT event_id FROM s))"
)


def batches(spark, sf):
    n = news(spark, sf).select("event_id", "value", "day")
    return n.where("event_id % 3 <> 0"), n.where("event_id % 3 = 0 or event_id % 10 = 0").withColumn("value", F.col("value") + 1)


def twice(spark, sf, update):
    """Loads the first rows, then merges the others two times."""
    old, new = batches(spark, sf)
    path = fresh_path(spark, "target")
    overwrite(old, path, "day")
    for _ in range(2):
        merge.merge_into(spark, path, new, ["event_id", "day"], "day", update)
    return spark.read.schema(old.schema).parquet(path).select("event_id", "day", r6("value").alias("value"))


@query("mrg_01", INSERTED, ctes=MERGED)
def mrg_01(spark, sf):
    return twice(spark, sf, False)


@query("mrg_02", UPSERTED, ctes=MERGED)
def mrg_02(spark, sf):
    return twice(spark, sf, True)


@query("mrg_03", "SELECT count(DISTINCT day)::INT AS partitions FROM news WHERE day BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'")
def mrg_03(spark, sf):
    old, new = batches(spark, sf)
    path = fresh_path(spark, "bounded")
    overwrite(old, path, "day")
    n = merge.merge_into(spark, path, new.where("day between '2024-01-05' and '2024-01-07'"), ["event_id", "day"], "day", True)
    return spark.range(1).select(F.lit(n).alias("partitions"))


@query(
    "mrg_04",
    "SELECT event_id, country, round(value + CASE WHEN month(day) = 1 AND country IN ('NATION_1', 'NATION_2') THEN 1 ELSE 0 END, "
    "6) AS value FROM news",
)
def mrg_04(spark, sf):
    old = news(spark, sf).select("event_id", "country", "day", "value")
    within = (F.month("day") == 1) & F.col("country").isin("NATION_1", "NATION_2")
    return merge.reloaded(old, old.where(within).withColumn("value", F.col("value") + 1), within).select("event_id", "country", r6("value").alias("value"))


@query(
    "mrg_05",
    "SELECT country, day, n + CASE WHEN day >= DATE '2024-01-20' THEN 100 ELSE 0 END AS n FROM (SELECT country, day, count(*) AS n "
    "FROM tit GROUP BY ALL)",
)
def mrg_05(spark, sf):
    old = titles(spark, sf).groupBy("country", "day").agg(F.count("*").alias("n"))
    return merge.reloaded(old, old.where("day >= '2024-01-20'").withColumn("n", F.col("n") + 100), F.col("day") >= F.lit("2024-01-20").cast("date"))


@query(
    "mrg_06",
    "SELECT count(*) AS n_rows, 0::BIGINT AS null_keys, (SELECT count(*) FROM (SELECT event_id FROM dup "
    "GROUP BY event_id HAVING count(*) > 1)) AS repeated_keys, false AS passed FROM dup",
    ctes=DOUBLED,
)
def mrg_06(spark, sf):
    return merge.staging_report(doubled(spark, sf), ["event_id"])


@query(
    "mrg_07",
    "SELECT count(*) AS n_rows, min(day) AS first, max(day) AS last, count(DISTINCT country) AS keys, 0::BIGINT AS null_days, "
    "count(*) FILTER (day > DATE '2024-01-20') AS future_days, 'future dates' AS issues, false AS passed FROM news",
)
def mrg_07(spark, sf):
    return merge.load_report(news(spark, sf), "day", "country", "2024-01-20")


@query(
    "mrg_08",
    "SELECT country, coalesce(n, 0) AS n_rows, first, last, n IS NULL AS missing FROM nat LEFT "
    "JOIN (SELECT country, count(*) AS n, min(day) AS first, max(day) AS last FROM news WHERE country <> 'NATION_3' "
    "GROUP BY ALL) USING (country)",
)
def mrg_08(spark, sf):
    return merge.coverage_report(news(spark, sf).where("country <> 'NATION_3'"), nations(spark, sf), "country", "day")


@query(
    "mrg_09",
    "SELECT country, day, n FROM (SELECT country, day, hour(ts) // 8 AS b, count(*) AS n FROM news GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY country, day ORDER BY b DESC) = 1",
)
def mrg_09(spark, sf):
    parts = news(spark, sf).groupBy("country", "day", F.floor(F.hour("ts") / 8).alias("b")).agg(F.count("*").alias("n"))
    return merge.appended_last(parts, ["country", "day"], "b").drop("b")


# ---- incremental windows ----


@query(
    "inc_01",
    "SELECT root, count(*) AS n FROM news WHERE day >= (SELECT max(day) FROM news "
    "WHERE day <= DATE '2024-01-20') - 3 AND day <= DATE '2024-01-24' GROUP BY ALL",
)
def inc_01(spark, sf):
    n = news(spark, sf)
    last = merge.last_day(n.where("day <= '2024-01-20'"), "day").first().last
    first, end = merge.date_window(last, 3, dt.date(2024, 1, 25))
    return windowed(n, str(first), str(end), ["root"]).groupBy("root").agg(F.count("*").alias("n"))


@query("inc_02", "SELECT max(day) AS last FROM news")
def inc_02(spark, sf):
    return merge.last_day(news(spark, sf), "day", recent=60)


@query("inc_03", "SELECT country, max(day) AS last, 'ok' AS state FROM news GROUP BY country")
def inc_03(spark, sf):
    try:
        merge.date_window(None, 3, dt.date(2024, 1, 25))
    except ValueError:
        return news(spark, sf).groupBy("country").agg(F.max("day").alias("last"), F.lit("ok").alias("state"))
    raise AssertionError("a missing last day must be an error")


@query(
    "inc_04",
    "SELECT root, count(*) AS n FROM news WHERE ts BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND TIMESTAMP '2024-01-10 18:00:00' "
    "GROUP BY ALL",
)
def inc_04(spark, sf):
    a, b = merge.time_window(dt.datetime(2024, 1, 10, 12, 30), dt.datetime(2024, 1, 10, 18, 0))
    return news(spark, sf).where(F.col("ts").between(F.lit(str(a)).cast("timestamp"), F.lit(str(b)).cast("timestamp"))).groupBy("root").agg(F.count("*").alias("n"))


MARKS = "source string, last_success_at timestamp, updated_at timestamp, run_id string"


@query("inc_05", "SELECT 'events' AS source, max(day)::TIMESTAMP AS mark FROM news UNION ALL SELECT 'titles', TIMESTAMP '2024-01-03 04:00:00'")
def inc_05(spark, sf):
    at = dt.datetime(2024, 1, 3, 4, tzinfo=dt.UTC)
    marks = spark.createDataFrame([("titles", at, at, "r0")], MARKS)
    out = [merge.watermark(marks, s, news(spark, sf), "day").select(F.lit(s).alias("source"), F.col("mark")) for s in ("events", "titles")]
    return out[0].unionByName(out[1])


@query(
    "inc_06",
    "SELECT root, count(*) AS n FROM news WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00' "
    "GROUP BY ALL",
)
def inc_06(spark, sf):
    n = news(spark, sf).withColumn("stamp", epoch14("ts"))
    return merge.ingested(n, "stamp", 20240110000000, 20240112120000, "day").groupBy("root").agg(F.count("*").alias("n"))


@query("inc_07", "SELECT 'events' AS source, 'r1' AS run_id, max(ts) AS last_success_at FROM news")
def inc_07(spark, sf):
    at = news(spark, sf).agg(F.max("ts")).first()[0]
    marks = spark.createDataFrame([("events", dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), "r0")], MARKS)
    late = merge.advanced(merge.advanced(marks, "events", at, "bad", False), "events", at, "dry", True, True)
    return merge.advanced(late, "events", at, "r1", True).select("source", "run_id", "last_success_at")


@query("inc_08", "SELECT event_id, day, round(value + CASE WHEN day > DATE '2024-01-23' THEN 1 ELSE 0 END, 6) AS value FROM news")
def inc_08(spark, sf):
    old = news(spark, sf).select("event_id", "day", "value")
    again = old.where("day > '2024-01-23'").withColumn("value", F.col("value") + 1)
    return merge.upserted(old, again, ["event_id", "day"]).withColumn("value", r6("value"))


@query(
    "inc_09",
    "SELECT greatest(m, a) AS first, least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, b)::DATE AS last, (SELECT count(*) FROM ord "
    "WHERE day BETWEEN greatest(m, a) AND least(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, b)) AS n "
    "FROM (SELECT CAST(unnest(generate_series(date_trunc('month', a), b, INTERVAL 1 MONTH)) AS DATE) AS m, a, b "
    "FROM (SELECT DATE '1996-01-15' AS a, DATE '1996-06-10' AS b))",
)
def inc_09(spark, sf):
    slices = merge.months("1996-01-15", "1996-06-10", spark)
    o = windowed(orders(spark, sf), "1996-01-15", "1996-06-10", ["day"]).groupBy(F.trunc("day", "MM").alias("m")).agg(F.count("*").alias("n"))
    return slices.join(o, F.trunc("first", "MM") == F.col("m"), "left").select("first", "last", F.coalesce("n", F.lit(0)).alias("n"))


@query("inc_10", "SELECT country, count(*) AS n FROM news GROUP BY country")
def inc_10(spark, sf):
    n = news(spark, sf).select("country", "day")
    return merge.guarded_append(n.where("day < '2024-01-20'"), n.where("day >= '2024-01-20'"), "day").groupBy("country").agg(F.count("*").alias("n"))
