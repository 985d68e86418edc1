"""Filters, joins, ranks, top-k, sets and scores."""

from pyspark.sql import functions as F

from riskloom.functions import div, epoch14, logistic, logit, r6
from riskloom.operators import joins, ranks, scoring
from riskloom.operators.merge import upserted
from riskloom.plans.fixtures import articles, messages, nations, news, orders, predictions, titles
from riskloom.plans.registry import query
from riskloom.session import fresh_path, table
from riskloom.sources import append_run

SCO = (
    "sco AS (SELECT country, day, run AS run_ts, n, amount, 1 / (1 + exp(-((n - 6 + run) / 2.0::DOUBLE))) AS prob "
    "FROM (SELECT country, day, count(*) AS n, round(sum(amount), 2) AS amount FROM ord GROUP BY ALL), (VALUES (1), (2)) AS r(run))"
)
CST = (
    "cst AS (SELECT country, world, count(*) AS n, round(avg(amount), 2) AS score, count(*) FILTER (status = 'F') AS f, "
    "count(*) FILTER (status = 'O') AS o FROM ord JOIN nat USING (country) GROUP BY ALL)"
)


def scores(spark, sf):
    """country, day, run_ts (1 or 2), n, amount, prob."""
    per = orders(spark, sf).groupBy("country", "day").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount"))
    runs = per.withColumn("run_ts", F.explode(F.array(F.lit(1), F.lit(2))))
    return runs.withColumn("prob", logistic((F.col("n") - 6 + F.col("run_ts")) / 2.0))


def per_country(spark, sf):
    rows = orders(spark, sf).join(F.broadcast(nations(spark, sf).select("country", "world")), "country")
    return rows.groupBy("country", "world").agg(
        F.count("*").alias("n"), F.round(F.avg("amount"), 2).alias("score"), F.count_if(F.col("status") == "F").alias("f"), F.count_if(F.col("status") == "O").alias("o")
    )


# ---- filters ----


@query("flt_01", "SELECT event_id, country, root FROM news WHERE root IN ('error', 'purchase') AND country IN ('NATION_1', 'NATION_2', 'NATION_3')")
def flt_01(spark, sf):
    return news(spark, sf).where(F.col("root").isin("error", "purchase") & F.col("country").isin("NATION_1", "NATION_2", "NATION_3")).select("event_id", "country", "root")


@query("flt_02", "SELECT doc_id, title FROM art WHERE title IS NOT NULL AND length(title) >= 10")
def flt_02(spark, sf):
    return articles(spark, sf).where(F.length("title") >= 10).select("doc_id", "title")


@query("flt_03", "SELECT doc_id FROM art WHERE regexp_matches(themes, '(^|;)[Ee]n[^;]*')")
def flt_03(spark, sf):
    return articles(spark, sf).where(F.col("themes").rlike("(^|;)[Ee]n[^;]*")).select("doc_id")


@query(
    "flt_05",
    "SELECT CASE WHEN day <= DATE '1999-12-31' THEN 'train' WHEN day <= DATE '2000-06-30' THEN 'val' WHEN day <= DATE '2001-03-28' THEN "
    "'test' END AS split, count(*) AS n FROM ord WHERE day <= DATE '2001-03-28' GROUP BY ALL",
)
def flt_05(spark, sf):
    o = orders(spark, sf)
    split = F.when(F.col("day") <= "1999-12-31", "train").when(F.col("day") <= "2000-06-30", "val").when(F.col("day") <= "2001-03-28", "test")
    return o.withColumn("split", split).where("split is not null").groupBy("split").agg(F.count("*").alias("n"))


@query("flt_06", "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def flt_06(spark, sf):
    df = table(spark, sf, "customer")
    return df.select(*[c for c in df.columns if not c.startswith("c_acct")])


@query(
    "flt_08",
    "SELECT event_id, country, ts FROM news WHERE klass = 4 AND ts >= (SELECT max(ts) "
    "FROM news) - INTERVAL 5 DAY AND mentions >= 20 ORDER BY ts DESC, event_id LIMIT 100",
)
def flt_08(spark, sf):
    n = news(spark, sf)
    last = n.agg(F.max("ts").alias("last"))
    recent = n.join(F.broadcast(last), F.col("ts") >= F.col("last") - F.expr("interval 5 days"))
    return recent.where("klass = 4 and mentions >= 20").orderBy(F.col("ts").desc(), "event_id").limit(100).select("event_id", "country", "ts")


@query(
    "flt_09",
    "SELECT c.case_name, p.country, p.day, p.n FROM (VALUES ('a', 'NATION_1', DATE '1997-05-01'), "
    "('b', 'NATION_2', DATE '1999-02-10')) AS c(case_name, country, d) JOIN (SELECT country, day, count(*) AS n FROM ord "
    "GROUP BY ALL) p ON p.country = c.country AND p.day BETWEEN c.d - 30 AND c.d + 7",
)
def flt_09(spark, sf):
    cases = spark.createDataFrame([("a", "NATION_1", "1997-05-01"), ("b", "NATION_2", "1999-02-10")], "case_name string, country string, d string").withColumn("d", F.to_date("d"))
    per = orders(spark, sf).groupBy("country", "day").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(cases), "country").where(F.col("day").between(F.date_sub("d", 30), F.date_add("d", 7))).select("case_name", "country", "day", "n")


@query(
    "flt_10",
    "SELECT event_id, country, root, fatalities, ts FROM news WHERE contains(root, 'purch') AND day >= DATE '2024-01-10' "
    "QUALIFY row_number() OVER (PARTITION BY country ORDER BY fatalities DESC, ts DESC, event_id) = 1",
)
def flt_10(spark, sf):
    hits = news(spark, sf).where(F.col("root").contains("purch") & (F.col("day") >= "2024-01-10"))
    return ranks.first_rows(hits, ["country"], [F.col("fatalities").desc(), F.col("ts").desc(), F.col("event_id")]).select("event_id", "country", "root", "fatalities", "ts")


CONTEXT = (
    "ctx AS (SELECT country, count(*) FILTER (day > (SELECT max(day) FROM art) - 1) AS g24, count(*) FILTER (day > (SELECT max(day) "
    "FROM art) - 7) AS g7 FROM art GROUP BY country)"
)


def context(spark, sf):
    """Articles of the last day and week, counted back from the table's last day."""
    a = articles(spark, sf)
    last = a.agg(F.max("day").alias("last"))
    return a.join(F.broadcast(last)).groupBy("country").agg(F.count_if(F.col("day") > F.date_sub("last", 1)).alias("g24"), F.count_if(F.col("day") > F.date_sub("last", 7)).alias("g7"))


@query("agg_29", "SELECT * FROM ctx", ctes=CONTEXT)
def agg_29(spark, sf):
    return context(spark, sf)


@query("flt_11", "SELECT * FROM ctx WHERE g7 > 0 OR g24 > 0", ctes=CONTEXT)
def flt_11(spark, sf):
    return context(spark, sf).where("g7 > 0 or g24 > 0")


@query(
    "agg_30",
    "SELECT country, n + greatest(1, least(10, ceil(g7 / 10)))::BIGINT AS signals FROM ctx JOIN (SELECT country, count(*) AS n FROM news "
    "WHERE klass = 4 GROUP BY ALL) USING (country)",
    ctes=CONTEXT,
)
def agg_30(spark, sf):
    seen = news(spark, sf).where("klass = 4").groupBy("country").agg(F.count("*").alias("n"))
    return context(spark, sf).join(seen, "country").select("country", (F.col("n") + F.greatest(F.lit(1), F.least(F.lit(10), F.ceil(F.col("g7") / 10)))).cast("long").alias("signals"))


@query(
    "agg_31",
    "SELECT country, count(*) AS n, round(avg(amount), 4) AS mean_amount, max(amount) AS max_amount, round(avg(prob), 6) AS mean_prob, "
    "max(prob) AS max_prob, arg_min(day, (-prob, day)) AS peak FROM sco WHERE run_ts = 2 AND day > (SELECT max(day) FROM sco) - 30 "
    "GROUP BY country",
    ctes=SCO,
)
def agg_31(spark, sf):
    s = scores(spark, sf).where("run_ts = 2")
    recent = s.join(F.broadcast(s.agg(F.max("day").alias("last")))).where(F.col("day") > F.date_sub("last", 30))
    return recent.groupBy("country").agg(
        F.count("*").alias("n"), F.round(F.avg("amount"), 4).alias("mean_amount"), F.max("amount").alias("max_amount"),
        r6(F.avg("prob")).alias("mean_prob"), F.max("prob").alias("max_prob"), F.min_by("day", F.struct(-F.col("prob"), F.col("day"))).alias("peak"),
    )


# ---- ranks ----

AVG_RANK = "round((rank() OVER (ORDER BY {v}) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0::DOUBLE) / count(*) OVER () * 100, 6)"


@query("win_19", f"SELECT country, f, {AVG_RANK.format(v='f')} AS rank FROM cst", ctes=CST)
def win_19(spark, sf):
    return ranks.percentile_rank(per_country(spark, sf), "f", "rank").select("country", "f", r6("rank").alias("rank"))


@query(
    "win_20",
    "SELECT country, score, rank() OVER (ORDER BY score DESC) AS rank, "
    "round(100 * (1 - percent_rank() OVER (ORDER BY score DESC)), 6) AS rank_score FROM cst",
    ctes=CST,
)
def win_20(spark, sf):
    return ranks.rank_score(per_country(spark, sf), "score").select("country", "score", "rank", r6("rank_score").alias("rank_score"))


@query(
    "win_21",
    "SELECT country, day, round(prob, 6) AS prob, round(percent_rank() OVER (PARTITION BY day ORDER BY prob), 6) AS percent_rank, "
    "round(cume_dist() OVER (PARTITION BY day ORDER BY prob), 6) AS cume_dist FROM sco WHERE run_ts = 2",
    ctes=SCO,
)
def win_21(spark, sf):
    return ranks.shares(scores(spark, sf).where("run_ts = 2"), "prob", ["day"]).select("country", "day", *[r6(c).alias(c) for c in ("prob", "percent_rank", "cume_dist")])


LATEST = "SELECT country, day, run_ts, n, round(prob, 6) AS prob FROM sco"


@query("win_22", LATEST + " QUALIFY row_number() OVER (PARTITION BY country, day ORDER BY run_ts DESC) = 1", ctes=SCO)
def win_22(spark, sf):
    return ranks.first_rows(scores(spark, sf), ["country", "day"], [F.col("run_ts").desc()]).select("country", "day", "run_ts", "n", r6("prob").alias("prob"))


@query(
    "win_23",
    LATEST + " WHERE day = (SELECT max(day) FROM sco) QUALIFY row_number() OVER (PARTITION BY country ORDER BY run_ts DESC) = 1",
    ctes=SCO,
)
def win_23(spark, sf):
    return ranks.at_latest(scores(spark, sf), "day", ["country"], [F.col("run_ts").desc()]).select("country", "day", "run_ts", "n", r6("prob").alias("prob"))


@query("win_24", LATEST + " QUALIFY row_number() OVER (PARTITION BY country ORDER BY day DESC, run_ts DESC) = 1", ctes=SCO)
def win_24(spark, sf):
    newest = scores(spark, sf).groupBy("country").agg(F.max(F.struct("day", "run_ts", "n", "prob")).alias("x"))
    return newest.select("country", "x.day", "x.run_ts", "x.n", r6("x.prob").alias("prob"))


# ---- top-k ----


@query(
    "top_01",
    "SELECT country, day, title, n FROM (SELECT country, day, title, count(*) AS n, count(DISTINCT domain) AS d FROM art GROUP BY ALL) "
    "QUALIFY row_number() OVER (PARTITION BY country, day ORDER BY d DESC, n DESC, title) <= 5",
)
def top_01(spark, sf):
    from riskloom.operators.daily import title_rollup

    return ranks.first_rows(title_rollup(articles(spark, sf)), ["country", "day"], [F.col("domains").desc(), F.col("n").desc(), F.col("title")], 5).select("country", "day", "title", "n")


@query(
    "top_02",
    "SELECT country, url, day, doc_id FROM (SELECT * FROM art "
    "QUALIFY row_number() OVER (PARTITION BY country, url ORDER BY day DESC, doc_id) = 1) "
    "QUALIFY row_number() OVER (PARTITION BY country ORDER BY day DESC, doc_id) <= 3",
)
def top_02(spark, sf):
    order = [F.col("day").desc(), F.col("doc_id")]
    return ranks.first_rows(ranks.first_rows(articles(spark, sf), ["country", "url"], order), ["country"], order, 3).select("country", "url", "day", "doc_id")


STOP = ("that", "this", "with", "from")


@query(
    "top_03",
    f"SELECT * FROM (SELECT country, token, count(*) AS n "
    f"FROM (SELECT country, unnest(regexp_extract_all(lower(title), '[a-z]{{4,}}')) AS token FROM art) WHERE token NOT IN {STOP} "
    f"GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY country ORDER BY n DESC, token) <= 6",
)
def top_03(spark, sf):
    from riskloom.operators.text import title_tokens

    tokens = articles(spark, sf).select("country", F.explode(title_tokens("title", STOP)).alias("token"))
    return ranks.first_rows(tokens.groupBy("country", "token").agg(F.count("*").alias("n")), ["country"], [F.col("n").desc(), F.col("token")], 6)


@query("top_04", "SELECT country, score FROM cst ORDER BY score DESC, country LIMIT 10", ctes=CST)
def top_04(spark, sf):
    return per_country(spark, sf).select("country", "score").orderBy(F.col("score").desc(), "country").limit(10)


@query("top_05", "SELECT country, event_id, ts FROM news QUALIFY row_number() OVER (PARTITION BY country ORDER BY ts DESC, event_id) <= 4")
def top_05(spark, sf):
    return ranks.first_rows(news(spark, sf), ["country"], [F.col("ts").desc(), F.col("event_id")], 4).select("country", "event_id", "ts")


@query(
    "top_06",
    "SELECT country, event_id, fatalities FROM (SELECT country, event_id, "
    "CASE WHEN event_id % 9 = 0 THEN NULL ELSE fatalities END AS fatalities FROM news) "
    "QUALIFY row_number() OVER (PARTITION BY country ORDER BY coalesce(fatalities, 0) DESC, event_id) <= 5",
)
def top_06(spark, sf):
    n = news(spark, sf).withColumn("fatalities", F.when(F.col("event_id") % 9 != 0, F.col("fatalities")))
    return ranks.first_rows(n, ["country"], [F.coalesce("fatalities", F.lit(0)).desc(), F.col("event_id")], 5).select("country", "event_id", "fatalities")


@query("top_07", "SELECT doc_id, row_number() OVER (ORDER BY p DESC, doc_id) <= greatest(1, floor(count(*) OVER () * 0.05)) AS top FROM pred")
def top_07(spark, sf):
    return ranks.top_fraction(predictions(spark, sf), "p", 0.05, "doc_id").select("doc_id", "top")


@query("top_08", "SELECT country, list(event_id ORDER BY ts DESC, event_id)[1:10]::VARCHAR AS events FROM news GROUP BY country")
def top_08(spark, sf):
    first = ranks.first_rows(news(spark, sf), ["country"], [F.col("ts").desc(), F.col("event_id")], 10)
    rows = first.groupBy("country").agg(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), "event_id"))).alias("e"))
    return rows.select("country", F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x.event_id.cast("string")), ", "), F.lit("]")).alias("events"))


# ---- sets ----


@query(
    "set_01",
    "SELECT source, count(*) AS n FROM (SELECT 'a' AS source FROM news WHERE klass < 3 UNION ALL SELECT 'b' FROM news WHERE klass > 1) "
    "GROUP BY source",
)
def set_01(spark, sf):
    n = news(spark, sf)
    both = n.where("klass < 3").withColumn("source", F.lit("a")).unionByName(n.where("klass > 1").withColumn("source", F.lit("b")))
    return both.groupBy("source").agg(F.count("*").alias("n"))


KEYS_SQL = "SELECT DISTINCT country, day FROM ord EXCEPT SELECT country, day FROM ord WHERE status = 'F'"


@query("set_02", KEYS_SQL)
def set_02(spark, sf):
    o = orders(spark, sf)
    return o.select("country", "day").distinct().exceptAll(o.where("status = 'F'").select("country", "day").distinct())


@query("jn_08", KEYS_SQL)
def jn_08(spark, sf):
    o = orders(spark, sf)
    return o.select("country", "day").distinct().join(o.where("status = 'F'").select("country", "day"), ["country", "day"], "left_anti")


@query(
    "set_03",
    "SELECT round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a OR b), 0), 6) AS jaccard, "
    "round(count(*) FILTER (a AND b) / nullif(count(*) FILTER (a), 0), 6) AS overlap "
    "FROM (SELECT row_number() OVER (ORDER BY p DESC, doc_id) <= greatest(1, floor(count(*) OVER () * 0.2)) AS a, "
    "row_number() OVER (ORDER BY q DESC, doc_id) <= greatest(1, floor(count(*) OVER () * 0.2)) AS b FROM pred)",
)
def set_03(spark, sf):
    a = ranks.top_fraction(predictions(spark, sf), "p", 0.2, "doc_id").withColumnRenamed("top", "a")
    both = ranks.top_fraction(a, "q", 0.2, "doc_id").withColumnRenamed("top", "b")
    n = F.count_if(F.col("a") & F.col("b"))
    return both.agg(r6(div(n, F.count_if(F.col("a") | F.col("b")))).alias("jaccard"), r6(div(n, F.count_if("a"))).alias("overlap"))


@query("set_04", "SELECT DISTINCT country, day FROM ord")
def set_04(spark, sf):
    return orders(spark, sf).select("country", "day").distinct()


# ---- joins ----

EDGES = "edges AS (SELECT a.country, b.country AS neighbour FROM nat a JOIN nat b ON a.world = b.world AND a.k <> b.k)"


def edges(spark, sf):
    a = nations(spark, sf)
    b = a.select(F.col("country").alias("neighbour"), "world", F.col("k").alias("k2"))
    return a.join(F.broadcast(b), "world").where("k <> k2").select("country", "neighbour")


HOT = (
    "hot AS (SELECT country, count(*) AS hot_neighbours, least(5, 1.5 * count(*))::DOUBLE AS bonus FROM edges "
    "WHERE neighbour IN (SELECT country FROM cst WHERE n >= (SELECT median(n) FROM cst)) GROUP BY country)"
)


def hot_set(spark, sf):
    c = per_country(spark, sf)
    return c.join(F.broadcast(c.agg(F.median("n").alias("m")))).where("n >= m")


@query("jn_09", "SELECT country, hot_neighbours FROM hot", ctes=f"{CST}, {EDGES}, {HOT}")
def jn_09(spark, sf):
    return joins.hot_neighbours(edges(spark, sf), hot_set(spark, sf)).select("country", "hot_neighbours")


@query("scr_07", "SELECT * FROM hot", ctes=f"{CST}, {EDGES}, {HOT}")
def scr_07(spark, sf):
    return joins.hot_neighbours(edges(spark, sf), hot_set(spark, sf))


@query(
    "jn_10",
    "SELECT n.event_id, n.country, (SELECT max(a.ts) FROM news a "
    "WHERE a.country = n.country AND a.root = 'error' AND a.ts <= n.ts) AS alert FROM news n WHERE n.root = 'purchase'",
)
def jn_10(spark, sf):
    n = news(spark, sf)
    alerts = n.where("root = 'error'").select("country", "ts", F.col("ts").alias("at"))
    return joins.as_of(n.where("root = 'purchase'").select("event_id", "country", "ts"), alerts, "country", "ts", "at", "alert").select("event_id", "country", "alert")


@query("jn_11", "SELECT count(*) AS n, count(score) AS found FROM sco LEFT JOIN cst USING (country)", ctes=f"{SCO}, {CST}")
def jn_11(spark, sf):
    both = joins.row_preserving(scores(spark, sf), per_country(spark, sf).select("country", "score"), ["country"])
    return both.agg(F.count("*").alias("n"), F.count("score").alias("found"))


@query("jn_12", "SELECT doc_id, round(p, 6) AS p, round(q, 6) AS q FROM pred")
def jn_12(spark, sf):
    p = predictions(spark, sf)
    return joins.lossless(p.select("doc_id", "p"), p.select("doc_id", "q"), ["doc_id"]).select("doc_id", r6("p").alias("p"), r6("q").alias("q"))


@query(
    "jn_13",
    "SELECT channel, count(*) AS n, count(k) AS kept FROM msg LEFT JOIN (SELECT message_id, 1 AS k FROM msg "
    "WHERE length(text) > 100) USING (message_id) GROUP BY channel",
)
def jn_13(spark, sf):
    m = messages(spark, sf)
    found = m.where(F.length("text") > 100).select("message_id", F.lit(1).alias("k"))
    return m.join(found, "message_id", "left").groupBy("channel").agg(F.count("*").alias("n"), F.count("k").alias("kept"))


FLAGGED = (
    "SELECT country, score FROM nat LEFT JOIN (SELECT country, score, "
    "CASE WHEN n % 3 = 0 THEN false WHEN n % 3 = 1 THEN true END AS visible FROM cst) USING (country) WHERE visible IS DISTINCT FROM false"
)


def visible(spark, sf):
    live = per_country(spark, sf).withColumn("visible", F.when(F.col("n") % 3 == 0, F.lit(False)).when(F.col("n") % 3 == 1, F.lit(True)))
    return nations(spark, sf).select("country").join(live, "country", "left").where(~F.col("visible").eqNullSafe(F.lit(False))).select("country", "score")


query("jn_14", FLAGGED, ctes=CST)(visible)


@query("brf_05", FLAGGED, ctes=CST)
def brf_05(spark, sf):
    visible(spark, sf).createOrReplaceTempView("latest_scores")
    return spark.table("latest_scores")


@query("jn_15", "SELECT country, score AS risk FROM cst", ctes=CST)
def jn_15(spark, sf):
    live = per_country(spark, sf).select("country", F.col("score").alias("risk"))
    stored = live.withColumn("risk", F.lit(0.0))
    return stored if live.isEmpty() else live


@query("jn_16", "SELECT country FROM news UNION SELECT country FROM art UNION SELECT country FROM tit")
def jn_16(spark, sf):
    parts = [f(spark, sf).select("country") for f in (news, articles, titles)]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


# ---- scores ----


@query("mth_01", "SELECT country, round(100 / (1 + exp(-((score - 200000) / 50000))), 4) AS level FROM cst", ctes=CST)
def mth_01(spark, sf):
    return per_country(spark, sf).select("country", F.round(100 * logistic((F.col("score") - 200000) / 50000), 4).alias("level"))


@query("mth_03", "SELECT doc_id, round(ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))), 6) + 0.0 AS z FROM pred")
def mth_03(spark, sf):
    return predictions(spark, sf).select("doc_id", r6(logit("p")).alias("z"))


META = "1 / (1 + exp(-(-0.5 + ((ln(p / (1 - p)) - 0.1) / 1.5 * 0.8) + ((ln(q / (1 - q)) - 0.2) / 2.0 * 0.4))))"


@query(
    "scr_01",
    f"SELECT doc_id, round({META}, 6) AS prob FROM (SELECT doc_id, greatest(1e-6, least(1 - 1e-6, p)) AS p, "
    f"greatest(1e-6, least(1 - 1e-6, q)) AS q FROM pred)",
)
def scr_01(spark, sf):
    prob = scoring.standardised_logistic({"p": (0.1, 1.5, 0.8), "q": (0.2, 2.0, 0.4)}, -0.5, True)
    return predictions(spark, sf).select("doc_id", r6(prob).alias("prob"))


@query(
    "scr_02",
    "SELECT country, day, (1 / (1 + exp(-(0.3 - (n - 5) / 2.0 * 0.9 - (prob - 0.5) / 0.2 * 0.1))) >= 0.4)::INT AS calm, "
    "(n = 0)::INT AS fallback FROM sco WHERE run_ts = 2",
    ctes=SCO,
)
def scr_02(spark, sf):
    s = scores(spark, sf).where("run_ts = 2")
    gated = scoring.calm_gate(s, {"n": (5, 2.0, -0.9), "prob": (0.5, 0.2, -0.1)}, 0.3, 0.4)
    simple = scoring.calm_gate(s, {"absent": (0, 1, 1)}, 0, 0, "n").select("country", "day", F.col("calm").alias("fallback"))
    return gated.join(simple, ["country", "day"]).select("country", "day", "calm", "fallback")


ALERT = (
    "al AS (SELECT country, day, prob, greatest(0, least(100, 0.7 * prob * 100 + 0.3 * 100 * (1 - percent_rank() OVER (PARTITION BY day "
    "ORDER BY prob DESC)))) AS alert_score FROM sco WHERE run_ts = 2)"
)


@query("scr_04", "SELECT country, day, round(alert_score, 6) AS alert_score FROM al", ctes=f"{SCO}, {ALERT}")
def scr_04(spark, sf):
    return scoring.alert_score(scores(spark, sf).where("run_ts = 2"), "prob", ["day"]).select("country", "day", r6("alert_score").alias("alert_score"))


STATE = (
    (
        "st AS (SELECT country, u, 100 / (1 + exp(-((score - 150000) / 100000 + (n - 500) / 500.0) / 2)) AS c, 0.6 * sf + 0.4 * so AS s, "
        "greatest(0, least(100, 50 * coalesce(f::DOUBLE / nullif(o, 0), 0))) AS i FROM (SELECT *, "
    )
    + AVG_RANK.format(v="n").removeprefix("round(").removesuffix(", 6)")
    + " AS u, "
    + AVG_RANK.format(v="f").removeprefix("round(").removesuffix(", 6)")
    + " AS sf, "
    + AVG_RANK.format(v="o").removeprefix("round(").removesuffix(", 6)")
    + " AS so FROM cst))"
)


def state(spark, sf):
    df = per_country(spark, sf).withColumns({"z1": (F.col("score") - 150000) / 100000, "z2": (F.col("n") - 500) / 500.0})
    return scoring.current_state(df, "n", ["z1", "z2"], ("f", "o"), ("f", "o"))


@query(
    "scr_05",
    "SELECT country, round(u, 5) AS u, round(c, 5) AS c, round(s, 5) AS s, round(i, 5) AS i, round((u + c + s + i) / 4, 5) AS state "
    "FROM st",
    ctes=f"{CST}, {STATE}",
)
def scr_05(spark, sf):
    return state(spark, sf).select("country", *[F.round(x, 5).alias(x) for x in ("u", "c", "s", "i", "state")])


@query("scr_06", f"SELECT country, {AVG_RANK.format(v='n')} AS baseline FROM cst", ctes=CST)
def scr_06(spark, sf):
    return scoring.with_baseline(per_country(spark, sf), None, "n").select("country", r6("baseline").alias("baseline"))


COMPOSITE = (
    f"{CST}, {EDGES}, {STATE}, cm AS (SELECT country, u AS baseline, (u + c + s + i) / 4 AS state, i AS forecast FROM st), "
    f"hn AS (SELECT country, least(5, 1.5 * count(*)) AS bonus FROM edges WHERE neighbour IN (SELECT country FROM cm "
    f"WHERE forecast >= 50) GROUP BY country), co AS (SELECT country, "
    f"greatest(0, least(100, 0.2 * baseline + 0.4 * state + 0.4 * forecast + coalesce(bonus, 0))) AS composite FROM cm LEFT "
    f"JOIN hn USING (country))"
)


def composites(spark, sf):
    df = state(spark, sf).select("country", F.col("u").alias("baseline"), "state", F.col("i").alias("forecast"))
    return scoring.composite(df, edges(spark, sf), 50)


@query("scr_08", "SELECT country, round(composite, 5) AS composite FROM co", ctes=COMPOSITE)
def scr_08(spark, sf):
    return composites(spark, sf).select("country", F.round("composite", 5).alias("composite"))


@query(
    "scr_09",
    "SELECT country, CASE WHEN composite >= 70 THEN 'ALERT' WHEN composite >= 50 THEN 'WARNING' WHEN composite >= 25 THEN 'WATCH' ELSE "
    "'STABLE' END AS tier, CASE WHEN pr >= 98 THEN 'severe' WHEN pr >= 95 THEN 'high' WHEN pr >= 85 THEN 'elevated' ELSE 'normal' END AS "
    "place FROM (SELECT country, composite, cume_dist() OVER (ORDER BY round(composite, 6)) * 100 AS pr FROM co)",
    ctes=COMPOSITE,
)
def scr_09(spark, sf):
    df = ranks.shares(composites(spark, sf).withColumn("_c", F.round("composite", 6)), "_c")
    return df.select("country", scoring.tiered(F.col("composite")).alias("tier"), scoring.tiered(F.col("cume_dist") * 100, scoring.PERCENT_TIERS, "normal").alias("place"))


@query(
    "scr_10",
    "SELECT country, horizon, run, round(prob, 6) AS prob, history "
    "FROM (SELECT country, 7 AS horizon, 'r' || run_ts AS run, prob, count(*) OVER (PARTITION BY country) AS history, "
    "row_number() OVER (PARTITION BY country ORDER BY run_ts DESC) AS k FROM sco WHERE day = (SELECT max(day) FROM sco)) WHERE k = 1",
    ctes=SCO,
)
def scr_10(spark, sf):
    path, s = fresh_path(spark, "history"), scores(spark, sf)
    last = ranks.at_latest(s, "day", ["country", "run_ts"], [F.col("n").desc()]).withColumn("horizon", F.lit(7))
    latest = None
    for run in (1, 2, 2):
        new = last.where(F.col("run_ts") == run).select("country", "horizon", F.lit(f"r{run}").alias("run"), "prob")
        append_run(new, path, f"r{run}")
        latest = new if latest is None else upserted(latest, new, ["country", "horizon"])
    history = spark.read.schema("country string, horizon int, run string, prob double, run_ts string").parquet(path).groupBy("country").agg(F.count("*").alias("history"))
    return latest.join(history, "country").select("country", "horizon", "run", r6("prob").alias("prob"), "history")


@query(
    "scr_11",
    "SELECT country, CASE WHEN n >= 620 THEN 'high' WHEN n >= 580 THEN 'medium' ELSE 'low' END AS level, 40.0::DOUBLE AS default_medium "
    "FROM cst",
    ctes=CST,
)
def scr_11(spark, sf):
    rows = spark.createDataFrame(
        [("onset", True, None, 1, 500.0, 600.0), ("onset", True, None, 2, 580.0, 620.0), ("onset", False, None, 3, 1.0, 2.0), ("onset", True, "NATION_1", 4, 3.0, 4.0)],
        "target string, active boolean, country string, created int, medium double, high double",
    )
    now, none = scoring.thresholds(rows, "onset"), scoring.thresholds(rows, "other").select(F.col("medium").alias("default_medium"))
    df = per_country(spark, sf).join(F.broadcast(now)).join(F.broadcast(none))
    return df.select("country", F.when(F.col("n") >= F.col("high"), "high").when(F.col("n") >= F.col("medium"), "medium").otherwise("low").alias("level"), "default_medium")


@query("scr_12", "SELECT country AS target, 7 AS horizon, v AS version, v = 2 AS active FROM cst, (VALUES (1), (2)) AS t(v)", ctes=CST)
def scr_12(spark, sf):
    first = per_country(spark, sf).select(F.col("country").alias("target"), F.lit(7).alias("horizon"), F.lit(1).alias("version"), F.lit(True).alias("active"))
    second = first.withColumn("version", F.lit(2))
    return scoring.activated(scoring.activated(first, second), second)


@query("scr_13", "SELECT doc_id, CASE WHEN p >= 0.75 THEN 'high' WHEN p >= 0.55 THEN 'medium' ELSE 'low' END AS badge FROM pred")
def scr_13(spark, sf):
    return predictions(spark, sf).select("doc_id", scoring.tiered(F.col("p"), scoring.BADGES, "low").alias("badge"))


@query("dt_02", "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') AS BIGINT) AS stamp FROM news")
def dt_02(spark, sf):
    return news(spark, sf).select("event_id", epoch14("ts").alias("stamp"))


@query("dt_01", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) END AS at FROM news")
def dt_01(spark, sf):
    from riskloom.operators.text import iso_time

    iso = F.when(F.col("event_id") % 5 == 0, F.lit("not a time")).when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return news(spark, sf).withColumn("iso", iso).select("event_id", iso_time("iso").alias("at"))
