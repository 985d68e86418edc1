"""Streams, drained; their SQL equivalents are those of their batch twins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom import streaming
from riskloom.functions import r6
from riskloom.operators import text
from riskloom.operators.windows import Roll
from riskloom.plans.fixtures import articles, messages, nations, news
from riskloom.plans.panel import ONLINE, OWN, order_panel
from riskloom.plans.registry import query
from riskloom.plans.texts import EV, HURT, KINDS, LEX, NEG, PLACES
from riskloom.session import fresh_path, materialize
from riskloom.sources import overwrite


def landing(df, spark, label, files=4, order=None):
    """The rows as files that a stream reads, in ``files`` batches; each has as many as there are cores, since one file may be no more than one task."""
    path, each = fresh_path(spark, label), max(spark.sparkContext.defaultParallelism, 1)
    (df.repartitionByRange(files * each, order) if order else df.repartition(files * each)).write.parquet(path)
    return streaming.landed(spark, path, df.schema, each)


def news_rows(spark, sf):
    return news(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st_01", "SELECT event_id, day, round(value, 6) AS value FROM news")
def st_01(spark, sf):
    n = news(spark, sf).select("event_id", "value", F.col("ts").cast("timestamp").alias("ingested"), "day")
    path = fresh_path(spark, "events")
    # in no order of time, so that some events come after the watermark, and a tenth of them come again
    streaming.insert_events(landing(n.unionByName(n.where("event_id % 10 = 0")), spark, "landed"), path, fixed_stamps=True)
    return spark.read.schema(n.schema).parquet(path).select("event_id", "day", r6("value").alias("value"))


@query("st_02", "SELECT doc_id, country, url, day FROM art QUALIFY row_number() OVER (PARTITION BY day, country, url ORDER BY doc_id DESC) = 1")
def st_02(spark, sf):
    a = articles(spark, sf).select("doc_id", "country", "url", "day")
    path = fresh_path(spark, "articles")
    streaming.upsert_articles(landing(a, spark, "raw", order="doc_id"), path, lambda df: df.where("url is not null"), ["day", "country", "url"], "doc_id")
    return spark.read.schema(a.schema).parquet(path)


@query("st_03", "SELECT country, CAST(ts AS DATE) AS day, count(*) AS n FROM news GROUP BY ALL")
def st_03(spark, sf):
    n = news_rows(spark, sf).select("event_id", "ts", "country", "day", F.col("ts").alias("ingested"), "value")
    path = fresh_path(spark, "late")
    overwrite(n.where("event_id % 4 = 0"), path, "day")
    late = n.where("event_id % 4 <> 0 or event_id % 8 = 0").select(n.columns)
    streaming.insert_events(landing(late, spark, "late_rows"), path, delay="1 day")
    return spark.read.schema(n.schema).parquet(path).groupBy("country", "day").agg(F.count("*").alias("n"))


@query(
    "st_04",
    f"SELECT country, day, n::DOUBLE AS value, round(avg(n) {ONLINE} + 1e-9::DOUBLE, 6) AS mean, "
    f"round(coalesce(CASE WHEN stddev_samp(n) {ONLINE} > 1e-12 THEN (n - avg(n) {ONLINE}) / stddev_samp(n) {ONLINE} END, 0), "
    f"4) + 0.0 AS z FROM op",
    ctes=OWN,
)
def st_04(spark, sf):
    rows = order_panel(spark, sf).select("country", "day", F.col("n").cast("double").alias("value"))
    path, out = fresh_path(spark, "series"), fresh_path(spark, "scores")
    panel = materialize(rows, "panel")
    # files are read as they landed: an earlier and a later part of all days, a country in one file of each, so that its days stay in order
    middle = panel.agg(F.expr("min(day) + cast(datediff(max(day), min(day)) / 2 as int)")).first()[0]
    for part in (F.col("day") <= F.lit(middle), F.col("day") > F.lit(middle)):
        panel.where(part).repartition(4, "country").write.mode("append").parquet(path)
    with streaming.keyed_state(spark, 8):
        stream = streaming.online_scores(streaming.landed(spark, path, rows.schema))
        streaming.drain(stream, lambda df, _: df.write.mode("append").parquet(out))
    back = spark.read.schema("country string, day date, value double, mean double, z double, score double").parquet(out)
    # off the ties of rounding, where the last bit of a mean would decide
    return back.select("country", "day", "value", r6(F.col("mean") + 1e-9).alias("mean"), (F.round("z", 4) + F.lit(0.0)).alias("z"))


def kept_latest(stream, spark, label, keys, schema):
    """Drains an update-mode aggregate and keeps the last row per key."""
    path = fresh_path(spark, label)
    streaming.drain(stream, lambda df, i: df.withColumn("_batch", F.lit(i)).write.mode("append").parquet(path), "update")
    rows = spark.read.schema(f"{schema}, _batch int").parquet(path)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_batch")


@query("st_05", "SELECT country, time_bucket(INTERVAL 12 HOURS, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS n FROM news GROUP BY ALL")
def st_05(spark, sf):
    n = news_rows(spark, sf).select("event_id", "country", "ts")
    return kept_latest(streaming.buckets(landing(n, spark, "bucket_rows"), delay=None), spark, "buckets", ["country", "start"], "country string, start timestamp, n long")


@query("st_06", "SELECT country, day, count(*) AS events, sum(fatalities)::BIGINT AS deaths FROM news GROUP BY ALL")
def st_06(spark, sf):
    n = news_rows(spark, sf).select("event_id", "country", "ts", "fatalities")
    return kept_latest(streaming.daily_totals(landing(n, spark, "total_rows"), delay=None), spark, "totals", ["country", "day"], "country string, day date, events long, deaths long")


ROLLS = [Roll("events_7", "events", "sum", 7, 1, fill=0), Roll("events_30", "events", "sum", 30, 0), Roll("deaths_7", "deaths", "avg", 7), Roll("deaths_top", "deaths", "max", 30, 1, fill=0)]


@query(
    "st_06_panel",
    "SELECT country, day, events, deaths, coalesce(sum(events) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS events_7, "
    "(sum(events) OVER (w ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))::BIGINT AS events_30, round(avg(deaths) OVER (w ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS deaths_7, "
    "coalesce(max(deaths) OVER (w ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS deaths_top "
    "FROM (SELECT country, day, coalesce(n, 0) AS events, coalesce(f, 0)::BIGINT AS deaths FROM (SELECT country FROM nat) "
    "CROSS JOIN (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM news) "
    "LEFT JOIN (SELECT country, day, count(*) AS n, sum(fatalities) AS f FROM news GROUP BY ALL) USING (country, day)) "
    "WINDOW w AS (PARTITION BY country ORDER BY day)",
)
def st_06_panel(spark, sf):
    """The panel after events have come in no order of days."""
    n = news_rows(spark, sf).select("event_id", "country", "fatalities", F.col("ts").alias("ingested"), "day")
    root = fresh_path(spark, "fed")
    streaming.feed_panel(landing(n, spark, "fed_rows"), root, nations(spark, sf), {"events": F.count("*"), "deaths": F.sum("fatalities").cast("long")}, ROLLS)
    rows = spark.read.parquet(f"{root}/panel")
    return rows.select("country", F.col("day").cast("date").alias("day"), "events", "deaths", "events_7", "events_30", r6("deaths_7").alias("deaths_7"), "deaths_top")


@query(
    "st_07",
    "SELECT channel, count(*) AS n, count(*) FILTER (is_conflict) AS conflict FROM ev WHERE sent_at >= TIMESTAMP '2024-01-02' "
    "GROUP BY channel",
    ctes=EV,
)
def st_07(spark, sf):
    m = messages(spark, sf)
    path = fresh_path(spark, "extracted")
    lexicon = {"lexicon": LEX, "gazetteer": PLACES, "types": KINDS, "negations": NEG, "casualty": HURT}
    none = text.extracted(m, **lexicon).withColumn("day", F.to_date("sent_at")).where(F.lit(False))
    overwrite(none, path, "day")  # there is a table even if no message is new enough
    schema = none.schema
    streaming.upsert_messages(landing(m, spark, "message_rows"), path, "2024-01-02", **lexicon)
    return spark.read.schema(schema).parquet(path).groupBy("channel").agg(F.count("*").alias("n"), F.count_if("is_conflict").alias("conflict"))
