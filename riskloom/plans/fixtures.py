"""The given tables seen as news events, conflict events, markets, articles and embeddings.

``SQL`` says the same for the SQL equivalents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import table

FIRST_DAY = "2024-01-01"


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """One row per country: at most some hundreds, so joins broadcast it."""
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("world"))


def _named(df: DataFrame, spark: SparkSession, sf: str, key: Column) -> DataFrame:
    return df.withColumn("k", key).join(F.broadcast(nations(spark, sf).drop("world")), "k").drop("k")


def news(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.to_date("ts").alias("day"),
        F.when(kind == "view", 1).when(kind == "signup", 2).when(kind == "click", 3).otherwise(4).alias("klass"),
        kind.alias("root"), (F.col("value") / 50 - 5).alias("intensity"), (F.col("value") / 5 - 50).alias("tone"),
        F.get_json_object("props", "$.k").cast("long").alias("mentions"),
        (F.col("user_id") % 7).alias("area"), (F.col("user_id") % 8).alias("actor1"), (F.col("event_id") % 8).alias("actor2"),
        F.when(kind.isin("error", "purchase"), F.floor(F.col("value") / 50).cast("int")).otherwise(0).alias("fatalities"), "value",
    )
    return _named(rows, spark, sf, F.col("user_id") % 25).drop("user_id")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """order_id, country, day, amount, priority, status, area."""
    who = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nk"))
    rows = table(spark, sf, "orders").join(who, "o_custkey")
    return _named(rows, spark, sf, F.col("nk")).select(
        F.col("o_orderkey").alias("order_id"), "country", F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 7).alias("area"),
    )


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, country, day, title, url, domain, language, tone, themes, persons, text."""
    text = F.col("text")
    rows = table(spark, sf, "documents").select(
        "doc_id", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor(F.col("doc_id") / 5) % 20).cast("int")).alias("day"),
        F.regexp_extract(text, r"^[^\n.]*", 0).alias("title"), F.concat(F.lit("https://"), "source", F.lit(".example.com/"), (F.col("doc_id") % 40).cast("string")).alias("url"),
        F.col("source").alias("domain"), F.col("lang").alias("language"), ((F.col("n_chars") % 2001 - 1000) / 10.0).alias("tone"),
        F.array_join(F.regexp_extract_all(text, F.lit("[A-Z]?[a-z]{3,}"), F.lit(0)), ";").alias("themes"),
        F.array_join(F.regexp_extract_all(text, F.lit("[a-z]+, ?[a-z]+"), F.lit(0)), ";").alias("persons"), "text", "n_chars",
    )
    return _named(rows, spark, sf, F.col("doc_id") % 5)


def titles(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, country, day, label, vec (array of double)."""
    rows = table(spark, sf, "embeddings").select(
        "vec_id", F.date_add(F.lit(FIRST_DAY).cast("date"), (2 * (F.floor(F.col("vec_id") / 5) % 20)).cast("int")).alias("day"), "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    return _named(rows, spark, sf, F.col("vec_id") % 5)


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """channel, message_id, sent_at, text, country."""
    rows = table(spark, sf, "conversations").select(
        F.col("role").alias("channel"), (F.col("conv_id") * 100 + F.col("turn")).alias("message_id"), "text",
        F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).alias("sent_at"), (F.col("conv_id") % 5).alias("nk"),
    )
    return _named(rows, spark, sf, F.col("nk")).drop("nk")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id, country, day, y (0 or 1), p and q (two models' probabilities)."""
    rows = articles(spark, sf).select("doc_id", "country", "day", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    logistic = lambda x: 1 / (1 + F.exp(-x))
    return rows.select(
        "doc_id", "country", "day", F.col("toxic").cast("int").alias("y"),
        logistic((F.col("n_chars") - 1500) / 1000.0).alias("p"), logistic((F.col("n_chars") % 977 - 400) / 300.0).alias("q"),
    )


SQL = r"""WITH nat AS (SELECT n_nationkey AS k, n_name AS country, n_regionkey AS world FROM nation),
news AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 3 ELSE 4 END AS klass,
  event_type AS root, value / 50 - 5 AS intensity, value / 5 - 50 AS tone, CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS mentions,
  user_id % 7 AS area, user_id % 8 AS actor1, event_id % 8 AS actor2, CASE WHEN event_type IN ('error', 'purchase') THEN CAST(floor(value / 50) AS INT) ELSE 0 END AS fatalities,
  value, country FROM events JOIN nat ON nat.k = user_id % 25),
ord AS (SELECT o_orderkey AS order_id, country, CAST(o_orderdate AS DATE) AS day, o_totalprice AS amount, o_orderpriority AS priority, o_orderstatus AS status, o_custkey % 7 AS area
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN nat ON nat.k = c_nationkey),
art AS (SELECT doc_id, DATE '2024-01-01' + CAST((doc_id // 5) % 20 AS INT) AS day, regexp_extract(text, '^[^\n.]*') AS title, 'https://' || source || '.example.com/' || (doc_id % 40) AS url,
  source AS domain, lang AS language, (n_chars % 2001 - 1000) / 10.0::DOUBLE AS tone, array_to_string(regexp_extract_all(text, '[A-Z]?[a-z]{3,}'), ';') AS themes,
  array_to_string(regexp_extract_all(text, '[a-z]+, ?[a-z]+'), ';') AS persons, text, n_chars, country FROM documents JOIN nat ON nat.k = doc_id % 5),
tit AS (SELECT vec_id, DATE '2024-01-01' + CAST(2 * ((vec_id // 5) % 20) AS INT) AS day, label, embedding::DOUBLE[] AS vec, country FROM embeddings JOIN nat ON nat.k = vec_id % 5),
msg AS (SELECT role AS channel, conv_id * 100 + turn AS message_id, text, make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS sent_at, country FROM conversations JOIN nat ON nat.k = conv_id % 5),
pred AS (SELECT doc_id, country, day, toxic AS y, 1 / (1 + exp(-((n_chars - 1500) / 1000.0::DOUBLE))) AS p, 1 / (1 + exp(-((n_chars % 977 - 400) / 300.0::DOUBLE))) AS q FROM art JOIN labels USING (doc_id))"""
