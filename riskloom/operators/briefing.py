"""Briefing records: evidence, causes, cautions, hashes, and insertion of what is new."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize


def by_country(events: DataFrame, col: str = "country") -> DataFrame:
    """Upper-cased, trimmed country; blank ones go."""
    return events.withColumn(col, F.upper(F.trim(col))).where(F.coalesce(F.col(col), F.lit("")) != "")


def causes(events: DataFrame, terms: str = "matched", kind: str = "event_type", key: str = "country") -> DataFrame:
    """Per country: lists of (count, term) and (count, type), largest count first, then by name."""
    words = events.select(key, F.explode(terms).alias("name"), F.lit("keyword").alias("what"))
    kinds = events.where(F.col(kind).isNotNull()).select(key, F.col(kind).alias("name"), F.lit("event_type").alias("what"))
    per = words.unionByName(kinds).groupBy(key, "what", "name").agg(F.count("*").alias("n"))
    return per.groupBy(key, "what").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "name", "n"))).alias("x")).select(key, "what", F.transform("x", lambda v: F.struct(v["name"].alias("name"), v["n"].alias("n"))).alias("items"))


def evidence(events: DataFrame, context: DataFrame, most: int = 5, key: str = "country") -> DataFrame:
    """Per country: its most severe events as nested rows, counts, news context, and cautions once per text.  Events are evaluated once."""
    from riskloom.operators.ranks import first_rows

    events = materialize(events.select(key, "event_id", "summary", "severity", "confidence", "negated"), "events")
    top = first_rows(events, [key], [F.coalesce("severity", F.lit(0.0)).desc(), F.col("event_id")], most)
    rows = top.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce("severity", F.lit(0.0))).alias("order"), "event_id", "summary", "severity", "confidence"))).alias("events"))
    said = {"few sources": F.bool_or(F.col("confidence") < 0.5), "reports are disputed": F.bool_or("negated")}
    notes = F.array_compact(F.array(*[F.when(some, F.lit(note)) for note, some in said.items()]))
    caution = events.groupBy(key).agg(F.count("*").alias("n_events"), notes.alias("cautions"))
    return rows.join(caution, key).join(context, key, "left")


def first_of(*options: Column) -> Column:
    """The first option that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(o) != "", o) for o in options])


def content_hash(*parts: Column) -> Column:
    """SHA-256 over parts in fixed order, null as blank."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def insertable(new: DataFrame, stored: DataFrame, scores: DataFrame, keys: Sequence[str] = ("score_id", "hash")) -> DataFrame:
    """New records with status: missing (no score), no_evidence, duplicate (stored already), created."""
    known = scores.select(keys[0], F.lit(True).alias("_score"))
    there = stored.select(*keys).distinct().withColumn("_there", F.lit(True))
    j = new.join(known, keys[0], "left").join(there, list(keys), "left")
    status = F.when(F.col("_score").isNull(), "missing").when(F.col("n_events") == 0, "no_evidence").when(F.col("_there").isNotNull(), "duplicate").otherwise("created")
    return j.withColumn("status", status).drop("_score", "_there")


def histories(scores: DataFrame, days: int = 45, key: str = "country", day: str = "day", value: str = "prob") -> DataFrame:
    """Per country the scores of the table's last days, oldest first."""
    last = scores.agg(F.max(day).alias("_last"))
    recent = scores.join(F.broadcast(last)).where(F.col(day) > F.date_sub("_last", days))
    return recent.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(day, value))).alias("history"))
