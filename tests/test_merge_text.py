"""Merges, incremental windows, and the sample messages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskloom.functions import epoch14
from riskloom.operators import briefing, daily, evaluate, joins, merge, text
from riskloom.session import fresh_path


def rows(spark, *data):
    return spark.createDataFrame([(i, dt.date(2024, 1, d), v) for i, d, v in data], "id long, day date, v string")


def read(spark, path, like):
    return sorted(tuple(r) for r in spark.read.schema(like.schema).parquet(path).select("id", "day", "v").collect())


def test_merges_twice_change_nothing(spark):
    like = rows(spark, (1, 1, "a"))
    path = fresh_path(spark, "m")
    merge.merge_into(spark, path, rows(spark, (1, 1, "a"), (2, 2, "b")), ["id", "day"], "day", False)
    for _ in range(2):
        merge.merge_into(spark, path, rows(spark, (2, 2, "B"), (3, 2, "c")), ["id", "day"], "day", False)
    assert [r[2] for r in read(spark, path, like)] == ["a", "b", "c"]
    for _ in range(2):
        assert merge.merge_into(spark, path, rows(spark, (2, 2, "B")), ["id", "day"], "day", True) == 1
    assert [r[2] for r in read(spark, path, like)] == ["a", "B", "c"]


@pytest.mark.parametrize("update", [False, True])
def test_a_key_that_repeats_in_a_batch_is_an_error_without_an_order(spark, update):
    path = fresh_path(spark, "m")
    merge.merge_into(spark, path, rows(spark, (1, 1, "a")), ["id", "day"], "day", update)
    twice = rows(spark, (2, 1, "b"), (2, 1, "c"))
    with pytest.raises(Exception, match="several rows"):
        merge.merge_into(spark, path, twice, ["id", "day"], "day", update)
    assert [r[2] for r in read(spark, path, twice)] == ["a"]
    merge.merge_into(spark, path, twice, ["id", "day"], "day", True, order="v")
    assert [r[2] for r in read(spark, path, twice)] == ["a", "c"]


def test_totals_keep_groups_without_country_or_tone(spark):
    data = [("A", 1, 1.0), ("A", 1, 3.0), (None, 1, 2.0), ("B", 1, None)]
    a = spark.createDataFrame([(c, dt.date(2024, 1, d), t, "x", "en", "WAR;A") for c, d, t in data], "country string, day date, tone double, domain string, language string, themes string")
    got = {r.country: (r.n, r.tone_p10, r.war) for r in daily.article_totals(a, {"war": "WAR"}).collect()}
    assert got == {"A": (2, 1.2, 2), None: (1, 2.0, 1), "B": (1, None, 1)}


def test_cautions_once_per_text(spark):
    data = [("A", 1, 0.9, 0.2, False), ("A", 2, 0.1, 0.3, True), ("B", 3, None, None, None), ("C", 4, 0.5, 0.9, True)]
    ev = spark.createDataFrame(data, "country string, event_id long, severity double, confidence double, negated boolean").withColumn("summary", F.lit("s"))
    got = {r.country: (r.n_events, r.cautions) for r in briefing.evidence(ev, ev.select("country").distinct()).collect()}
    assert got == {"A": (2, ["few sources", "reports are disputed"]), "B": (1, []), "C": (1, ["reports are disputed"])}


def test_windows_and_errors(spark):
    today = dt.date(2024, 3, 10)
    assert merge.date_window(dt.date(2024, 3, 1), 3, today) == (dt.date(2024, 2, 27), dt.date(2024, 3, 9))
    with pytest.raises(ValueError):
        merge.date_window(None, 3, today)
    with pytest.raises(ValueError):
        merge.date_window(dt.date(2024, 3, 20), 3, today)
    at = dt.datetime(2026, 7, 2, 12, 30)
    assert merge.time_window(at, dt.datetime(2026, 7, 2, 13))[0] == dt.datetime(2026, 7, 2, 12)
    assert merge.time_window(None, at)[0] == dt.datetime(2026, 7, 2, 10, 30)
    got = spark.createDataFrame([(dt.datetime(2026, 7, 2, 12, 45),)], "t timestamp").select(epoch14("t")).first()[0]
    assert got == 20260702124500
    with pytest.raises(ValueError):
        merge.guarded_append(rows(spark, (1, 5, "a")), rows(spark, (2, 5, "b")), "day")


def test_staging_checks(spark):
    good, bad = rows(spark, (1, 1, "a"), (2, 1, "b")), rows(spark, (1, 1, "a"), (1, 1, "b"))
    assert merge.checked(good, ["id", "day"]).count() == 2
    assert merge.staging_report(good.where("id > 9"), ["id"]).first().passed
    with pytest.raises(ValueError):
        merge.checked(bad, ["id", "day"])
    r = merge.load_report(good, "day", "id", "2024-03-01").first()
    assert not r.passed and r.issues == "stale"


def test_join_guards(spark):
    a, b = rows(spark, (1, 1, "a")), rows(spark, (1, 1, "x"), (1, 1, "y"))
    with pytest.raises(ValueError):
        joins.row_preserving(a, b.select("id", "v"), ["id"])
    with pytest.raises(ValueError):
        joins.lossless(a.select("id", "v"), rows(spark, (2, 1, "z")).select("id"), ["id"])


SAMPLES = [
    ("c1", 1, "Heavy shelling reported near Kharkiv, several killed", "u"),
    ("c2", 2, "Unconfirmed airstrike in Gaza City", None),
    ("c3", 3, "A peaceful protest was held in Nairobi", None),
]
PLACES = [("ukraine", "UKR", 49.0, 32.0, False), ("kharkiv", "UKR", 49.99, 36.23, True), ("gaza city", "PSE", 31.5, 34.46, True), ("nairobi", "KEN", -1.29, 36.82, True), ("kenya", "KEN", 0.0, 37.9, False)]


def test_sample_messages(spark):
    df = spark.createDataFrame(SAMPLES, "channel string, message_id long, text string, url string").withColumn("sent_at", __import__("pyspark").sql.functions.lit("2024-01-01").cast("timestamp"))
    a, b, c = text.extracted(df, gazetteer=PLACES).orderBy("message_id").collect()
    assert a.matched == ["shelling", "killed"] and a.severity == 0.98 and a.is_conflict and a.location_precision == "city" and a.country_code == "UKR" and a.confidence == 0.9
    assert b.negated and b.severity == round(0.95 * 0.45, 4) and b.event_type == "strike" and b.location == "gaza city"
    assert c.negated and not c.is_conflict and c.event_type == "civil_unrest"
    assert len(a.event_id) == 24 and len({a.event_id, b.event_id, c.event_id}) == 3


def test_summary_length_and_entities(spark):
    F = __import__("pyspark").sql.functions
    df = spark.createDataFrame([("x" * 300,), ("a  b\n c",), ("&lt;b&gt; &amp;amp;",)], "t string")
    got = [r[0] for r in df.select(text.summary(F.col("t"))).collect()]
    assert len(got[0]) == 222 and got[1] == "a b c"
    assert df.select(text.unescaped(F.col("t"))).collect()[2][0] == "<b> &amp;"


def test_hash_depends_on_content(spark):
    F = __import__("pyspark").sql.functions
    h = lambda *p: spark.range(1).select(briefing.content_hash(*[F.lit(x) for x in p])).first()[0]
    assert h("a", None) == h("a", None) != h("b", None)


def test_average_precision_groups_ties(spark):
    df = spark.createDataFrame([(0.9, 1), (0.5, 0), (0.5, 1), (0.1, 0)], "p double, y int")
    assert evaluate.average_precision(df, "p", "y").first().ap == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert evaluate.roc_auc(df, "p", "y").first().auc == pytest.approx(0.875)
    assert evaluate.roc_auc(df.where("y = 1"), "p", "y").first().auc is None


@pytest.mark.parametrize("update", [False, True])
def test_merges_keep_null_partitions_and_null_keys(spark, update):
    kind = "id long, day date, v string"
    day = dt.date(2024, 1, 1)
    path = fresh_path(spark, "m")
    merge.merge_into(spark, path, spark.createDataFrame([(1, None, "a"), (2, day, "b"), (None, day, "x")], kind), ["id", "day"], "day", update)
    merge.merge_into(spark, path, spark.createDataFrame([(3, None, "c"), (None, day, "y"), (None, day, "y")], kind), ["id", "day"], "day", update)
    like = spark.createDataFrame([], kind)
    got = [tuple(r) for r in spark.read.schema(like.schema).parquet(path).select("id", "day", "v").collect()]
    assert sorted(got, key=str) == sorted([(1, None, "a"), (2, day, "b"), (3, None, "c"), (None, day, "x"), (None, day, "y"), (None, day, "y")], key=str)
    merge.append_unseen(spark, path, spark.createDataFrame([(2, day, "B"), (4, day, "d"), (5, None, "e")], kind), ["id"], "day")
    got = {(r.id, r.v) for r in spark.read.schema(like.schema).parquet(path).collect()}
    assert got == {(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (None, "x"), (None, "y")}


def test_a_batch_is_evaluated_once(spark, tmp_path):
    kind = "id long, day date, v string"
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    path = fresh_path(spark, "m")
    new = spark.createDataFrame([(k, dt.date(2024, 1, 1 + k % 3), "a") for k in range(30)], kind).mapInPandas(counted, kind)
    merge.merge_into(spark, path, new, ["id", "day"], "day", True)
    merge.merge_into(spark, path, new, ["id", "day"], "day", True)
    assert seen.value == 60


def test_a_merge_of_many_days_writes_about_a_file_a_day(spark, tmp_path):
    path = str(tmp_path / "days")
    new = spark.range(4000, numPartitions=8).select("id", F.expr("cast(date'2024-01-01' + cast(id % 50 as int) as date)").alias("day"), F.lit("x").alias("v"))
    for _ in range(2):
        merge.merge_into(spark, path, new, ["id", "day"], "day", True)
        assert spark.read.parquet(path).count() == 4000
        assert 50 <= len(list((tmp_path / "days").glob("day=*/*.parquet"))) <= 60


@pytest.mark.parametrize("update", [False, True])
def test_a_batch_may_touch_any_number_of_partitions(spark, tmp_path, update, monkeypatch):
    monkeypatch.setattr(merge, "MOST_PARTITIONS", 3, raising=False)
    monkeypatch.setattr(merge.touched, "__defaults__", (3,))
    path, kind = str(tmp_path / "t"), "id long, day date, v string"
    rows = [(i, None if i == 0 else dt.date(2024, 1, i), "a") for i in range(9)]
    assert merge.merge_into(spark, path, spark.createDataFrame(rows, kind), ["id", "day"], "day", update) == 9
    assert merge.merge_into(spark, path, spark.createDataFrame([(i, d, "b") for i, d, _ in rows[1:]], kind), ["id", "day"], "day", update) == 8
    merge.append_unseen(spark, path, spark.createDataFrame([*rows[1:], (20, rows[5][1], "c")], kind), ["id", "day"], "day")
    got = sorted((r.id, r.v) for r in spark.read.schema(kind).parquet(path).collect())
    assert got == [(0, "a")] + [(i, "b" if update else "a") for i in range(1, 9)] + [(20, "c")]


def test_evidence_evaluates_events_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(i):
        seen.add(1)
        return f"s{i}"

    events = spark.range(20).select(F.lit("A").alias("country"), F.col("id").alias("event_id"), told("id").alias("summary"), F.lit(0.5).alias("severity"), F.lit(0.4).alias("confidence"), F.lit(False).alias("negated"))
    out = briefing.evidence(events, spark.createDataFrame([("A", 1)], "country string, g7 int")).collect()
    assert [(r.n_events, len(r.events), r.cautions) for r in out] == [(20, 5, ["few sources"])]
    assert seen.value == 20


def test_word_boundaries_stand_beside_a_term_and_take_no_character(spark):
    """The same texts as by characters on both sides, but no search for a character before each place."""
    texts = ["que", "que que", "a que", "aque", "quea", "_que", "que_", "é que", "éque", "que\n", "que\r\nx", "9que", "xque que", "", "queque", "\U0001f600que\U0001f600", "que,"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.a, r.b, r.c) for r in df.select(F.col("t").rlike(text.whole("que")).alias("a"), F.col("t").rlike("(^|[^a-z0-9_])que([^a-z0-9_]|$)").alias("b"), F.size(text.matched(F.col("t"), ["que"])).alias("c")).collect()]
    assert all(a == b == bool(c) for a, b, c in got) and 5 < sum(a for a, _, _ in got) < len(texts)
    assert not text.whole("que").startswith("(^|")


def test_only_sentences_with_digits_become_tokens(spark):
    """A split of them alone, and no token where there is no number."""
    df = spark.createDataFrame([("No one was hurt. 3 dead, 1,200 hurt! Killed 7\nnone dead;two dead. ٣ dead",), (None,), ("",)], "t string").select(text.casualties(F.col("t")).alias("c"))
    assert [r.c for r in df.collect()] == [["dead 3", "hurt 1200", "dead 7"], None, []]
    assert "filter(split(" in df._jdf.queryExecution().optimizedPlan().toString()
