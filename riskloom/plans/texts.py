"""Text extraction, audits, briefings, JSON."""

from pyspark.sql import functions as F

from riskloom.functions import r6
from riskloom.operators import briefing, text
from riskloom.operators.merge import upserted
from riskloom.plans.fixtures import articles, messages, news
from riskloom.plans.ranking import CONTEXT, SCO, context, scores
from riskloom.plans.registry import query
from riskloom.session import table

# Terms that the given texts hold, in place of the conflict lexicon.
LEX = {"the": 0.9, "and": 0.7, "der": 0.8, "que": 0.6, "las": 0.5, "this": 0.35}
HURT, NEG = ("and", "que"), (r"no\s+the", "that", "nicht")
KINDS = (("strike", ("the", "der")), ("clash", ("and", "que")))
PLACES = [("the", "AAA", 1.0, 2.0, False), ("was", "BBB", 3.0, 4.0, True), ("und", "CCC", 5.0, 6.0, True), ("les", "DDD", 7.0, 8.0, False), ("para", "EEE", None, None, False)]


def w(t):
    return f"regexp_matches(lower(text), '(^|[^a-z0-9_]){t}([^a-z0-9_]|$)')"


EV = (
    (
        "ev AS (SELECT *, CASE WHEN len(matched) > 0 AND severity >= 0.3 THEN true ELSE false END AS is_conflict "
        "FROM (SELECT *, round(greatest(0, least(1, ("
    )
    + "greatest(0.0, "
    + ", ".join(f"CASE WHEN list_contains(matched, '{t}') THEN {v} ELSE 0 END" for t, v in LEX.items())
    + (
        f")::DOUBLE + CASE WHEN list_has_any(matched, {list(HURT)}) THEN 0.08 ELSE 0 END) * CASE WHEN negated THEN 0.45::DOUBLE ELSE 1 "
        f"END)), 4) AS severity, round(greatest(0, least(1, 0.25::DOUBLE + CASE WHEN len(matched) > 0 THEN 0.35 ELSE 0 END + CASE WHEN "
        f"iso3 IS NOT NULL THEN 0.2 ELSE 0 END - CASE WHEN negated THEN 0.15 ELSE 0 END)), 4) AS confidence, "
    )
    + "CASE "
    + " ".join(f"WHEN list_has_any(matched, {list(t)}) THEN '{k}'" for k, t in KINDS)
    + (
        " ELSE 'conflict_signal' END AS event_type, CASE WHEN length(clean) <= 220 THEN clean ELSE rtrim(clean[1:219]) || '...' END AS "
        "summary, left(sha256(channel || '|' || message_id || '|' || strftime(sent_at, '%Y-%m-%d %H:%M:%S') || '|' || text), "
        "24) AS event_id FROM (SELECT *, list_filter(["
    )
    + ", ".join(f"CASE WHEN {w(t)} THEN '{t}' END" for t in LEX)
    + "], lambda x: x IS NOT NULL) AS matched, ("
    + " OR ".join(w(p) for p in NEG)
    + ") AS negated, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, CASE "
    + " ".join(f"WHEN {w(a)} THEN '{iso}'" for a, iso, *_ in sorted(PLACES, key=lambda p: (p[4], len(p[0]), p[1], p[0]), reverse=True))
    + " END AS iso3, CASE "
    + " ".join(f"WHEN {w(a)} THEN '{a}'" for a, *_ in sorted(PLACES, key=lambda p: (p[4], len(p[0]), p[1], p[0]), reverse=True))
    + " END AS location FROM msg)))"
)


def events(spark, sf):
    return text.extracted(messages(spark, sf), LEX, PLACES, KINDS, NEG, HURT)


def joined(c):
    return F.array_join(c, ",")


for _name, _sql, _cols in [
    ("txt_01", "array_to_string(matched, ',') AS matched", lambda: [joined("matched").alias("matched")]),
    ("txt_02", "negated", lambda: ["negated"]),
    ("txt_03", "severity", lambda: ["severity"]),
    ("txt_04", "confidence", lambda: ["confidence"]),
    ("txt_05", "is_conflict", lambda: ["is_conflict"]),
    ("txt_06", "event_type", lambda: ["event_type"]),
    ("txt_07", "iso3, location, CASE location WHEN 'was' THEN 'city' WHEN 'und' THEN 'city' ELSE CASE WHEN location IS NULL THEN 'missing' ELSE 'country' END END AS location_precision", lambda: [F.col("country_code").alias("iso3"), "location", "location_precision"]),
    ("txt_08", "summary", lambda: ["summary"]),
    ("txt_09", "event_id", lambda: ["event_id"]),
    ("txt_12", "array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN " + str(text.SMALL_WORDS) + ")[1:12], ' ') AS text_key", lambda: [text.text_key(F.col("text")).alias("text_key")]),
]:

    def _event_query(spark, sf, cols=_cols):
        return events(spark, sf).select("message_id", *cols())

    query(_name, f"SELECT message_id, {_sql} FROM ev", ctes=EV)(_event_query)


@query(
    "txt_10",
    "SELECT k, n FROM (SELECT channel || ':' || CASE WHEN message_id % 4 = 0 THEN left(sha256(text), "
    "24) ELSE message_id::VARCHAR END AS k, max(length(text)) AS n FROM msg GROUP BY ALL)",
)
def txt_10(spark, sf):
    m = messages(spark, sf).withColumn("mid", F.when(F.col("message_id") % 4 != 0, F.col("message_id").cast("string")).otherwise(F.lit(" ")))
    keyed = m.select(text.message_key(F.col("channel"), F.col("mid"), F.col("text")).alias("k"), F.length("text").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    return upserted(upserted(keyed.where("n < 0"), keyed, ["k"]), keyed, ["k"])


@query(
    "txt_11",
    "SELECT channel, count(*) AS n, count(*) FILTER (is_conflict) AS conflict, count(DISTINCT event_id) AS ids FROM ev GROUP BY channel",
    ctes=EV,
)
def txt_11(spark, sf):
    stored = events(spark, sf)
    again = text.extracted(stored.select("channel", "message_id", "sent_at", "text", "country"), LEX, PLACES, KINDS, NEG, HURT)
    return upserted(stored, again, ["event_id"]).groupBy("channel").agg(F.count("*").alias("n"), F.count_if("is_conflict").alias("conflict"), F.count_distinct("event_id").alias("ids"))


KEY12 = (
    "array_to_string(list_filter(regexp_extract_all(lower(summary), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN "
    + str(text.SMALL_WORDS)
    + ")[1:12], ' ')"
)


@query(
    "txt_13",
    f"SELECT * FROM (SELECT country, event_type, array_to_string(list_sort(matched)[1:3], ',') AS first_terms, "
    f"epoch(sent_at)::BIGINT // 43200 AS bucket, count(*) AS n, count(DISTINCT channel) AS channels, count(DISTINCT {KEY12}) AS texts "
    f"FROM ev GROUP BY ALL) WHERE n >= 2 AND (channels > 1 OR texts < n)",
    ctes=EV,
)
def txt_13(spark, sf):
    return text.duplicate_groups(events(spark, sf)).withColumn("first_terms", joined("first_terms"))


@query(
    "txt_14",
    "SELECT doc_id, unnest(list_filter(regexp_extract_all(lower(title), '[a-z]{4,}'), lambda t: t NOT IN ('that', 'with'))) AS token "
    "FROM art",
)
def txt_14(spark, sf):
    return articles(spark, sf).select("doc_id", F.explode(text.title_tokens("title", ("that", "with"))).alias("token"))


RULES = [("war", ["ther", "zung"]), ("politics", ["ing", "eaux"]), ("trade", ["ent", "ción"]), ("weather", ["on"]), ("other", ["e"])]


@query(
    "txt_15",
    "SELECT doc_id, array_to_string(list_filter(["
    + ", ".join("CASE WHEN " + " OR ".join(f"contains(lower(title), '{t}')" for t in terms) + f" THEN '{n}' END" for n, terms in RULES)
    + "], lambda x: x IS NOT NULL)[1:3], ',') AS labels FROM art",
)
def txt_15(spark, sf):
    return articles(spark, sf).select("doc_id", joined(text.theme_labels(F.col("title"), RULES)).alias("labels"))


#: Words that the given texts hold near numbers, in place of words of harm, and beginnings of theirs.
TOLD = {"dead": ("the", "der", "est"), "hurt": ("of", "que", "und", "les")}
BEGIN = (("first", ("tha", "ver")), ("second", ("ción", "eau")), ("third", ("call", "key-", "+")))


def _mentions_sql() -> str:
    """Sentences to tokens; for each number the distances to words of harm, the nearest, then the first of each mention."""
    label = "CASE " + " ".join(f"WHEN w IN {words} THEN '{name}'" for name, words in TOLD.items()) + " END"
    acts = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^a-z0-9_])({'|'.join(x.replace('+', chr(92) + '+') for x in starts)})') THEN '{name}' END" for name, starts in BEGIN)
    return (
        f"SELECT art.doc_id, coalesce(found, '') AS found, array_to_string(list_filter([{acts}], lambda x: x IS NOT NULL), ',') AS deeds FROM art LEFT JOIN "
        "(SELECT doc_id, string_agg(m, ',' ORDER BY first_at) AS found FROM (SELECT doc_id, label || ' ' || replace(num, ',', '') AS m, min({'s': s, 'i': i}) AS first_at FROM tok_near "
        "GROUP BY ALL) GROUP BY doc_id) USING (doc_id)"
    ), (
        "sen AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[.;!?\n]')) AS sentence, generate_subscripts(string_split_regex(lower(text), '[.;!?\n]'), 1) AS s FROM art), "
        "tok AS (SELECT doc_id, s, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM (SELECT doc_id, s, regexp_extract_all(sentence, '[0-9]+(?:,[0-9]{3})*|[a-z]+|,') AS t FROM sen)), "
        f"har AS (SELECT *, {label} AS label FROM tok WHERE {label} IS NOT NULL), "
        "tok_near AS (SELECT tok.doc_id, tok.s, tok.i, tok.w AS num, min_by(har.label, abs(har.i - tok.i) * 2 + (har.i < tok.i)::INT) AS label FROM tok JOIN har ON har.doc_id = tok.doc_id AND har.s = tok.s "
        "AND abs(har.i - tok.i) BETWEEN 1 AND 3 WHERE regexp_matches(tok.w, '^[0-9]') GROUP BY ALL)"
    )


@query("txt_16", _mentions_sql()[0], ctes=_mentions_sql()[1])
def txt_16(spark, sf):
    return articles(spark, sf).select("doc_id", joined(text.casualties(F.col("text"), TOLD)).alias("found"), joined(text.deeds(F.col("text"), BEGIN)).alias("deeds"))


@query(
    "txt_17",
    "SELECT country, country || ': ' || g7 || ' articles in 7 days, "
    "' || CASE WHEN g24 > 0 THEN g24 || ' today' ELSE 'none today' END AS line FROM ctx",
    ctes=CONTEXT,
)
def txt_17(spark, sf):
    today = F.when(F.col("g24") > 0, F.format_string("%d today", "g24")).otherwise(F.lit("none today"))
    return context(spark, sf).select("country", F.concat(F.format_string("%s: %d articles in 7 days, ", "country", "g7"), today).alias("line"))


@query(
    "txt_18",
    "SELECT page_id, replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', "
    "'<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', chr(160)), '&amp;', '&') AS title FROM pages",
)
def txt_18(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.unescaped(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"))


@query(
    "txt_19",
    "SELECT country, y AS year, part, sub, count(*) AS n "
    "FROM (SELECT *, floor((row_number() OVER (PARTITION BY country, y, part ORDER BY day, doc_id) - 1) / ceil(m / k))::BIGINT AS sub "
    "FROM (SELECT *, greatest(1, ceil(floor(least(sum(length(title)) OVER p / 3.5::DOUBLE, count(*) OVER p * 256)) / 500))::BIGINT AS k, "
    "count(*) OVER p AS m FROM (SELECT *, floor((row_number() OVER (PARTITION BY country, y ORDER BY day, "
    "doc_id) - 1) / ceil(n / ceil(n / 60)))::BIGINT AS part "
    "FROM (SELECT *, year(day) AS y, count(*) OVER (PARTITION BY country, year(day)) AS n "
    "FROM art)) WINDOW p AS (PARTITION BY country, y, part))) GROUP BY ALL",
)
def txt_19(spark, sf):
    df = text.packed(articles(spark, sf).withColumn("year", F.year("day")), 60, 500, order=("day", "doc_id"))
    return df.groupBy("country", "year", "part", "sub").agg(F.count("*").alias("n"))


# ---- audits ----

FLAGS = {"no_country": "iso3 IS NULL", "no_location": "location IS NULL", "no_coords": "location IS NULL OR location = 'para'", "country_only": "location IS NOT NULL AND location NOT IN ('was', 'und')", "low_confidence": "confidence < 0.75", "severe_unsure": "severity >= 0.75 AND confidence < 0.75", "negation_hint": "contains(lower(text), 'unconfirmed') OR contains(lower(text), 'peaceful')", "old": "sent_at < TIMESTAMP '2024-01-03'", "negated_any": "negated"}


@query(
    "agg_27",
    "SELECT channel, count(*) AS n, count(*) FILTER (is_conflict) AS conflict, "
    + ", ".join(f"count(*) FILTER (is_conflict AND ({c})) AS {k}" for k, c in FLAGS.items())
    + ", round(count(*) FILTER (is_conflict) / count(*), 4) AS rate FROM ev GROUP BY channel",
    ctes=EV,
)
def agg_27(spark, sf):
    return text.audit(events(spark, sf), "2024-01-03")


@query(
    "agg_28",
    "SELECT term, count(*) AS n FROM (SELECT unnest(matched) AS term FROM ev WHERE is_conflict) "
    "GROUP BY term ORDER BY n DESC, term LIMIT 15",
    ctes=EV,
)
def agg_28(spark, sf):
    return events(spark, sf).where("is_conflict").select(F.explode("matched").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(15)


CAUSES = (
    "SELECT country, what, string_agg(name || ' ' || n, ', ' ORDER BY n DESC, name) AS items "
    "FROM (SELECT country, 'keyword' AS what, name, count(*) AS n FROM (SELECT country, unnest(matched) AS name FROM ev) GROUP BY ALL "
    "UNION ALL SELECT country, 'event_type', event_type, count(*) FROM ev GROUP BY ALL) GROUP BY ALL"
)


@query("agg_32", CAUSES, ctes=EV)
def agg_32(spark, sf):
    return briefing.causes(events(spark, sf)).withColumn("items", F.array_join(F.transform("items", lambda v: F.concat_ws(" ", v["name"], v["n"].cast("string"))), ", "))


# ---- briefings ----


@query(
    "brf_01",
    "SELECT upper(trim(c)) AS country, count(*) AS n FROM (SELECT CASE WHEN message_id % 6 = 0 THEN '  ' WHEN message_id % 6 = 1 THEN ' ' "
    "|| lower(country) || ' ' ELSE country END AS c FROM msg) WHERE trim(c) <> '' GROUP BY ALL",
)
def brf_01(spark, sf):
    i = F.col("message_id") % 6
    raw = messages(spark, sf).withColumn("country", F.when(i == 0, F.lit("  ")).when(i == 1, F.concat(F.lit(" "), F.lower("country"), F.lit(" "))).otherwise(F.col("country")))
    return briefing.by_country(raw).groupBy("country").agg(F.count("*").alias("n"))


TOP = (
    "tp AS (SELECT country, event_id, severity, summary, row_number() OVER (PARTITION BY country ORDER BY coalesce(severity, 0) DESC, "
    "event_id) AS k FROM ev), bf AS (SELECT country, n_events, cautions, ids, first_summary, g24, g7 "
    "FROM (SELECT country, count(*) AS n_events, array_to_string(list_filter([CASE WHEN bool_or(confidence < 0.5) THEN 'few sources' END, "
    "CASE WHEN bool_or(negated) THEN 'reports are disputed' END], lambda x: x IS NOT NULL), ',') AS cautions FROM ev GROUP BY country) "
    "JOIN (SELECT country, string_agg(event_id, ',' ORDER BY k) AS ids, min(summary) FILTER (k = 1) AS first_summary FROM tp WHERE k <= 5 "
    "GROUP BY country) USING (country) LEFT JOIN ctx USING (country))"
)


def briefs(spark, sf):
    return briefing.evidence(events(spark, sf), context(spark, sf))


@query("brf_02", "SELECT country, n_events, cautions, ids, g24, g7 FROM bf", ctes=f"{EV}, {CONTEXT}, {TOP}")
def brf_02(spark, sf):
    ids = F.array_join(F.transform("events", lambda e: e.event_id), ",")
    return briefs(spark, sf).select("country", "n_events", joined("cautions").alias("cautions"), ids.alias("ids"), "g24", "g7")


@query(
    "brf_03",
    "SELECT country, CASE WHEN g24 % 2 = 1 THEN 'brief ' || g24 ELSE first_summary END AS summary FROM bf",
    ctes=f"{EV}, {CONTEXT}, {TOP}",
)
def brf_03(spark, sf):
    brief = F.when(F.col("g24") % 2 == 1, F.format_string("brief %d", "g24"))
    return briefs(spark, sf).select("country", briefing.first_of(brief, F.lit(" "), F.col("events")[0]["summary"]).alias("summary"))


@query(
    "brf_04",
    "SELECT CASE WHEN country = 'NATION_0' THEN 'missing' WHEN country = 'NATION_1' THEN 'duplicate' ELSE 'created' END AS status, "
    "count(*) AS n FROM bf GROUP BY ALL",
    ctes=f"{EV}, {CONTEXT}, {TOP}",
)
def brf_04(spark, sf):
    new = briefs(spark, sf).select(F.col("country").alias("score_id"), briefing.content_hash(F.col("country"), F.col("n_events")).alias("hash"), "n_events")
    out = briefing.insertable(new, new.where("score_id = 'NATION_1'"), new.where("score_id <> 'NATION_0'").select("score_id"))
    return out.groupBy("status").agg(F.count("*").alias("n"))


@query(
    "brf_06",
    "SELECT country, count(*)::INT AS days, round(max(prob), 6) AS top, arg_min(round(prob, 6), day) AS first FROM sco "
    "WHERE run_ts = 2 AND day > (SELECT max(day) FROM sco) - 45 GROUP BY country",
    ctes=SCO,
)
def brf_06(spark, sf):
    h = briefing.histories(scores(spark, sf).where("run_ts = 2"))
    return h.select("country", F.size("history").alias("days"), r6(F.array_max(F.transform("history", lambda x: x.prob))).alias("top"), r6(F.col("history")[0]["prob"]).alias("first"))


# ---- JSON ----


@query("jsn_01", "SELECT event_id, mentions * 2 AS k2, 'y' || mentions AS label FROM news")
def jsn_01(spark, sf):
    raw = table(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    out = raw.select("event_id", F.to_json(F.struct((F.col("p.k") * 2).alias("k2"), F.concat(F.lit("y"), F.col("p.k").cast("string")).alias("label"))).alias("j"))
    return out.select("event_id", F.from_json("j", "k2 long, label string").alias("x")).select("event_id", "x.k2", "x.label")


@query("jsn_02", "SELECT event_id, sha256(event_id || '|' || country || '|' || root || '|' || mentions) AS hash FROM news")
def jsn_02(spark, sf):
    return news(spark, sf).select("event_id", briefing.content_hash(F.col("event_id"), F.col("country"), F.col("root"), F.col("mentions")).alias("hash"))


@query(
    "jsn_03",
    "SELECT event_id, coalesce(CASE WHEN klass = 1 THEN 5 END, CASE WHEN event_id % 2 = 0 THEN mentions END, 0)::BIGINT AS level FROM news",
)
def jsn_03(spark, sf):
    n = news(spark, sf).withColumn("j", F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct("mentions"))))
    return n.select("event_id", F.coalesce(F.when(F.col("klass") == 1, F.lit(5)), F.get_json_object("j", "$.mentions").cast("long"), F.lit(0)).cast("long").alias("level"))
