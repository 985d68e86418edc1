r"""Operator 6, benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased.  A test window is 10 consecutive words of
an item, or a shorter item as a whole.  Every training window is hashed inside its row and leaves it as (document, place, hash), so that a row's
width does not follow the text's length; the hashes of test windows, 8 bytes each, are broadcast while there are at most
MOST_BROADCAST (about 100 MB in a task's memory), beyond that the slim rows are shuffled by hash.  Of documents with a hit the words
at the hit places are then compared with the test windows' words; verified windows mark their words as hit.

Defined results: null and empty texts have no words and no hits; items without words are no items; the windows of an item with a null id
count as hits, but it is not in the list of items; repeated rows each get a result; documents that share an id, or have none, are told
apart by their text; other columns are kept whatever their names; an empty benchmark leaves all documents clean, an
empty table of documents gives an empty result; items with equal windows (ties) are all listed; in a very long text the work grows with its words.  Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, identity, only, renewed, same, with_row
from riskloom.session import materialize, table

WINDOW = 10
MOST_BROADCAST = 4_000_000
#: Words of test windows are broadcast up to this many bytes.
MOST_BYTES = 64 << 20
# What stands between words, after and before A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def each_window(size: int, made: str) -> str:
    """SQL of an array over all windows of ``size`` words of the array ``w``; ``made`` is made of each, of its first place ``i``."""
    return f"transform(if(size(w) >= {size}, sequence(0, size(w) - {size}), cast(array() as array<int>)), i -> {made})"


def hashed(size: int, array: str = "w", at: str = "i") -> str:
    return "xxhash64(" + ", ".join(f"{array}[{at} + {j}]" for j in range(size)) + ")"


def spelt(size: int, array: str = "w", at: str = "i") -> str:
    return "concat_ws(' ', " + ", ".join(f"{array}[{at} + {j}]" for j in range(size)) + ")"


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """n, h, g (the words, joined) and items (ids that hold them, without null), one row per distinct window."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("w")).where("size(w) > 0")
    short = " ".join(f"when size(w) = {k} then {each_window(k, f'struct({k} as n, {hashed(k)} as h, {spelt(k)} as g)')}" for k in range(1, window))
    whole = each_window(window, f"struct({window} as n, {hashed(window)} as h, {spelt(window)} as g)")
    every = items.select("item_id", F.explode(F.expr(f"case {short} else {whole} end" if window > 1 else whole)).alias("x")).select("item_id", "x.*")
    return every.groupBy("n", "h", "g").agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """_id, _a, _b (the document), places (sorted windows found: at, n) and items; only documents with a hit; written once."""
    tests = materialize(test_windows(benchmark, window), "windows")
    sizes = sorted(r[0] for r in tests.select("n").distinct().collect()) or [window]  # 10 values at most
    count, size = tests.agg(F.count_distinct("h"), F.coalesce(F.sum(F.octet_length("g") + 8 * F.size("items") + 64), F.lit(0))).first()
    split = docs.select(*identity(), normal_words(F.col("text")).alias("w"))
    # one list of plain hashes per row: the windows of the smallest size, then those of the next
    lists = [F.expr(each_window(k, hashed(k))) for k in sizes]
    slim = split.select("_id", "_a", "_b", F.size("w").alias("len"), F.posexplode(F.concat(*lists)).alias("pos", "h"))
    keys = tests.select("h").distinct()
    seen = slim.join(F.broadcast(keys) if count <= MOST_BROADCAST else keys, "h", "left_semi")
    before, at, n = F.lit(0), F.col("pos"), F.lit(sizes[0])
    for k, following in zip(sizes, sizes[1:], strict=False):
        before = before + F.greatest(F.col("len") - (k - 1), F.lit(0))
        at, n = F.when(F.col("pos") >= before, F.col("pos") - before).otherwise(at), F.when(F.col("pos") >= before, F.lit(following)).otherwise(n)
    asked = materialize(seen.select("_id", "_a", "_b", F.struct(at.alias("at"), n.alias("n")).alias("p")).groupBy("_id", "_a", "_b").agg(F.collect_set("p").alias("ps")), "asked")
    # the words at those places, of the few documents that have any
    kept, asked = only(docs.select(*identity(), "text"), asked), renewed(asked)
    again = kept.join(asked, same(kept, asked)).select(asked["_id"], asked["_a"], asked["_b"], "ps", normal_words(F.col("text")).alias("w"))
    words = " ".join(f"when {k} then {spelt(k, 'w', 'p.at')}" for k in sizes)
    found = again.select("_id", "_a", "_b", F.explode(F.expr(f"transform(ps, p -> struct(p.at as at, p.n as n, case p.n {words} end as g))")).alias("x")).select("_id", "_a", "_b", "x.*")
    known = tests.select("n", "g", "items")
    proved = found.join(F.broadcast(known) if size <= MOST_BYTES else known, ["n", "g"])
    per_doc = proved.groupBy("_id", "_a", "_b").agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("places"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return materialize(per_doc, "hits")


COVERED = "aggregate(places, named_struct('e', 0, 'n', 0L), (a, p) -> named_struct('e', greatest(a.e, p.at + p.n), 'n', a.n + greatest(0, p.at + p.n - greatest(p.at, a.e))), a -> a.n)"


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (sorted as strings) and contaminated."""
    n_words = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), BETWEEN_ANY_CASE), "")).cast("long")
    slim = docs.select(*identity(), n_words.alias("n_words"))
    found = hits(docs, benchmark, window)
    found = found.select("_id", "_a", "_b", F.expr(COVERED).alias("hit"), "items")
    joined = slim.join(found, same(slim, found), "left")
    items = F.coalesce(F.array_sort(F.transform("items", lambda x: x.cast("string"))), F.array().cast("array<string>"))
    out = joined.select(slim["_id"].alias("doc_id"), "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), items.alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without those that hold a test window."""
    rows, found = with_row(docs), hits(docs, benchmark, window).select("_id", "_a", "_b")
    return rows.join(found, same(rows, found), "left_anti").select("row.*")


def clean_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with hit words cut out of their texts; what stands between words stays."""
    rows, found = with_row(docs), hits(docs, benchmark, window)
    marked = rows.join(found, same(rows, found), "left").select("row", "places")
    # places of words that stay; what stands before word i has the order 2 i, the word itself 2 i + 1
    stay = "array_except(if(size(w) > 0, sequence(0, size(w) - 1), cast(array() as array<int>)), flatten(transform(places, p -> sequence(p.at, p.at + p.n - 1))))"
    parts = marked.withColumns({"w": F.regexp_extract_all("row.text", F.lit(WORD_ANY_CASE), F.lit(0)), "g": F.split("row.text", WORD_ANY_CASE)}).withColumn("stay", F.expr(stay))
    pieces = "concat(transform(g, (x, i) -> struct(2 * i as k, x as s)), transform(stay, i -> struct(2 * i + 1 as k, w[i] as s)))"
    cut = F.expr(f"array_join(transform(array_sort({pieces}), x -> x.s), '')")
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(cut)
    return parts.select(F.col("row").withField("text", text).alias("row")).select("row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLE = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS MATERIALIZED (SELECT r, i, bw.n, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

QUERIES = {"op6_decontaminate": op6_decontaminate}
ORACLE_SQL = {"op6_decontaminate": ORACLE}
