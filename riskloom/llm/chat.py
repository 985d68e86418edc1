"""Operator 9, chat formatting: cumulative-snapshot collapse.

Loggers write a conversation again after every turn, so that most logged conversations are prefixes of longer ones.  A turn's
hash covers its place, role and text; the hashes of turns 1 to k, combined by exclusive or under two seeds, identify the
prefix of k turns.  Conversations whose whole is a proper prefix of another go (anti-join on k and both hashes), equal ones keep
the smallest conv_id, and the rest are rendered.

A conversation's turns are numbered within stretches of STRETCH turn numbers and then across them, so that the turns of one very
long conversation are sorted in several tasks; only the rendering, whose result is one row, brings them together.

Defined results: repeated rows (same conversation, turn, role and text) count once; rows that share a turn number stand in order
of role, then text; a null text is empty, a null role is ``unknown``, a null turn stands first; rows without conv_id are no
conversation; other columns, whatever their names, are ignored; very long texts are hashed and rendered whole; of equal conversations (ties) the
smallest conv_id stays; an empty table gives an empty result.  Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.session import materialize, table

STRETCH = 4096
# Turn markers, and what a marker inside a text becomes.
OPEN, CLOSE, MARK, SAFE = "<|im_start|>", "<|im_end|>", "<|", "< |"


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, k (place from 1), a and b (hashes of the prefix that ends here)."""
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.coalesce("turn", F.lit(-(1 << 62))).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.distinct().withColumn("s", F.floor(F.col("turn") / STRETCH))
    own = Window.partitionBy("conv_id", "s").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    local = materialize(rows.withColumn("i", F.row_number().over(own)).drop("turn"), "turns")
    start = local.groupBy("conv_id", "s").agg(F.max("i").alias("n")).select("conv_id", "s", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n"))
    placed = local.join(start, ["conv_id", "s"]).withColumn("k", (F.col("i") + F.col("n")).cast("long"))
    term = placed.withColumns({"ta": F.xxhash64("k", "role", "text"), "tb": F.xxhash64("text", "role", "k", F.lit(7))})
    carry = term.groupBy("conv_id", "s").agg(F.bit_xor("ta").alias("xa"), F.bit_xor("tb").alias("xb"))
    zero = F.lit(0).cast("long")
    carry = carry.select("conv_id", "s", F.coalesce(F.bit_xor("xa").over(before), zero).alias("xa"), F.coalesce(F.bit_xor("xb").over(before), zero).alias("xb"))
    inside = Window.partitionBy("conv_id", "s").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rolled = term.withColumns({"ra": F.bit_xor("ta").over(inside), "rb": F.bit_xor("tb").over(inside)}).join(carry, ["conv_id", "s"])
    return rolled.select("conv_id", "role", "text", "k", F.col("ra").bitwiseXOR(F.col("xa")).alias("a"), F.col("rb").bitwiseXOR(F.col("xb")).alias("b"))


def maximal(prefixes: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_copies of conversations that are no proper prefix of another; the smallest id of equal ones."""
    sizes = prefixes.groupBy("conv_id").agg(F.max("k").alias("n"))
    marked = materialize(prefixes.select("conv_id", "k", "a", "b").join(sizes, "conv_id"), "prefixes")
    whole = marked.where("k = n").groupBy("k", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = marked.where("k < n").select("k", "a", "b").distinct()
    return whole.join(inner, ["k", "a", "b"], "left_anti").select("conv_id", F.col("k").alias("n_turns"), "n_copies")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.replace(role, F.lit(MARK), F.lit(SAFE)), F.lit("\n"), F.replace(text, F.lit(MARK), F.lit(SAFE)), F.lit(CLOSE + "\n"))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and chat (the rendered conversation)."""
    prefixes = materialize(numbered(turns), "numbered")
    kept = materialize(maximal(prefixes), "maximal")
    parts = prefixes.select("conv_id", "k", rendered(F.col("role"), F.col("text")).alias("part")).join(kept.select("conv_id"), "conv_id", "left_semi")
    chats = parts.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x.part), "").alias("chat"))
    return kept.join(chats, "conv_id").select("conv_id", "n_turns", "n_copies", "chat")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id) AS n,
  '{OPEN}' || replace(role, '{MARK}', '{SAFE}') || chr(10) || replace(text, '{MARK}', '{SAFE}') || '{CLOSE}' || chr(10) AS part,
  length(role) || ':' || role || length(text) || ':' || text AS raw FROM t),
p AS (SELECT *, string_agg(raw, '' ORDER BY k) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pre FROM n),
w AS (SELECT k, pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE k = n GROUP BY k, pre),
m AS (SELECT conv_id, k AS n_turns, n_copies FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.k AND p.pre = w.pre))
SELECT conv_id, n_turns, n_copies, chat FROM m JOIN (SELECT conv_id, string_agg(part, '' ORDER BY k) AS chat FROM n GROUP BY conv_id) USING (conv_id)"""

QUERIES = {"op9_chat": op9_chat}
ORACLE_SQL = {"op9_chat": ORACLE}
