"""Operator 5, mixing sources to target weights: systematic sampling.

Sources in code point order, null last, get the weights WEIGHTS in turn.  They share SHARE times all sizes by weight; a target
stops at MOST times its source's size and the excess is shared again.  Within a source, in order of (size, doc_id, hashes of text and row), documents'
expected copies (target / source size each) are summed; one offset per source is added, and a document is emitted once for each
integer crossed.  The order by size keeps the taken words near the target.

Prefix sums never gather a source in one task: rows are dealt by range of (source, size, doc_id), so that a source of any size
spreads over tasks, and only counts by range are summed in order.

Defined results: null text has size 0; a null source is a source of its own; a source without words has target 0 and takes
nothing; documents of one size and id are ordered by their text and then by their other columns, and only rows that are equal throughout
may stand for each other; repeated rows are sampled each on their own; other columns are kept, one named copy_no is replaced; very long
texts are only counted; an empty table gives an empty result.  The offset is a hash of the source
name and SEED, so reruns agree.  Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import identity, once, row_hash, words
from riskloom.operators.dealt import running
from riskloom.session import materialize, table

WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix-42"


def targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target; one row per source."""
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # one row per source: windows over the whole table are small
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(named) - 1, F.lit(len(WEIGHTS))) + 1)).withColumn("cap", MOST * F.col("source_size"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    total = F.sum("source_size").over(everything)
    capped = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    # if all sources before this one stop at their cap, the rest share at this level
    level = weighed.withColumn("level", (SHARE * total - capped) / free)
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("ratio"), F.col("level").alias("level")))).over(everything)
    target = F.coalesce(F.least(F.col("cap").cast("double"), F.col("first.level") * F.col("weight")), F.col("cap").cast("double"))
    return level.withColumn("first", first).select("source", "source_size", target.alias("target"))


def offset(source: Column) -> Column:
    """In [0, 1), from the source's name."""
    name = F.concat(F.lit(SEED), F.when(source.isNull(), F.lit("-")).otherwise(F.lit("+")), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def sample(docs: DataFrame) -> DataFrame:
    """_id, _a, _b, _r (the row), source, size, source_size, target, copies and taken."""
    size = F.size(words(F.col("text"))).cast("long")
    sized = materialize(docs.select(*identity(), row_hash(docs), "source", size.alias("size")), "sizes")
    per_source = targets(sized).withColumnRenamed("source", "_source")
    placed = running(sized, [F.col(c) for c in ("size", "_id", "_a", "_b", "_r")], {"rank": F.lit(1)}, ["source"]).join(per_source, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = offset(F.col("source"))
    copies = (F.floor(rate * F.col("rank") + shift) - F.floor(rate * (F.col("rank") - 1) + shift)).cast("long")
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return placed.withColumn("copies", copies).select("_id", "_a", "_b", "_r", "source", "size", "source_size", "target", "copies", taken)


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as it was drawn, with copy_no from 1."""
    # equal rows share what was drawn for them: one of them stands for all
    drawn = sample(docs).groupBy("_id", "_a", "_b", "_r").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    every = once(docs, materialize(drawn, "drawn"), "copies").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"))
    return every.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != "copy_no"], "copy_no")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sample(docs).select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1] AS weight, {MOST} * source_size AS cap FROM s),
l AS (SELECT *, ({SHARE}::DOUBLE * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
  / (sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
t AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT arg_min(level, cap / weight) FROM l WHERE level * weight <= cap) * weight) AS target,
  ('0x' || substr(md5('{SEED}' || CASE WHEN source IS NULL THEN '-' ELSE '+' END || coalesce(source, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS u FROM l),
r AS (SELECT d.*, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS c,
  row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) AS k FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(c * k + u) - floor(c * (k - 1) + u)))::BIGINT AS taken FROM r"""

QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL = {"op5_mixing": ORACLE}
