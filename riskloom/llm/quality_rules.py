"""Operator 1, quality rules: weak supervision instead of all-must-pass filtering.

Each rule looks for a fault and votes bad (-1), or for order and votes good (1), or abstains (0).  Votes are counted per vote pattern (at most 2
to the number of rules, whatever the input).  Expectation-maximisation over those counts estimates the share of good documents and, of every
rule, how often it speaks on good and on bad documents; a closed expression turns a document's votes and abstentions into its posterior
probability of being good.  What is known beforehand is only that a rule for faults rarely speaks on a good document (FALSE_ALARM), which
keeps the classes from trading places; all rules of a sort start alike.

Defined results: a null text has no words, and with it each rule for faults votes bad, and fails the base; an empty table gives an empty result;
repeated rows are judged each on their own; other columns are ignored; in a very long text the work grows with its words, and it is sorted
within its row.  Native: DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import UPPER, words
from riskloom.session import materialize, table

# Symbols that count against a text, and the thresholds of the base.
SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
MOST_REPEATED = 50

#: name, what it votes, when; over the columns of ``measures``.
RULES = [
    ("word_size", -1, "word_chars < 3 * n_words or word_chars > 7 * n_words"),
    ("symbols", -1, "10 * n_symbols > n_words"),
    ("symbol_share", -1, "100 * n_symbols > 5 * word_chars"),
    ("marks", -1, "2 * n_marks > n_words"),
    ("capitals", -1, "10 * n_capitals > 3 * word_chars"),
    ("lines", -1, "10 * n_dup_lines > 3 * n_lines"),
    ("repeats", -1, "100 * n_repeat_words > 20 * n_words"),
    ("line_size", -1, "n_words < 5 * n_lines"),
    ("long", 1, "n_words >= 100"),
    ("variety", 1, "100 * n_repeat_words <= 2 * n_words"),
    ("line_order", 1, "n_words >= 10 * n_lines and n_words <= 100 * n_lines"),
    ("word_order", 1, "word_chars >= 4 * n_words and word_chars <= 6 * n_words"),
]
#: How often a rule speaks on good and on bad documents, at first: rules for faults, rules for order.
FIRST = {-1: (0.1, 0.5), 1: (0.7, 0.5)}
#: The most that a rule for faults may speak on good documents, the bounds of all other rates, and of the share of good documents.
FALSE_ALARM, RATES, SHARE = 0.02, (0.0005, 0.99), (0.05, 0.95)
ROUNDS, KEEP, PSEUDO = 12, 0.5, 10


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    split = docs.select(
        "doc_id",
        words(F.col("text")).alias("w"),
        (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "!?", ""))).cast("long").alias("n_marks"),
        (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long").alias("n_capitals"),
        lines.alias("l"),
    )
    # A window is packed as 32 bits of its hash and its place, so that equal windows stand side by side in a sorted long array.
    packed = """sort_array(transform(if(size(w) > 3, sequence(0, size(w) - 3), cast(array() as array<int>)),
        i -> shiftleft(shiftright(xxhash64(w[i], w[i + 1], w[i + 2]), 32), 32) | cast(i as bigint)))"""
    hashed = split.select(
        "doc_id", "w", "n_symbols", "n_marks", "n_capitals",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(packed).alias("p"),
    )
    # The few windows whose hash recurs are compared word by word.
    twice = hashed.withColumn(
        "c",
        F.expr("""transform(filter(p, (x, j) -> (j > 0 and shiftright(x, 32) = shiftright(p[greatest(j - 1, 0)], 32))
            or (j < size(p) - 1 and shiftright(x, 32) = shiftright(p[least(j + 1, size(p) - 1)], 32))), x -> cast(x & 4294967295 as int))"""),
    ).drop("p")
    exact = twice.withColumn("k", F.expr("array_sort(transform(c, i -> struct(concat_ws(' ', w[i], w[i + 1], w[i + 2]) as key, i as i)))")).drop("w", "c")
    places = exact.withColumn(
        "r",
        F.expr("""array_sort(transform(filter(k, (x, j) -> (j > 0 and x.key = k[greatest(j - 1, 0)].key)
            or (j < size(k) - 1 and x.key = k[least(j + 1, size(k) - 1)].key)), x -> x.i))"""),
    )
    covered = "aggregate(r, named_struct('e', 0, 'n', 0L), (a, i) -> named_struct('e', i + 3, 'n', a.n + i + 3 - greatest(i, a.e)), a -> a.n)"
    return places.select("doc_id", "n_words", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_lines", "n_dup_lines", F.expr(covered).alias("n_repeat_words"))


def vote(says: int, when: str) -> Column:
    speaks = F.expr(f"n_words = 0 or {when}" if says < 0 else f"n_words > 0 and {when}")
    return F.when(speaks, F.lit(says)).otherwise(F.lit(0))


@dataclass(frozen=True)
class Estimate:
    """The share of good documents, and how often each rule speaks on good and on bad ones."""

    share: float
    good: list[float]
    bad: list[float]


def at_first(sides: list[int]) -> Estimate:
    return Estimate(0.5, [FIRST[s][0] for s in sides], [FIRST[s][1] for s in sides])


def posterior(e: Estimate, names: list[str]) -> Column:
    """Probability of good given votes and abstentions, when rules speak independently within each class."""
    odds = F.lit(math.log(e.share / (1 - e.share)))
    for g, b, name in zip(e.good, e.bad, names, strict=True):
        odds = odds + F.when(F.col(name) != 0, F.lit(math.log(g / b))).otherwise(F.lit(math.log((1 - g) / (1 - b))))
    return 1 / (1 + F.exp(-odds))


def within(x: float, bounds: tuple[float, float]) -> float:
    return min(max(x, bounds[0]), bounds[1])


def most_on_good(side: int) -> float:
    return FALSE_ALARM if side < 0 else RATES[1]


def estimate(patterns: DataFrame, names: list[str], sides: list[int], rounds: int = ROUNDS) -> Estimate:
    """Expectation-maximisation over vote patterns and their counts ``n``.  Each round is one aggregate that returns one row."""
    now, k = at_first(sides), len(names)
    for _ in range(rounds):
        p = posterior(now, names)
        on_good = [F.sum(F.when(F.col(x) != 0, F.col("n") * p).otherwise(F.lit(0.0))) for x in names]
        on_bad = [F.sum(F.when(F.col(x) != 0, F.col("n") * (1 - p)).otherwise(F.lit(0.0))) for x in names]
        row = patterns.agg(*on_good, *on_bad, F.sum(F.col("n") * p), F.sum(F.col("n") * (1 - p))).first()
        if row[0] is None:
            break
        good, bad = row[2 * k], row[2 * k + 1]
        first = [FIRST[s] for s in sides]
        now = Estimate(
            within(good / (good + bad), SHARE),
            [within((row[i] + PSEUDO * min(first[i][0], most_on_good(s))) / (good + PSEUDO), (RATES[0], most_on_good(s))) for i, s in enumerate(sides)],
            [within((row[k + i] + PSEUDO * first[i][1]) / (bad + PSEUDO), RATES) for i in range(k)],
        )
    return now


def judge(docs: DataFrame, rules: list[tuple[str, int, str]] = RULES, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """The base counts, every rule's vote, quality (posterior) and kept."""
    names, sides = [f"vote_{name}" for name, *_ in rules], [says for _, says, _ in rules]
    voted = measures(docs).select("*", *[vote(says, when).alias(n) for n, (_, says, when) in zip(names, rules, strict=True)])
    voted = materialize(voted, "quality")  # counts only: the texts are read once
    patterns = materialize(voted.groupBy(*names).agg(F.count("*").alias("n")), "votes")
    found = estimate(patterns, names, sides, rounds)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("quality", posterior(found, names))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))
    )


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def _oracle() -> str:
    """The same in SQL: windows are grouped as rows, and the rounds of the estimate are unrolled."""
    names, sides, k = [f"vote_{name}" for name, *_ in RULES], [says for _, says, _ in RULES], range(len(RULES))
    votes = ", ".join(f"CASE WHEN {f'n_words = 0 OR {when}' if says < 0 else f'n_words > 0 AND {when}'} THEN {says} ELSE 0 END AS {n}" for n, (_, says, when) in zip(names, RULES, strict=True))
    first = at_first(sides)
    steps = ["t0 AS MATERIALIZED (SELECT 0.5::DOUBLE AS s, " + ", ".join(f"{first.good[i]}::DOUBLE AS g{i}, {first.bad[i]}::DOUBLE AS b{i}" for i in k) + ")"]
    odds = "ln(s / (1 - s)) + " + " + ".join(f"CASE WHEN {names[i]} <> 0 THEN ln(g{i} / b{i}) ELSE ln((1 - g{i}) / (1 - b{i})) END" for i in k)
    for r in range(ROUNDS):
        rates = ", ".join(
            f"least(greatest((sum(CASE WHEN {names[i]} <> 0 THEN n * p ELSE 0 END) + {PSEUDO * min(FIRST[sides[i]][0], most_on_good(sides[i]))}::DOUBLE) / (sum(n * p) + {PSEUDO}), {RATES[0]}::DOUBLE), {most_on_good(sides[i])}::DOUBLE) AS g{i}, "
            f"least(greatest((sum(CASE WHEN {names[i]} <> 0 THEN n * (1 - p) ELSE 0 END) + {PSEUDO * FIRST[sides[i]][1]}::DOUBLE) / (sum(n * (1 - p)) + {PSEUDO}), {RATES[0]}::DOUBLE), {RATES[1]}::DOUBLE) AS b{i}"
            for i in k
        )
        share = f"least(greatest(sum(n * p) / sum(n), {SHARE[0]}::DOUBLE), {SHARE[1]}::DOUBLE) AS s"
        steps.append(f"t{r + 1} AS MATERIALIZED (SELECT {share}, {rates} FROM (SELECT patterns.*, 1 / (1 + exp(-({odds}))) AS p FROM patterns, t{r}))")
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS i FROM rep) GROUP BY r),
m AS MATERIALIZED (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(text) - length(regexp_replace(text, '{SYMBOLS}', '', 'g')) AS n_symbols, length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_marks,
  length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_capitals,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::BIGINT AS n_lines,
  (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
   - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
v AS MATERIALIZED (SELECT *, {votes} FROM m),
patterns AS MATERIALIZED (SELECT {", ".join(names)}, count(*) AS n FROM v GROUP BY ALL),
{", ".join(steps)},
f AS (SELECT v.*, t{ROUNDS}.*, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM v, t{ROUNDS})
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 1 / (1 + exp(-({odds}))) >= {KEEP} AS kept FROM f"""


QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLE_SQL = {"op1_quality_rules": _oracle()}
