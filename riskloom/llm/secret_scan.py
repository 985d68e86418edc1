r"""Operator 7, secret scans: an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes.  The ledger, a stored table, holds for each blob the rule versions that have
read it and their findings; an update scans only blobs with rule versions that the ledger lacks, once per distinct text, and
findings are joined back to every path (document) that holds the blob.  The registered query brings its ledger up to date twice: with the base
rules, then with all of them, when only the further rules are run.

Places come from the pieces between matches (``split``) and the matches themselves (``regexp_extract_all``) of one expression,
measured in code points.  Defined results: a null text is empty; findings of one start are in the order of the rules (ties); copies share findings; repeated rows each get a result; an
empty table gives an empty result; a very long text is read whole; columns other than doc_id and text are ignored; documents that
share an id, or have none, are each given what their text holds.  Native: DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import MOST_HASHES, looked_up
from riskloom.session import fresh_path, materialize, shuffles_removed, table


@dataclass(frozen=True)
class Rule:
    """``gate`` is a text every match holds; group ``group`` must have ``least`` characters."""

    kind: str
    regex: str
    gate: str
    group: int = 0
    least: int = 0
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Base rules, in order.  Where only long matches count, the least length is part of the expression.
BASE = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "(?i:passw|secret|token|api_?key)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", "AKIA"),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", "[0-9a-f]{24}"),
]
# Further rules.
MORE = [
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "PRIVATE KEY-----"),
    Rule("service_token", r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})", "gh[pousr]_|xox[abprs]-"),
    Rule("jwt", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}", "eyJ"),
]
RULES = BASE + MORE
SPANS = "array<struct<start:long,rank:int,kind:string,end:long>>"


def quoted(regex: str) -> str:
    return "r'" + regex + "'" if "'" not in regex else 'r"' + regex.replace('"', r"\x22") + '"'


def spans(rule: Rule, rank: int) -> Column:
    """The rule's findings in the column ``text``."""
    regex, none = quoted(rule.regex), f"cast(array() as {SPANS})"
    pairs = f"arrays_zip(split(text, {regex}, -1), regexp_extract_all(text, {regex}, 0), regexp_extract_all(text, {regex}, {rule.group}))"
    step = f"""aggregate({pairs}, named_struct('e', 0L, 'out', {none}), (a, x) -> named_struct(
        'e', a.e + length(x['0']) + coalesce(length(x['1']), 0),
        'out', if(coalesce(length(x['2']), -1) >= {max(rule.least, 0)}, concat(a.out, array(named_struct('start', a.e + length(x['0']), 'rank', {rank}, 'kind', '{rule.kind}',
            'end', a.e + length(x['0']) + length(x['1'])))), a.out)), a -> a.out)"""
    return F.when(F.col("text").rlike(rule.gate), F.expr(step)).otherwise(F.expr(none))


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id and blob, the address of the text, of every row; written, so that texts are addressed once."""
    return materialize(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob")), "paths")


#: Addresses of a part of the texts are broadcast up to this many, about 100 bytes each.
MOST_ADDRESSES = 500_000


def _lacking(paths: DataFrame, ledger: DataFrame | None, rules: list[Rule]) -> DataFrame:
    """blob, n (its rows), todo (rule versions that the ledger lacks for it), written."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = paths.groupBy("blob").agg(F.count("*").alias("n"))
    if ledger is None:
        return materialize(blobs.withColumn("todo", keys), "asked")
    seen = ledger.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("seen"))
    todo = F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>")))
    return materialize(blobs.join(seen, "blob", "left").select("blob", "n", todo.alias("todo")).where("size(todo) > 0"), "asked")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: list[Rule] = RULES, paths: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rules, found) for the pairs of blob and rule version that ``ledger``, a written table, lacks.

    Addresses come first.  A text that no other row has is scanned where it lies; only texts that recur are moved, one of each from each task, to be
    scanned once.  Which texts recur is broadcast as at most MOST_HASHES hashes (two texts with one hash are both moved); if only some are asked for, at
    most MOST_ADDRESSES addresses are; beyond that a join tells."""
    paths = addressed(docs) if paths is None else paths
    asked = _lacking(paths, ledger, rules)
    n_blobs, n_recur, n_asked = paths.select(F.count_distinct("blob")).first()[0], asked.where("n > 1").count(), asked.count()
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    out = []
    for todo in sorted(tuple(r.todo) for r in asked.select("todo").distinct().collect()):  # as many as there were sets of rules
        own = asked.where(F.col("todo") == F.array(*map(F.lit, todo)))
        found = F.array_sort(F.concat(*[spans(r, k) for k, r in enumerate(rules) if r.key in todo]))
        row = ("blob", F.array(*map(F.lit, todo)).alias("rules"), found.alias("found"))
        recur = own.where("n > 1").select("blob")
        if n_recur <= MOST_HASHES and n_asked == n_blobs and own.count() == n_asked:
            hashes = F.broadcast(recur.select(F.xxhash64("blob").alias("h")).distinct())
            marked = texts.withColumn("h", F.xxhash64("blob"))
            alone, again = marked.join(hashes, "h", "left_anti"), marked.join(hashes, "h", "left_semi")
        else:
            alone, again = _among(texts, own.where("n = 1").select("blob")), _among(texts, recur)
        out.append(alone.select(*row))
        if n_recur:
            out.append(again.groupBy("blob").agg(F.first("text").alias("text")).select(*row))
    if not out:
        return texts.where(F.lit(False)).select("blob", F.array().cast("array<string>").alias("rules"), F.array().cast(SPANS).alias("found"))
    return reduce(DataFrame.unionByName, out)


def _among(texts: DataFrame, blobs: DataFrame) -> DataFrame:
    return texts.join(F.broadcast(blobs) if blobs.count() <= MOST_ADDRESSES else blobs.hint("merge"), "blob", "left_semi")


def update(path: str, docs: DataFrame, rules: list[Rule] = RULES, paths: DataFrame | None = None) -> DataFrame:
    """Brings the ledger at ``path`` up to date with ``docs`` and ``rules``, and returns it.  Run again, or after a failure, it scans what is not there yet."""
    spark = docs.sparkSession
    schema = f"blob string, rules array<string>, found {SPANS}"
    try:
        ledger = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        ledger = None
    with shuffles_removed(spark):
        scan(docs, ledger, rules, paths).write.mode("append").option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """doc_id and found, sorted by start and rule, for every row of ``docs``."""
    paths = addressed(docs) if paths is None else paths
    found = ledger.where("size(found) > 0").groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("found"))
    facts = materialize(paths.groupBy("blob").agg(F.count("*").alias("n")).join(found, "blob", "left"), "blobs")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return looked_up(paths, facts, "blob", total).select("doc_id", "blob", F.coalesce("found", F.array().cast(SPANS)).alias("found"))


def joined(found: str, base_only: bool) -> Column:
    names = ", ".join(f"'{r.kind}'" for r in BASE)
    kept = f"filter({found}, f -> f.kind in ({names}))" if base_only else found
    return F.expr(f"array_join(transform({kept}, f -> concat_ws(':', f.kind, cast(f.start as string), cast(f.end as string))), ',')")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "ledger")
    paths = addressed(docs)
    update(path, docs, BASE, paths)
    ledger = update(path, docs, RULES, paths)  # the pairs of blobs and further rules
    counts = [F.expr(f"cast(size(filter(found, f -> f.kind = '{r.kind}')) as bigint)").alias(f"n_{r.kind}") for r in BASE]
    return findings(docs, ledger, paths).select("doc_id", *counts, F.sha2(joined("found", True), 256).alias("base_sha256"), joined("found", False).alias("spans"))


def _oracle() -> str:
    """The same in SQL, whose expressions lack look-behind: the character before a match is taken as group 1 and counted off."""
    either = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) + opt for word, opt in (("password", ""), ("passwd", ""), ("secret", ""), ("token", "")))
    key = "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
    forms = {"assign": (rf"""({either}|{key})["\x27]?\x20*[:=]\x20*["\x27]?([A-Za-z0-9+/_.=-]+)""", 2, 0), "access": (r"AKIA[A-Z0-9]{16,}", 0, 0), "hex": (r"[0-9a-f]{24,}", 0, 0)}
    for rule in MORE:
        ahead = "(?<![A-Za-z0-9])"
        forms[rule.kind] = ("(^|[^A-Za-z0-9])" + rule.regex.removeprefix(ahead), 0, 1) if rule.regex.startswith(ahead) else (rule.regex, 0, 0)
    parts = [
        f"SELECT r, {k} AS rank, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(text, '{x}') AS g, regexp_extract_all(text, '{x}') AS m, regexp_extract_all(text, '{x}', {group}) AS v, "
        + (f"regexp_extract_all(text, '{x}', {lead})" if lead else "NULL::VARCHAR[]")
        + f" AS lead FROM d WHERE regexp_matches(text, '{x}')"
        for k, rule in enumerate(RULES)
        for x, group, lead in [forms[rule.kind]]
    ]
    base = ", ".join(f"'{r.kind}'" for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
u AS MATERIALIZED ({" UNION ALL ".join(parts)}),
s AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM u),
p AS (SELECT *, coalesce(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS b FROM s),
f AS (SELECT r, rank, kind, b + coalesce(length(lead[k]), 0) AS a, b + length(m[k]) AS e FROM p WHERE length(v[k]) >= least),
t AS (SELECT r, {counts}, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS b, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY a, rank) AS spans FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""


QUERIES = {"op7_secrets": op7_secrets}
ORACLE_SQL = {"op7_secrets": _oracle()}
