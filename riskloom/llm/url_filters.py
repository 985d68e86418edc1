r"""Operator 2, URL filters: rules indexed by their rarest literal token.

A rule is a regular expression over host and path.  Its literal tokens ([a-z0-9]+, whole), which every URL it fits must hold, are read off
the parsed expression (``literal_tokens``).  Tokens are counted over all URLs, each rule is filed under its rarest one, the distinct tokens of a
URL fetch candidate rules, and only those run their regular expression.  A rule without such a token is filed under the empty token,
which then every URL has.  Base rules are prefixes of host and path, the longest wins; if none fits, a fitting pattern rule blocks, else the URL is
allowed.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule that needs a character and is allowed; equal URLs
are judged once; repeated rows each get a result; columns other than page_id and url are ignored; a very long URL is read whole; of rules that
fit alike the last by code point is named; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from re import _parser as parser

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import ascii_lower, looked_up
from riskloom.session import materialize, table

# The base rules.
BASE = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
# Pattern rules, regular expressions over host and path.
PATTERNS = [r"(^|[.])spam-farm[.]", r"(^|[.])cheap-pills[.]", r"(^|[.])casino[.-]", r"[/]adult[/]", r"[/]wp-login[.]php$"]


def _rule(name: str, before: str, after: str) -> str:
    return before + name.replace(".", "[.]") + after


def host_word(name: str) -> str:
    """A host label, or a part of one between hyphens."""
    return _rule(name, r"^(?:[^/]*[.@-])?", r"(?:[-.:/]|$)")


def host_label(name: str) -> str:
    """A whole host label."""
    return _rule(name, r"^(?:[^/]*[.@])?", r"(?:[.:/]|$)")


def path_segment(name: str) -> str:
    return _rule(name, r"(?i)^[^/]*/(?:.*/)?", r"(?:/|$)")


def file_kind(name: str) -> str:
    return _rule(name, r"(?i)^[^/]*/.*[.]", r"$")


# The registered rules, the patterns above and words of gambling, adult, tracking, pharmacy, spam, login and download URLs.
HOST_WORDS = (
    "casino casinos roulette jackpot jackpots blackjack sportsbook betting bets free-bets free-spins online-slots online-poker "
    "porn porno xxx nsfw hentai camgirls escorts sex-cams adult-x adult-chat adult-cams adult-dating adult-video adult-videos "
    "adserver adservice adtracker ad-server ads-track ad-track ad-tracker click-track doubleclick clickbank "
    "viagra cialis levitra tramadol pills cheap-pills cheap-meds online-pharmacy "
    "spam spam-farm link-farm content-farm buy-followers buy-backlinks warez keygen"
).split()
HOST_LABELS = "slots poker sex adult ads ad adtech tracking tracker telemetry pharmacy torrent torrents".split()
PATH_SEGMENTS = (
    "casino roulette jackpot sportsbook betting free-bets porn xxx nsfw hentai escorts adult viagra cialis online-pharmacy cheap-pills "
    "wp-login.php wp-admin xmlrpc.php login login.php signin sign-in signup sign-up logout register forgot-password reset-password "
    "download downloads download.php torrent torrents warez keygen"
).split()
FILE_KINDS = "exe msi apk dmg iso zip rar 7z torrent".split()
RULES = [*PATTERNS, *map(host_word, HOST_WORDS), *map(host_label, HOST_LABELS), *map(path_segment, PATH_SEGMENTS), *map(file_kind, FILE_KINDS)]

#: Rules go to every task; a larger list than this is joined by a shuffle instead.
MOST_BROADCAST = 100_000


TOKEN = frozenset(map(ord, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"))


def _edge(items: list, place: int, step: int) -> bool:
    """Whether what stands at ``place`` and on in direction ``step`` can only begin with a character outside tokens, or the text's end."""
    if not 0 <= place < len(items):
        return False
    op, value = items[place]
    name = str(op)
    if name == "AT":
        return str(value) in ("AT_BEGINNING", "AT_BEGINNING_STRING", "AT_END", "AT_END_STRING")
    if name == "LITERAL":
        return value not in TOKEN
    if name == "IN":
        plain = [v for k, v in value if str(k) == "LITERAL"]
        return len(plain) == len(value) and not TOKEN & set(plain)
    inside = lambda part: _edge(list(part), 0 if step > 0 else len(part) - 1, step)
    if name == "SUBPATTERN":
        return inside(value[3])
    if name == "BRANCH":
        return all(inside(part) for part in value[1])
    if name == "MAX_REPEAT":
        return inside(value[2]) and (value[0] > 0 or _edge(items, place + step, step))
    return False


def literal_tokens(regex: str) -> list[str]:
    """Whole tokens, in small letters, that every text which the expression fits must hold: runs of literals between edges that no token
    crosses.  Only the expression's own sequence is looked at, not alternatives or repeats."""
    items = list(parser.parse(regex))
    out, at = [], 0
    while at < len(items):
        end = at
        while end < len(items) and str(items[end][0]) == "LITERAL" and items[end][1] in TOKEN:
            end += 1
        if end > at and _edge(items, at - 1, -1) and _edge(items, end, 1):
            out.append("".join(chr(v) for _, v in items[at:end]).lower())
        at = max(end, at + 1)
    return out


def base_tokens(rule: str) -> list[str]:
    """Of a prefix of host and path: the host's tokens and the whole segments of the path."""
    at, _, path = rule.partition("/")
    host_parts = re.findall("(?<![^.])[a-z0-9]+(?![^.])", at.lower())
    return host_parts + re.findall("(?<=/)[a-z0-9]+(?=/)", ("/" + path).lower())


def read_rules(spark: SparkSession, path: str) -> tuple[list[tuple[str, str]], list[str]]:
    """Base rules and pattern rules of a text file of at most some hundred thousand lines: ``allow host/path`` or ``block host/path`` for prefixes, ``block ~ expression``
    for patterns.  Empty lines and those that begin with # are skipped; any other line is an error."""
    base, patterns = [], []
    for line in (r[0].strip() for r in spark.read.text(path).collect()):
        verdict, _, rule = line.partition(" ")
        if not line or line.startswith("#"):
            continue
        if verdict == "block" and rule.startswith("~ "):
            re.compile(rule[2:])
            patterns.append(rule[2:])
        elif verdict in ("allow", "block") and "/" in rule:
            base.append((rule, verdict))
        else:
            raise ValueError(f"not a rule: {line}")
    return base, patterns


def rule_table(spark: SparkSession, base: list[tuple[str, str]], patterns: list[str]) -> DataFrame:
    """rule, verdict, size (0 for pattern rules), regex, tokens (the empty one if there is no other)."""
    rows = [(rule, verdict, len(rule), rf"^(?:[^/]*\.)?\Q{rule}\E", base_tokens(rule) or [""]) for rule, verdict in base]
    rows += [(regex, "block", 0, regex, literal_tokens(regex) or [""]) for regex in patterns]
    return spark.createDataFrame(rows, "rule string, verdict string, size int, regex string, tokens array<string>")


def host(url: str) -> Column:
    return F.expr(f"if(instr({url}, '://') > 0, regexp_extract(substring({url}, instr({url}, '://') + 3), '^[^/?#]*', 0), '')")


def judge(pages: DataFrame, base: list[tuple[str, str]] = BASE, patterns: list[str] = PATTERNS) -> DataFrame:
    """pages' page_id and url with host, path, rule and verdict."""
    spark = pages.sparkSession
    rest = F.expr("if(instr(url, '://') > 0, regexp_extract(substring(url, instr(url, '://') + 3), '^[^?#]*', 0), '')")
    split = (
        pages.select("page_id", "url")
        .withColumn("raw", F.coalesce(host("url"), F.lit("")))
        .withColumn("path", F.substring(F.coalesce(rest, F.lit("")), F.length("raw") + 1, F.length(F.coalesce("url", F.lit("")))))
        .withColumn("host", ascii_lower(F.col("raw")))
        .drop("raw")
        .withColumn("at", F.concat("host", "path"))  # a path is empty or begins with the first slash
    )
    places = materialize(split.groupBy("at").agg(F.count("*").alias("n")), "places")
    found = F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(ascii_lower(F.col("at")), F.lit("[a-z0-9]+"), F.lit(0))))
    tokens = places.withColumn("token", F.explode(found))
    rules = rule_table(spark, base, patterns)
    hint = F.broadcast if len(base) + len(patterns) <= MOST_BROADCAST else (lambda df: df)
    literal = rules.select(F.explode("tokens").alias("token")).distinct()
    seen = tokens.join(hint(literal), "token").groupBy("token").agg(F.sum("n").alias("seen"))
    order = Window.partitionBy("rule").orderBy(F.coalesce("seen", F.lit(0)), "token")
    rarest = rules.withColumn("token", F.explode("tokens")).join(hint(seen), "token", "left").withColumn("k", F.row_number().over(order)).where("k = 1")
    filed = rarest.select("token", "rule", "verdict", "size", "regex", F.coalesce("seen", F.lit(0)).alias("seen"))
    if len(base) + len(patterns) <= MOST_BROADCAST:
        near = tokens.join(F.broadcast(filed), "token")
    else:
        # one row per token; those that many URLs have, the empty one among them, are joined by broadcast
        lists = filed.groupBy("token").agg(F.max("seen").alias("n"), F.collect_list(F.struct("rule", "verdict", "size", "regex")).alias("rules"))
        total = tokens.agg(F.count("*")).first()[0]
        near = looked_up(tokens.drop("n"), materialize(lists, "rules"), "token", total).withColumn("r", F.explode("rules")).select("at", "r.*")
    fits = near.where(F.expr("at rlike regex"))
    best = fits.groupBy("at").agg(F.max(F.struct("size", "rule", "verdict")).alias("b"))
    facts = materialize(places.join(best, "at", "left").select("at", "n", "b"), "verdicts")
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    named = F.when(F.col("b.size") > 0, F.col("b.rule"))
    return looked_up(split, facts, "at", total).select("page_id", "url", "host", "path", named.alias("rule"), F.coalesce("b.verdict", F.lit("allow")).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), patterns=RULES).drop("url")


def _oracle() -> str:
    fit = lambda rule: f"(h = '{rule.partition('/')[0]}' OR ends_with(h, '.{rule.partition('/')[0]}')) AND starts_with(p, '/{rule.partition('/')[2]}')"
    ordered = sorted(BASE, key=lambda x: -len(x[0]))
    rules = " ".join(f"WHEN {fit(r)} THEN '{r}'" for r, _ in ordered)
    verdicts = " ".join(f"WHEN {fit(r)} THEN '{v}'" for r, v in ordered) + " " + f"WHEN regexp_matches(h || p, '{'|'.join(f'(?:{x})' for x in RULES)}') THEN 'block'"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
b AS (SELECT page_id, r, regexp_extract(r, '^[^/?#]*') AS h0 FROM a),
c AS (SELECT page_id, translate(coalesce(h0, ''), '{upper}', '{lower}') AS h, regexp_extract(coalesce(substr(r, length(h0) + 1), ''), '^[^?#]*') AS p FROM b)
SELECT page_id, h AS host, p AS path, CASE {rules} END AS rule, CASE {verdicts} ELSE 'allow' END AS verdict FROM c"""


QUERIES = {"op2_url_filters": op2_url_filters}
ORACLE_SQL = {"op2_url_filters": _oracle()}
