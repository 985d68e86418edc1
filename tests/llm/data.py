"""Small tables for the operator tests, edge cases included."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list, langs: list | None = None, sources: list | None = None, ids: list | None = None) -> DataFrame:
    n = len(texts)
    rows = [
        (i, t, lang, s, None if t is None else len(t))
        for i, t, lang, s in zip(ids or range(n), texts, langs or ["en"] * n, sources or [f"s{k % 3}" for k in range(n)], strict=True)
    ]
    return spark.createDataFrame(rows, DOCS)


def write(df: DataFrame, folder, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Lambda", "mu", "née", "größe", "x1", "42"]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", ", ", ".\n", "\t"]) for _ in range(n))


EDGES = [None, "", " ", "\n\n", "a", "word", "a b", "a b c", "a a a a a a", "same same\nsame same\nother", "tab\tand\x0bvertical\x0cfeed\r\n", "é" * 300, "x" * 1000, "ab" * 400, "日本語 テキスト", "\x1c\x85\xa0"]
