"""Operator 3, language ID: multinomial naive Bayes over hashed character n-grams.

Counts of hashed 1-, 2- and 3-grams are gathered over all training documents (numpy inside tasks, summed by Spark).  The
log-probability matrix has languages x BUCKETS entries whatever the input, so it is broadcast; at most MOST_LANGUAGES languages
are learned, and more are an error.  Documents are scored in batches by a sparse gather and a segmented sum.

Defined results: null text or text without a letter is ``und`` with score 0; a null doc_id counts as held out; null or empty
training data makes every text ``und``; texts of any length are read whole, PIECE code points at once beside one lower-cased copy;
ties go to the language that sorts first; repeated rows each get a result; other columns are kept, and those named lang_pred, score or
held_out are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import by_value
from riskloom.session import materialize, table

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: The matrix has at most MOST_LANGUAGES x BUCKETS doubles, 32 MB.
MOST_LANGUAGES = 256
PIECE, SHARED = 1 << 19, max(ORDERS) - 1
UNDECIDED = "und"

by_value(__name__)


def grams(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each order, the bucket of the n-gram that starts at every place but the last n - 1."""
    mul = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
    codes = codes.astype(np.uint32, copy=False)
    for n in ORDERS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, 0x27D4EB2F * n & 0xFFFFFFFF, np.uint32)
        for j in range(n):
            h ^= codes[j : len(codes) - n + 1 + j] * mul[j]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        yield n, (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(code points, owner, start and size of each run, characters at its end that the owner's next run begins with), about PIECE code
    points at once.  A text longer than PIECE comes in runs that share SHARED characters, so that every n-gram is met in one run."""
    held: list[str] = []
    owners: list[int] = []
    shared: list[int] = []

    def out() -> tuple[np.ndarray, ...]:
        codes = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.array([len(x) for x in held], np.int64)
        return codes, np.array(owners), np.cumsum(sizes) - sizes, sizes, np.array(shared)

    total = 0
    for k, text in enumerate(texts):
        lower = text.lower()
        for a in range(0, max(len(lower) - SHARED, 1), PIECE):
            held.append(lower[a : a + PIECE + SHARED])
            owners.append(k)
            shared.append(SHARED if a + PIECE + SHARED < len(lower) else 0)
            total += len(held[-1])
            if total >= PIECE:
                yield out()
                held, owners, shared, total = [], [], [], 0
    if held:
        yield out()


def within(starts: np.ndarray, sizes: np.ndarray, shared: np.ndarray, total: int, n: int) -> np.ndarray:
    """Which places begin an n-gram that stays in its run and is not met again in the next."""
    ok = np.ones(max(total - n + 1, 0), bool)
    off = np.minimum(np.maximum(n - 1, shared), sizes)
    for back in range(1, int(off.max(initial=0)) + 1):
        at = (starts + sizes)[off >= back] - back
        ok[at[at < len(ok)]] = False
    return ok


def count_grams(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Training rows (text, lang) to counts (lang, bucket, n); bucket -1 counts documents."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for frame in frames:
        for lang, own in frame.groupby("lang", sort=False):
            texts = own["text"].tolist()
            docs[lang] = docs.get(lang, 0) + len(texts)
            counts = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for codes, _, starts, sizes, shared in pieces(texts):
                for n, h in grams(codes):
                    counts += np.bincount(h[within(starts, sizes, shared, len(codes), n)], minlength=BUCKETS)
    for lang, counts in total.items():
        (at,) = np.nonzero(counts)
        yield pd.DataFrame({"lang": lang, "bucket": np.append(at, -1).astype("int32"), "n": np.append(counts[at], docs[lang])})


class Model:
    """Languages in order, and log-probabilities as float32 rows by bucket; the last row is zero, for places without an n-gram."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        logp = np.log(smooth) - np.log(smooth.sum(1, keepdims=True))
        self.weights = np.vstack([logp.T, np.zeros((1, len(langs)))]).astype(np.float32)
        self.prior = np.log(np.maximum(docs, 1)) - np.log(max(docs.sum(), 1))

    @property
    def parts(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """All of it as plain values, which is what goes to executors: they need no copy of the package."""
        return self.langs, self.weights, self.prior

    @classmethod
    def of(cls, parts: tuple[list[str], np.ndarray, np.ndarray]) -> Model:
        own = cls.__new__(cls)
        own.langs, own.weights, own.prior = parts
        return own

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log-probability of each text under each language."""
        out = np.tile(self.prior, (len(texts), 1)).astype(np.float64)
        for codes, owners, starts, sizes, shared in pieces(texts):
            full = sizes > 0
            for n, h in grams(codes):
                at = np.full(len(codes), BUCKETS, np.int32)
                ok = within(starts, sizes, shared, len(codes), n)
                at[: len(h)][ok] = h[ok]
                for k in range(len(self.langs)):
                    np.add.at(out[:, k], owners[full], np.add.reduceat(self.weights[:, k][at], starts[full], dtype=np.float64))
        return out


def fit(docs: DataFrame) -> Model:
    """Learns from text and lang of all rows of ``docs`` whose both are there."""
    known = docs.where("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInPandas(count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialize(counts, "grams")  # read twice below
    langs = sorted(r[0] for r in counted.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = counted.toPandas()  # at most MOST_LANGUAGES x (BUCKETS + 1) rows
    counts, n = np.zeros((len(langs), BUCKETS), np.int64), np.zeros(len(langs), np.int64)
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        buckets, values = own["bucket"].to_numpy(), own["n"].to_numpy()
        counts[i, buckets[buckets >= 0]] = values[buckets >= 0]
        n[i] = values[buckets < 0].sum()
    return Model(langs, counts, n)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score, the posterior probability of lang_pred."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts)

    @F.pandas_udf("struct<lang_pred string, score double>")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model.of(shared.value)
        names = np.array([*own.langs, UNDECIDED], dtype=object)
        for part in texts:
            n = len(part)
            if not own.langs:
                yield pd.DataFrame({"lang_pred": [UNDECIDED] * n, "score": [0.0] * n})
                continue
            s = own.scores(part.tolist())
            best = s.argmax(1)
            score = 1 / np.exp(s - s.max(1, keepdims=True)).sum(1)
            yield pd.DataFrame({"lang_pred": names[best], "score": score})

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    none = F.struct(F.lit(UNDECIDED).alias("lang_pred"), F.lit(0.0).alias("score"))
    row = F.struct(*[F.col(c) for c in docs.columns if c not in ("lang_pred", "score")]).alias("row")
    guessed = docs.select(row, lettered.alias("lettered"), guess(F.when(lettered, F.col("text")).otherwise(F.lit(""))).alias("p"))
    return guessed.select("row", F.when(F.col("lettered"), F.col("p")).otherwise(none).alias("p")).select("row.*", "p.lang_pred", "p.score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5, F.lit(0)) == 0


def identify(docs: DataFrame) -> DataFrame:
    """Fits on the rows that are not held out and predicts all."""
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), fit(docs.where(~held_out(F.col("doc_id")))))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
ORACLE_SQL: dict[str, str] = {}
