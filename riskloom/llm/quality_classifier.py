"""Operator 12, quality classifier by compression: zstandard dictionaries built from good and from bad labelled text.

A text is cut into pieces of PIECE bytes, and each is compressed with either dictionary, so that a dictionary tells on all of a long text and
not on its beginning alone.  The difference of the compressed sizes, over their sum and over the bytes of the text, becomes a probability by a
logistic curve, which knows the length too (a few bytes say little).  Half of the labelled sample builds the dictionaries, the other half fits the curve.

Bounds of the fit (parameters): ``most`` labelled documents of each class, SLICES slices of SLICE bytes of each for the dictionaries, spread evenly over
the whole text; sizes for the curve are of whole texts.  Scores are of whole texts of all documents.

Defined results: null and empty texts have sizes 0 and the curve's value there; where a class has no labelled text all scores are 0.5; labels that
disagree on a document, and null ones, are not learned from; texts of rows that share an id are all learned from and each scored; repeated rows have equal
scores; empty tables give an empty result; very long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import by_value
from riskloom.session import table

PIECE, LEVEL, DICTIONARY = 512, 3, 1 << 16
#: Labelled documents of each class, slices of each and their bytes.
MOST, SLICES, SLICE = 4000, 4, 1024

by_value(__name__)


@dataclass
class Model:
    """Dictionaries, and the curve's centre, scale and weights (the first is the constant); without dictionaries every score is 0.5."""

    good: bytes | None = None
    bad: bytes | None = None
    centre: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()


def dictionary(slices: list[bytes]) -> bytes:
    """A trained dictionary; of too little text, the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY, slices).as_bytes()
    except zstandard.ZstdError:
        return b"".join(slices)[-DICTIONARY:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(content)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)


def measures(texts: list[str | None], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    """For each text: difference of sizes (bad less good) over their sum, over the text's bytes, and the logarithm of these."""
    out = np.zeros((len(texts), 3))
    for k, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if raw:
            pieces = [raw[a : a + PIECE] for a in range(0, len(raw), PIECE)]
            g, b = sum(len(good.compress(p)) for p in pieces), sum(len(bad.compress(p)) for p in pieces)
            out[k] = (b - g) / (b + g), (b - g) / len(raw), np.log1p(len(raw))
    return out


def curve(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, scale and weights of a logistic curve, by Newton's steps with a slight ridge; ``share`` weighs the rows."""
    centre, scale = x.mean(0), x.std(0) + 1e-9
    a, w = np.column_stack([np.ones(len(x)), (x - centre) / scale]), np.zeros(x.shape[1] + 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (share * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), a.T @ (share * (y - p)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return centre, scale, w


def scored(texts: list[str | None], model: Model, tools: tuple) -> np.ndarray:
    x = measures(texts, *tools)
    at = np.clip(model.weights[0] + ((x - model.centre) / model.scale) @ np.array(model.weights[1:]), -30, 30)
    return 1 / (1 + np.exp(-at))


def held_out(column: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id has no remainder and is not held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, dict[int, int]]:
    """text and quality of at most ``most`` labelled documents of each class, by a hash of their ids; and how many there are."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("high"))
    known = known.where("quality = high").select(F.col("doc_id").alias("asked"), "quality")
    there = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    some = [known.where(F.col("quality") == q).orderBy(F.xxhash64("asked"), "asked").limit(most) for q in (0, 1)]
    # no more than 2 * most ids are broadcast
    return docs.join(F.broadcast(some[0].unionByName(some[1])), F.col("doc_id") == F.col("asked")).select("text", "quality").where("length(text) > 0"), there


def slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """h (a hash of the text), quality, and slices of the text if it is one for the dictionaries."""
    for frame in frames:
        rows = []
        for text, quality in zip(frame["text"], frame["quality"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            if (h := xxhash.xxh64_intdigest(raw)) % 2 == 0:
                n = min(SLICES, -(-len(raw) // SLICE))
                rows += [(h >> 1, quality, k, raw[(at := (len(raw) - SLICE) * k // (n - 1) if n > 1 else 0) : at + SLICE]) for k in range(n)]
        yield pd.DataFrame(rows, columns=["h", "quality", "k", "slice"])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Learns from ``labels`` (doc_id, quality) that are not held out."""
    some, there = _sample(docs.select("doc_id", "text"), labels, most)
    cut = some.mapInPandas(slices, "h long, quality int, k int, slice binary").toPandas().sort_values(["h", "k", "slice"])
    good, bad = (cut["slice"][cut["quality"] == q].map(bytes).tolist() for q in (1, 0))
    if not good or not bad:
        return Model()
    model = Model(dictionary(good), dictionary(bad))
    content = (model.good, model.bad)

    def measured(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tools = [compressor(c) for c in content]
        for frame in frames:
            own = frame[[xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) % 2 == 1 for t in frame["text"]]]
            yield pd.DataFrame(measures(own["text"].tolist(), *tools), columns=["a", "b", "c"]).assign(quality=own["quality"].to_numpy())

    sizes = some.mapInPandas(measured, "a double, b double, c double, quality int").toPandas().sort_values(["a", "b", "c", "quality"])
    y = sizes["quality"].to_numpy()
    if len(set(y)) < 2:
        return Model()
    share = np.where(y == 1, there[1] / (y == 1).sum(), there[0] / (y == 0).sum())
    model.centre, model.scale, model.weights = map(tuple, curve(sizes[["a", "b", "c"]].to_numpy(), y, share * len(y) / share.sum()))
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with score, the probability that a text is good."""
    if not model.weights:
        return docs.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tools = (compressor(model.good), compressor(model.bad))
        for part in parts:
            yield pd.Series(scored(part.tolist(), model, tools))

    return docs.withColumn("score", score("text"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = classify(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op12_quality_classifier": op12_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
