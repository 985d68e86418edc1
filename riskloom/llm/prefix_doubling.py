"""Plain distributed prefix doubling: the repeated windows of operator 10, by ranks of every byte position.

Positions start with the rank of their first FIRST bytes.  In each round a position's rank pair is its own rank and that of the position one
length on; pairs are sorted, equal pairs get one rank, and positions whose pair is unique drop out, since no longer string there recurs.
Lengths double until the last pair, which overlaps itself, spans LENGTH bytes.

It moves every position several times a round and is here as the measure and the check of ``suffix_dedup``; see the README for figures.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import by_value
from riskloom.llm.suffix_dedup import LENGTH, numbered
from riskloom.operators.dealt import placed
from riskloom.session import materialize

FIRST = 4

by_value(__name__)


def starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(did, tag, text) to (did, tag, i, r): every place and its first FIRST bytes as a number."""
    for frame in frames:
        for did, tag, text in zip(frame["did"], frame["tag"], frame["text"], strict=True):
            data = np.frombuffer(text, np.uint8).astype(np.int64)
            n = len(data) - FIRST + 1
            if len(data) >= LENGTH:
                r = sum(data[j : j + n] << 8 * (FIRST - 1 - j) for j in range(FIRST))
                yield pd.DataFrame({"did": did, "tag": tag, "i": np.arange(n), "r": r})


def reranked(ranks: DataFrame, step: int) -> DataFrame:
    """Ranks of strings ``step`` bytes longer: pairs (rank at i, rank at i + step), sorted; unique ones drop out."""
    ahead = ranks.select("did", "tag", (F.col("i") - step).alias("i"), F.col("r").alias("r2"))
    pairs = materialize(ranks.join(ahead, ["did", "tag", "i"]).select("did", "tag", "i", F.struct("r", "r2").alias("pair")), "pairs")
    return materialize(placed(pairs, "pair").where("equal > 1").select("did", "tag", "i", (F.col("upto") - F.col("equal")).alias("r")), "ranks")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """did, tag and i of every window of LENGTH bytes that also starts earlier."""
    texts = numbered(docs).select("did", "tag", "text").distinct()
    ranks, length = materialize(texts.mapInPandas(starts, "did long, tag long, i long, r long"), "ranks"), FIRST
    while length < LENGTH:
        step = min(length, LENGTH - length)
        ranks, length = reranked(ranks, step), length + step
    order = Window.partitionBy("r").orderBy("did", "tag", "i")
    return ranks.withColumn("k", F.row_number().over(order)).where("k > 1").select("did", "tag", "i")
