"""Operator 4, SimHash near-dedup: pigeonhole blocks.

Two fingerprints that differ in at most 3 of 64 bits agree on at least m - 3 of m blocks.  Rows of distinct fingerprints are
dealt by every choice of m - 3 blocks, m growing with the number of fingerprints so that a key holds few of them; a key that
still holds many is split again by four blocks of its free bits.  Within a key, numpy verifies Hamming distances and
returns a spanning forest, never all pairs.  Equal fingerprints are one class before that.

Fingerprints and components that hold a large part of all rows are joined by broadcast (``looked_up``), at most some thousands of them.

Defined results: null and empty texts have fingerprint zero and link like any other; a null doc_id links like any other,
and a component of nulls alone has a null id; repeated rows share a class; an empty table gives an empty result; very long texts are
hashed 65,536 shingles at once; other columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import by_runs, by_value, identity, looked_up, once, row_hash
from riskloom.llm.components import components
from riskloom.session import materialize, table

BITS, NEAR, SEED, SHINGLE = 64, 3, 42, 3
#: Mean and largest number of fingerprints under one key.
MEAN, MOST = 256, 4096

by_value(__name__)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half of the shingles' hashes."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    ends = (ends - 1).tolist()
    digest = xxhash.xxh64_digest
    n = max(len(words) - shingle + 1, 1)
    stops = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at : min(at + (1 << 16), n)], stops[at : at + (1 << 16)], strict=True)])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.frombuffer(np.packbits(2 * ones > n).tobytes(), ">i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """_id, _a, _b, _r (the row) and fp, the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return docs.select(*identity(), row_hash(docs), fp("text").alias("fp"))


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def cut(bits: list[int], parts: int) -> list[int]:
    """The bits dealt to ``parts`` masks of about equal size."""
    return [sum(1 << b for b in bits[k * len(bits) // parts : (k + 1) * len(bits) // parts]) for k in range(parts)]


def masks(n: int) -> list[int]:
    """All choices of m - 3 of m blocks, for the least m whose keys hold MEAN of ``n`` fingerprints on average."""
    for m in range(NEAR + 1, 9):
        if m == 8 or n >> (BITS * (m - NEAR) // m) <= MEAN:
            return [sum(c) for c in combinations(cut(list(range(BITS)), m), m - NEAR)]
    raise AssertionError


def refined(mask: int) -> list[int]:
    """The mask with each of four blocks of its free bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | x for x in cut(free, NEAR + 1)]


def dealt(classes: DataFrame, choices: list[int]) -> DataFrame:
    keys = F.array(*[F.struct(F.lit(signed(m)).cast("long").alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m)).cast("long")).alias("key")) for m in choices])
    return classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.mask", "k.key")


def forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (mask, key) to edges that span each key's near fingerprints."""
    for frame in by_runs(frames, ["mask", "key"]):
        fp = frame["fp"].to_numpy().view(np.uint64)
        new = np.ones(len(frame), bool)
        new[1:] = (np.diff(frame["mask"].to_numpy()) != 0) | (np.diff(frame["key"].to_numpy()) != 0)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        last = np.append(first[1:], len(frame))[group]  # the end of each row's key
        at, lag, label = np.arange(len(frame)), 0, np.arange(len(frame))
        while True:
            lag += 1
            at = at[at + lag < last[at]]
            if not len(at):
                break
            hit = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= NEAR]
            hit = hit[label[hit] != label[hit + lag]]
            if len(hit):
                label = _joined(label, hit, hit + lag)
            if lag & (lag - 1) == 0:  # keys that are one tree need no further look
                open_ = np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first)
                at = at[open_[group[at]]]
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            signed_fp = fp.view(np.int64)
            yield pd.DataFrame({"u": signed_fp[moved], "v": signed_fp[label[moved]]})


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (always a root) after links a-b."""
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while True:
            flat = label[label]
            if (flat == label).all():
                break
            label = flat


def _trees(rows: DataFrame) -> DataFrame:
    return rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInPandas(forest, "u long, v long")


def links(classes: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``, with the same closure as all pairs at most NEAR bits apart."""
    rows, out = dealt(classes, masks(classes.count())), []
    while True:
        rows = materialize(rows, "blocks")
        # A key over MOST is split by its free bits, which shrink by a quarter each time: at 20 free bits it holds 2^20 rows at most.
        hot = materialize(rows.groupBy("mask", "key").count().where(f"count > {MOST}").select("mask", "key"), "hot")
        wide = {r[0] for r in hot.select("mask").distinct().collect()}  # no more than there are masks
        deep = {m for m in wide if BITS - (m & (1 << BITS) - 1).bit_count() <= 20}
        if wide == deep:
            return reduce(DataFrame.unionByName, [*out, _trees(rows)])
        split = hot.where(~F.col("mask").isin(*deep)) if deep else hot
        out.append(_trees(rows.join(split, ["mask", "key"], "left_anti")))
        over = rows.join(split, ["mask", "key"], "left_semi")
        rows = reduce(DataFrame.unionByName, [dealt(over.where(F.col("mask") == m).select("fp"), refined(m & (1 << BITS) - 1)) for m in sorted(wide - deep)]).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """_id, _a, _b, _r, fp, component (a fingerprint) and component_id (the smallest doc_id in it) of every row."""
    fps = materialize(fingerprints(docs), "fingerprints")
    classes = materialize(fps.groupBy("fp").agg(F.min("_id").alias("least"), F.count("*").alias("n")), "classes")
    tree = components(links(classes.select("fp"))).withColumnRenamed("node", "fp")
    named = materialize(classes.join(tree, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    n_rows, n_classes = named.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ids = materialize(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n")), "component_ids")
    facts = materialize(looked_up(named.withColumnRenamed("n", "size"), ids, "component", n_classes).select("fp", "component", "component_id", F.col("size").alias("n")), "facts")
    return looked_up(fps, facts, "fp", n_rows).select("_id", "_a", "_b", "_r", "fp", "component", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest doc_id (a null one is last), where ids are shared by hashes of the text
    and then of the whole row."""
    keys = ["_id", "_a", "_b", "_r"]
    rows = near_duplicates(docs).groupBy("component", *keys).agg(F.count("*").alias("rows"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), *keys, "rows")).alias("f")).select("f.*")
    return once(docs, materialize(first, "firsts")).select("row.*")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLE_SQL: dict[str, str] = {}
