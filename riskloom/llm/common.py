"""What the training-data operators share: word splitting, Arrow batches, sorted runs."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space between words.
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def by_value(module: str) -> None:
    """Send this module's functions to executors inside the job, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


by_value(__name__)


def words(text: Column) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; where a text has no other letters the plain function does the same, faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def identity(text: str = "text") -> list[Column]:
    """_id, _a and _b: rows with one doc_id, null ones too, are told apart by 128 bits of their text's hashes."""
    return [F.col("doc_id").alias("_id"), F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(7), text).alias("_b")]


def same(left: DataFrame, right: DataFrame) -> Column:
    """Two rows with the columns of ``identity`` are of one document."""
    return left["_id"].eqNullSafe(right["_id"]) & (left["_a"] == right["_a"]) & (left["_b"] == right["_b"])


def with_row(docs: DataFrame) -> DataFrame:
    """The whole row of ``docs`` as the struct ``row``, whatever its columns are called, and its identity."""
    return docs.select(F.struct("*").alias("row"), *identity())


def row_hash(docs: DataFrame) -> Column:
    """_r, a hash of all columns (which must not be maps): puts documents that differ only elsewhere in a fixed order."""
    return F.xxhash64(*[docs[c] for c in docs.columns]).alias("_r")


#: Hashes of texts are broadcast up to this many, 8 bytes each (about 100 MB in a task's memory).
MOST_HASHES = 4_000_000


def renewed(df: DataFrame) -> DataFrame:
    """The same table under columns of its own, to join it where it is in the plan already."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def only(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` whose text hash _a is in ``asked``, a written table; all of them if that has over MOST_HASHES rows.  What a join with ``asked`` would
    drop need not be moved for it."""
    if asked.count() > MOST_HASHES:
        return rows
    return rows.join(F.broadcast(asked.select(F.col("_a").alias("asked")).distinct()), F.col("_a") == F.col("asked"), "left_semi")


def once(docs: DataFrame, chosen: DataFrame, *more: str) -> DataFrame:
    """row (a struct) and ``more`` for each row of ``chosen``, a written table (_id, _a, _b, _r, the number ``rows`` of rows with these, and ``more``): one row
    of ``docs`` each, however many equal ones there are."""
    keyed = docs.select(F.struct("*").alias("row"), *identity(), row_hash(docs))
    keys = ["_id", "_a", "_b", "_r"]

    def matching(left: DataFrame, which: DataFrame) -> DataFrame:
        # ``which`` grows with the documents: it is never broadcast
        return left.join(which.hint("merge"), same(left, which) & (left["_r"] == which["_r"])).select("row", *[left[k] for k in keys], *more)

    repeated = chosen.where("rows > 1")
    if repeated.isEmpty():
        return matching(keyed, chosen).select("row", *more)
    several = matching(only(keyed, repeated), renewed(repeated)).dropDuplicates(keys)
    return matching(keyed, chosen.where("rows = 1")).unionByName(several).select("row", *more)


#: No more keys than this are hot: those with over this part of all rows.
SHARES = 1000


def looked_up(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) with the columns of ``facts``, a written table with one row for each ``key`` and the number ``n`` of its rows.
    Keys with more than one row in SHARES are at most SHARES, so they are broadcast; no key of the shuffled rest is large."""
    if facts.count() <= SHARES:
        return rows.join(F.broadcast(facts.drop("n")), key)
    hot, cold = facts.where(F.col("n") * SHARES > total).drop("n"), facts.where(F.col("n") * SHARES <= total).drop("n")
    if hot.isEmpty():
        return rows.join(cold, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def chunks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to ``most`` or which are one item."""
    start, total, stop = 0, 0, 0
    for stop, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield start, stop - 1
            start, total = stop - 1, 0
        total += size
    if stop > start:
        yield start, stop


def by_runs(frames: Iterable, keys: list[str], least: int = 1 << 16) -> Iterator:
    """Joins the pandas frames of a partition sorted by ``keys`` and cuts them only where a key ends."""
    import pandas as pd

    held: list = []
    rows = 0
    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows < least:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        last = np.ones(len(whole), bool)
        for key in keys:
            column = whole[key].to_numpy()
            last &= column == column[-1]
        cut = len(whole) - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
        held = [whole.iloc[cut:].reset_index(drop=True)]
        rows = len(held[0]) if cut else rows
        least = max(least, 2 * len(held[0]))
    if held and rows:
        rest = pd.concat(held, ignore_index=True)
        if len(rest):
            yield rest
