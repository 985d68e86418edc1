r"""Operator 11, ranked lexical search: Block-Max MaxScore over shards of documents.

``build`` deals documents into shards of bounded size, where they lie, and writes for each shard and term one list: documents and term
frequencies in compressed blocks, and per block its last document, its place and its best (frequency, length) pairs: those that no other
posting of the block beats in both.  From these pairs the highest score of a block follows under any collection statistics, so an index
takes more shards without being written anew.

``search`` sends the items' terms to every shard.  There the lists are read by falling bound; those that could lift an unseen document over
the k-th best score so far are essential.  On the others only candidates are looked up, and candidates whose score and block maximum cannot
reach that score are dropped before the block is decompressed.  The shards' best are merged.

Defined results: a null or wordless text has no term, counts nowhere and is never found; repeated rows and rows that share a doc_id are
documents of their own; equal scores go by doc_id, null last; items without terms, or whose terms no document holds, have no rows; equal
items are one, items that share an item_id are ranked apart; empty tables give an empty result; very long texts are read whole, in a shard
with others or of their own; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import by_value
from riskloom.session import fresh_path, materialize, table, written

#: Postings in a block; postings and documents in a shard; lists handed to Spark at once.
BLOCK, MOST_POSTINGS, MOST_DOCS, MOST_LISTS = 128, 1 << 20, 1 << 16, 1 << 14
#: Items and characters of items sent to the shards at once.
MOST_ITEMS, MOST_CHARS = 1000, 1 << 24
TOP = 10

INDEX = "shard long, term string, df long, meta binary, postings binary, n_docs long, n_terms long, ids binary, lengths binary"
FOUND = "item long, doc_id long, score long, decoded long, blocks long"

#: A-Z are lower-cased, other ASCII characters but letters and digits part terms; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))

by_value(__name__)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positive numbers as bytes of seven bits, low first, the last with its high bit set; and each number's count of bytes."""
    size = np.ones(len(values), np.int64)
    for k in range(1, 5):
        size += values >> 7 * k > 0
    out = np.empty(int(size.sum()), np.uint8)
    ends = np.cumsum(size)
    for k in range(5):
        has = size > k
        out[(ends - size + k)[has]] = values[has] >> 7 * k & 127
    out[ends - 1] |= 128
    return out, size


def unpacked(raw: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(raw & 128)
    starts = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts) if len(last) else np.empty(0, np.int64)


class Shard:
    """Documents gathered until they are written as lists."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict()
        self.vocabulary.default_factory = self.vocabulary.__len__
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[list[int]] = []
        self.counts: list[list[int]] = []
        self.postings = 0

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.terms.append(np.fromiter(map(self.vocabulary.__getitem__, counts), np.int64, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.postings += len(counts)

    def rows(self, shard: int) -> Iterator[pd.DataFrame]:
        """One row per term, and one without a term for the documents, in the order of their ids; some thousand rows at once."""
        none = np.array([i is None for i in self.ids])
        ids, lengths = np.array([0 if i is None else i for i in self.ids], np.int64), np.array(self.lengths, np.int64)
        order = np.lexsort((lengths, ids, none))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, tf = np.concatenate(self.terms), np.concatenate(self.counts)
        doc = np.repeat(place, [len(t) for t in self.terms])
        by = np.lexsort((doc, term))
        term, doc, tf = term[by], doc[by], tf[by]
        length = lengths[order][doc]
        head = np.flatnonzero(np.diff(term, prepend=-1))  # of a term
        df = np.diff(np.append(head, len(term)))
        inside = np.arange(len(term)) - np.repeat(head, df)
        start = inside % BLOCK == 0
        block = np.cumsum(start) - 1
        first = np.flatnonzero(start)
        last = doc[np.append(first[1:], len(doc)) - 1]
        gap = np.diff(doc, prepend=-1)
        gap[first] = doc[first] + 1
        raw, size = packed(np.stack([gap, tf], 1).ravel())
        bytes_end = np.cumsum(size)[2 * np.append(first[1:], len(doc)) - 1]
        # The best pairs: by length, those whose frequency exceeds that of all shorter ones of the block.
        o = np.lexsort((-tf, length, block))
        key = (block[o] << 32) + tf[o]
        best = o[np.append(True, key[1:] > np.maximum.accumulate(key)[:-1])]
        pairs_end = np.cumsum(np.bincount(block[best], minlength=len(first)))
        pair_tf, pair_n = tf[best].astype("<i4"), length[best].astype("<i4")
        # A term's blocks, bytes and pairs.
        block_end = np.cumsum(-(-df // BLOCK))
        names, b0 = list(self.vocabulary), 0
        heads = term[head]
        del term, doc, tf, by, gap, key, o, best, block, inside
        own = {"n_docs": len(ids), "n_terms": int(lengths.sum()), "ids": ids[order].astype("<i8").tobytes() + none[order].tobytes(), "lengths": lengths[order].astype("<i8").tobytes()}
        yield pd.DataFrame([{"shard": shard, "term": None, "df": None, "meta": None, "postings": None, **own}]).astype({"df": "Int64"})
        for at in range(0, len(heads), MOST_LISTS):
            part, out = slice(at, at + MOST_LISTS), []
            for name, n, b1 in zip(heads[part].tolist(), df[part].tolist(), block_end[part].tolist(), strict=True):
                r0, p0 = (bytes_end[b0 - 1], pairs_end[b0 - 1]) if b0 else (0, 0)
                r1, p1 = bytes_end[b1 - 1], pairs_end[b1 - 1]
                meta = np.concatenate([[b1 - b0], last[b0:b1], bytes_end[b0:b1] - r0, pairs_end[b0:b1] - p0]).astype("<i4").tobytes() + pair_tf[p0:p1].tobytes() + pair_n[p0:p1].tobytes()
                out.append((shard, names[name].decode("utf-8", "replace"), n, meta, raw[r0:r1].tobytes(), None, None, None, None))
                b0 = b1
            yield pd.DataFrame(out, columns=["shard", "term", "df", "meta", "postings", "n_docs", "n_terms", "ids", "lengths"]).astype({"n_docs": "Int64", "n_terms": "Int64"})


def indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's documents as shards."""
    own, shard, n = TaskContext.get().partitionId() << 24, Shard(), 0
    for frame in frames:
        for text, i, none in zip(frame["text"], frame["doc_id"].fillna(0).astype("int64").tolist(), frame["doc_id"].isna().tolist(), strict=True):
            words = terms_of(text)
            if not words:
                continue
            shard.add(None if none else i, words)
            if shard.postings >= MOST_POSTINGS or len(shard.ids) >= MOST_DOCS:
                yield from shard.rows(own + n)
                shard, n = Shard(), n + 1
    if shard.ids:
        yield from shard.rows(own + n)


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """An index of the documents (doc_id, text), written to ``path`` or to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInPandas(indexed, INDEX)
    return written(rows, path or fresh_path(docs.sparkSession, "index"))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class List:
    """A term's blocks in one shard; nothing is decompressed until it is asked for."""

    def __init__(self, meta: bytes, postings: bytes, m_of) -> None:
        numbers = np.frombuffer(meta, "<i4").astype(np.int64)
        n = int(numbers[0])
        self.last, self.ends, pair_ends = numbers[1 : 1 + n], numbers[1 + n : 1 + 2 * n], numbers[1 + 2 * n : 1 + 3 * n]
        tf, length = np.split(numbers[1 + 3 * n :], 2)
        self.most = np.maximum.reduceat(impact(tf, m_of(length)), np.append(0, pair_ends[:-1]))
        self.raw = np.frombuffer(postings, np.uint8)
        self.top = int(self.most.max())

    def decoded(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents and frequencies of some blocks, in order."""
        begin = np.append(0, self.ends[:-1])
        if len(blocks) == len(self.ends):
            raw, counts = self.raw, self.ends - begin
        else:
            raw = np.concatenate([self.raw[begin[b] : self.ends[b]] for b in blocks.tolist()])
            counts = (self.ends - begin)[blocks]
        values = unpacked(raw).reshape(-1, 2)
        upto = np.cumsum(np.add.reduceat((raw >> 7).astype(np.int64), np.append(0, np.cumsum(counts)[:-1]))) // 2  # numbers in pairs
        total = np.cumsum(values[:, 0])
        before = np.append(0, total[upto[:-1] - 1])  # each block counts from the shard's first document
        return total - np.repeat(before, np.diff(upto, prepend=0)) - 1, values[:, 1]


def best(lists: list[tuple[int, List]], m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The ``k`` best documents by (score, place), their scores, and how many of how many blocks were decompressed."""
    lists = sorted(lists, key=lambda x: -x[0] * x[1].top)
    rest = np.cumsum([0, *[w * x.top for w, x in reversed(lists)]])[::-1].tolist()  # what this list and all after it can add
    docs, scores, least, opened = np.empty(0, np.int64), np.empty(0, np.int64), 1, 0
    for j, (w, own) in enumerate(lists):
        keep = scores + rest[j] >= least
        docs, scores = docs[keep], scores[keep]
        at = np.searchsorted(own.last, docs)
        inside = at < len(own.last)
        reach = scores + rest[j + 1]
        reach[inside] += w * own.most[at[inside]]
        keep = reach >= least  # by the block's maximum, before it is decompressed
        docs, scores, at, inside = docs[keep], scores[keep], at[keep], inside[keep]
        wanted = np.zeros(len(own.last), bool)
        wanted[at[inside]] = True
        if rest[j] >= least:  # essential: documents not seen yet may still be among the best
            wanted |= w * own.most + rest[j + 1] >= least
        blocks = np.flatnonzero(wanted)
        opened += len(blocks)
        if len(blocks):
            found, tf = own.decoded(blocks)
            gain = w * impact(tf, m[found])
            place = np.searchsorted(found, docs)
            place[place == len(found)] = 0
            seen = found[place] == docs
            scores[seen] += gain[place[seen]]
            if rest[j] >= least:
                new = np.ones(len(found), bool)
                new[place[seen]] = False
                docs, scores = np.concatenate([docs, found[new]]), np.concatenate([scores, gain[new]])
                order = np.argsort(docs, kind="stable")
                docs, scores = docs[order], scores[order]
        if len(scores) >= k:
            least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
    order = np.lexsort((docs, -scores))[:k]
    order = order[scores[order] > 0]
    return docs[order], scores[order], opened, sum(len(x.last) for _, x in lists)


def searched(frames: Iterator[pd.DataFrame], asked: dict, k: int) -> Iterator[pd.DataFrame]:
    """Rows of an index, sorted by shard, to each shard's ``k`` best documents of each item.  ``asked`` has N, L, weights of terms, and items."""
    n, total, weights, items = (asked[x] for x in ("N", "L", "weights", "items"))

    def m_of(length: np.ndarray) -> np.ndarray:
        return 10 + 90 * length * n // total

    def shard(rows: list[tuple]) -> pd.DataFrame:
        (ids, lengths), lists = next((x[4:] for x in rows if x[1] is None), (b"", b"")), {}
        lengths = np.frombuffer(lengths, "<i8")
        ids, none = np.frombuffer(ids[: 8 * len(lengths)], "<i8"), np.frombuffer(ids[8 * len(lengths) :], bool)
        m = m_of(lengths)
        for _, term, meta, postings, *_ in rows:
            if term is not None:
                lists[term] = List(meta, postings, m_of)
        out = []
        for item, terms in items:
            docs, scores, opened, blocks = best([(weights[t], lists[t]) for t in terms if t in lists], m, k)
            out += [(item, None if none[d] else int(ids[d]), s, opened, blocks) for d, s in zip(docs.tolist(), scores.tolist(), strict=True)]
        found = pd.DataFrame(out, columns=["item", "doc_id", "score", "decoded", "blocks"])
        return found.astype({"doc_id": "Int64"})

    held: list[tuple] = []
    for frame in frames:
        for row in frame.itertuples(index=False, name=None):
            if held and row[0] != held[0][0]:
                yield shard(held)
                held = []
            held.append(row)
    if held:
        yield shard(held)


def queried(queries: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """item_id and distinct terms of all items, in lists of bounded size."""
    rows = queries.select(F.col("item_id"), F.col("text")).where("text is not null").distinct()
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-2 * n // MOST_ITEMS), -(-2 * chars // MOST_CHARS))
    for part in range(parts):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        distinct = {(r.item_id, tuple(sorted(t.decode("utf-8", "replace") for t in set(terms_of(r.text))))) for r in some}
        yield [(i, list(terms)) for i, terms in sorted(distinct, key=lambda x: (x[0] is None, x[0] or 0, x[1])) if terms]


def ranked(index: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """item (its number), item_id, rank, doc_id and score of the ``k`` best documents of each row of ``queries`` (item_id, text)."""
    spark = index.sparkSession
    n, total = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    first, parts = 0, []
    for items in queried(queries):
        terms = spark.createDataFrame([(t,) for t in sorted({t for _, own in items for t in own})], "asked string")
        lists = index.join(F.broadcast(terms), F.col("term") == F.col("asked"), "left_semi")  # at most MOST_CHARS characters
        df = {r[0]: r[1] for r in lists.groupBy("term").agg(F.sum("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
        asked = {"N": n, "L": total, "weights": weights, "items": [(first + j, [t for t in own if weights.get(t)]) for j, (_, own) in enumerate(items)]}
        shared = spark.sparkContext.broadcast(asked)

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            return searched(frames, shared.value, k)

        rows = lists.unionByName(index.where("term is null")).select("shard", "term", "meta", "postings", "ids", "lengths")
        found = rows.repartition("shard").sortWithinPartitions("shard").mapInPandas(run, FOUND)
        names = spark.createDataFrame([(first + j, i) for j, (i, _) in enumerate(items)], "item long, item_id " + queries.schema["item_id"].dataType.simpleString())
        parts.append(materialize(found, "found").join(F.broadcast(names), "item"))  # at most MOST_ITEMS rows
        first += len(items)
    both = reduce(DataFrame.unionByName, parts)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build(table(spark, sf_dir, "documents"))
    return ranked(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_CLASS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
QUERIES = {"op11_ranked_search": op11_ranked_search}
ORACLE_SQL = {
    "op11_ranked_search": rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLD}, '{_CLASS}') AS w FROM documents),
q AS MATERIALIZED (SELECT DISTINCT item_id, list_sort(list_distinct(regexp_extract_all({_FOLD}, '{_CLASS}'))) AS w FROM benchmark),
i AS MATERIALIZED (SELECT row_number() OVER () AS i, item_id, w FROM q),
n AS MATERIALIZED (SELECT r, doc_id, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
total AS MATERIALIZED (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM n),
p AS MATERIALIZED (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
v AS MATERIALIZED (SELECT t, floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, total GROUP BY t),
s AS (SELECT i, item_id, r, sum(v.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n.n * docs) // terms))))::BIGINT AS score, any_value(doc_id) AS doc_id
    FROM (SELECT i, item_id, unnest(w) AS t FROM i) JOIN v USING (t) JOIN p USING (t) JOIN n USING (r), total GROUP BY i, item_id, r),
o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k FROM s WHERE score > 0)
SELECT item_id, k::INT AS rank, doc_id, score FROM o WHERE k <= 10"""
}
