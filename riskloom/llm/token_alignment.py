"""Operator 13, cross-tokenizer alignment: interval coalescing.

Tokens A and B of a text are byte ranges of space + text.  All of them are put in order by start, the running maximum of their ends is taken, and a group
breaks where a start reaches it: there both tokenizers end a token.  Within a group every A token is linked to every B token.

A first pass encodes all texts once and writes per document its figures and its distinct id pairs with their numbers of links; pairs are those of
the distinct ids of each group, so a long stretch where the tokenizers disagree costs its distinct ids, not its tokens squared.  Pairs of a very long
text go to several rows, cut by A id, and remain distinct.  The second pass counts the documents of each pair, combined in each task first.  The third
gives each document its pairs' counts: by a broadcast of the counts if there are at most MOST_PAIRS, else by a join.

Tokenizer files are parameters; their bytes (a few MB) are sent to executors, which need no files.  A byte-level vocabulary whose ids follow the order
of its merges is run by the faster of the two libraries that read it; any other by the library of its own format.

Defined results: null and empty texts, and those that either tokenizer doesn't give back byte for byte, have no tokens: zeros and an empty hash;
repeated rows each count as a document and get a result of their own, as do rows that share a doc_id or have none; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import by_value, chunks, looked_up
from riskloom.session import materialize, table

#: Characters of texts aligned at once, pairs made at once, and pairs whose counts are broadcast (13 bytes each).
MOST_TEXT, MOST_MADE, MOST_PAIRS = 1 << 20, 1 << 21, 1 << 22
# Fixed value: how a byte-level tokenizer of the given vocabulary parts words.
PARTS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENCODED = "row long, doc_id long, part int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, links binary"

by_value(__name__)


def byte_level() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """A byte-level vocabulary (JSON): ids of a text, and the bytes of each id."""

    def __init__(self, content: bytes, plain: bool = False) -> None:
        said = json.loads(content)
        of, vocabulary = byte_level(), said["model"]["vocab"]
        self.pieces = [b""] * (1 + max([*vocabulary.values(), *[x["id"] for x in said.get("added_tokens", [])]]))
        for token, i in vocabulary.items():
            self.pieces[i] = bytes(of[c] for c in token)
        before = said.get("pre_tokenizer") or {}
        ordered = len(set(vocabulary.values())) == len(vocabulary) and all(vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] == 256 + k for k, m in enumerate(said["model"]["merges"]))
        if ordered and not plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not said.get("normalizer"):
            import tiktoken

            own = tiktoken.Encoding("own", pat_str=PARTS, mergeable_ranks={self.pieces[i]: i for i in vocabulary.values()}, special_tokens={})
            self.encode = lambda texts: [own.encode_ordinary(t) for t in texts]
        else:
            import tokenizers

            other = tokenizers.Tokenizer.from_str(content.decode())
            other.encode_special_tokens = True
            self.encode = lambda texts: [other.encode(t, add_special_tokens=False).ids for t in texts]


class Pieces:
    """A sentence-piece model: ids of a text, to which it adds a space, and the bytes of each id."""

    def __init__(self, content: bytes) -> None:
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.encode = lambda texts: own.encode(texts, num_threads=1)
        self.pieces = [bytes([int(p[3:5], 16)]) if own.is_byte(i) else b"" if own.is_control(i) or own.is_unknown(i) else p.replace("▁", " ").encode() for i, p in ((i, own.id_to_piece(i)) for i in range(own.vocab_size()))]


def ranges(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of some lengths, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def coalesced(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B interval, from 0 on."""
    start, end = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(np.append(False, start[order][1:] >= reach[:-1]))
    return group[: len(start_a)], group[len(start_a) :]


def small(values: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs."""
    most = int(values.max()) if len(values) else 0
    return values.astype("<u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.empty(0, np.int64)


def written_pairs(pairs: np.ndarray) -> bytes:
    """Ascending numbers as their steps, after the first."""
    first = int(pairs[0]) if len(pairs) else 0
    return first.to_bytes(8, "little") + len(pairs).to_bytes(4, "little") + small(np.diff(pairs))


def read_pairs(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[8:12], "little")
    return np.cumsum(np.append(int.from_bytes(raw[:8], "little"), numbers(raw[12:], n - 1))) if n else np.empty(0, np.int64)


class Aligner:
    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b, self.base = a, b, len(b.pieces)
        self.size_a, self.size_b = (np.array([len(p) for p in x.pieces], np.int64) for x in (a, b))
        self.said_a = [np.array([f"{i}{mark}" for i in range(len(a.pieces))], object) for mark in (",", "|")]
        self.said_b = [np.array([f"{i}{mark}" for i in range(len(b.pieces))], object) for mark in (",", ";")]

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both; none for a text that either doesn't give back."""
        own = [t or "" for t in texts]
        both = self.a.encode([" " + t for t in own]), self.b.encode(own)
        for k, text in enumerate(own):
            want = b" " + text.encode("utf-8", "surrogatepass")
            if not text or any(b"".join(map(x.pieces.__getitem__, ids[k])) != want for x, ids in ((self.a, both[0]), (self.b, both[1]))):
                both[0][k], both[1][k] = [], []
        return both

    def align(self, texts: list[str | None]) -> Iterator[tuple]:
        """(index of the text, part, n_a, n_b, n_groups, n_links, hash, pairs, links); part 0 has the figures, further parts only pairs."""
        all_a, all_b = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in ids], np.int64) for ids in (all_a, all_b))
        a, b = (np.array([i for x in ids for i in x], np.int64) for ids in (all_a, all_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # texts one after the other
        group_a, group_b = coalesced(end_a - self.size_a[a], end_a, end_b - self.size_b[b], end_b)
        doc_a = np.repeat(np.arange(len(texts)), n_a)
        n = int(group_a[-1]) + 1 if len(group_a) else 0
        doc = np.empty(n, np.int64)
        doc[group_a] = doc_a
        links = np.bincount(doc, np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n).astype(float), len(texts)).round().astype(np.int64)
        n_groups = np.bincount(doc, minlength=len(texts))
        hashes = self._hashes(a, b, group_a, group_b, n_a + n_b)
        made = self._pairs(a, b, group_a, group_b, doc)
        for k in range(len(texts)):
            parts = made.get(k) or [(np.empty(0, np.int64), np.empty(0, np.int64))]
            for part, (pairs, times) in enumerate(parts):
                figures = (int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(links[k]), hashes[k]) if not part else (None,) * 5
                yield k, part, *figures, written_pairs(pairs), small(times)

    def _hashes(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Groups in order, A tokens first: an A token that ends its group's is followed by a bar, a B token by a semicolon."""
        last_a, last_b = (np.append(np.diff(g) > 0, True) if len(g) else np.empty(0, bool) for g in (group_a, group_b))
        said = np.concatenate([np.where(last_a, self.said_a[1][a], self.said_a[0][a]), np.where(last_b, self.said_b[1][b], self.said_b[0][b])])
        order = np.lexsort((np.repeat([0, 1], [len(a), len(b)]), np.concatenate([group_a, group_b])))
        pieces, ends = said[order].tolist(), np.cumsum(sizes).tolist()
        return [hashlib.sha256("".join(pieces[e - s : e])[:-1].encode()).hexdigest() if s else "" for s, e in zip(sizes.tolist(), ends, strict=True)]

    def _pairs(self, a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc: np.ndarray) -> dict[int, list]:
        """For each text, its distinct pairs (A id * base + B id), ascending, and the number of links of each."""
        out: dict[int, list] = {}
        if not len(a):
            return out
        width = max(len(self.a.pieces), self.base)
        (key_a, times_a), (key_b, times_b) = (np.unique(g * width + x, return_counts=True) for g, x in ((group_a, a), (group_b, b)))
        group, id_a, id_b = key_a // width, key_a % width, key_b % width
        first = np.searchsorted(key_b, np.arange(len(doc)) * width)
        many = np.diff(np.append(first, len(key_b)))
        order = np.lexsort((id_a, doc[group]))
        group, id_a, times_a = group[order], id_a[order], times_a[order]
        owner, made = doc[group], np.cumsum(many[group])
        begin = 0
        while begin < len(group):
            # as many rows as make MOST_MADE pairs, up to where the text or its A id changes
            end = int(np.searchsorted(made, (made[begin - 1] if begin else 0) + MOST_MADE, "right"))
            end = max(end, begin + 1)
            while end < len(group) and owner[end] == owner[end - 1] and id_a[end] == id_a[end - 1]:
                end += 1
            g = group[begin:end]
            at = np.repeat(first[g], many[g]) + ranges(many[g])
            pair = np.repeat(id_a[begin:end], many[g]) * self.base + id_b[at]
            key = np.repeat(owner[begin:end] - owner[begin], many[g]) * (width * self.base) + pair
            times = np.repeat(times_a[begin:end], many[g]) * times_b[at]
            by = np.argsort(key, kind="stable")
            key, times = key[by], times[by]
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, times = key[head], np.add.reduceat(times, head)
            whose, pair = key // (width * self.base) + owner[begin], key % (width * self.base)
            cut = np.flatnonzero(np.append(True, whose[1:] != whose[:-1])).tolist()
            for x, y in zip(cut, [*cut[1:], len(whose)], strict=True):
                out.setdefault(int(whose[x]), []).append((pair[x:y], times[x:y]))
            begin = end
        return out


def content(spark: SparkSession, path: str) -> bytes:
    """A file's bytes: of a local path on the driver, or of any that Spark reads."""
    if "://" not in path:
        with open(path, "rb") as file:
            return file.read()
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def encoded(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Figures and pairs of every row of ``docs``, written once."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((content(spark, a_file), content(spark, b_file)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = shared.value
        own = Aligner(ByteLevel(a), Pieces(b))
        for frame in frames:
            texts = frame["text"].tolist()
            for x, y in chunks([len(t or "") + 1 for t in texts], MOST_TEXT):
                rows = list(own.align(texts[x:y]))
                part = frame.iloc[[x + r[0] for r in rows]][["row", "doc_id"]].reset_index(drop=True)
                rest = pd.DataFrame([r[1:] for r in rows], columns=["part", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])
                for c in ("n_a", "n_b", "n_groups", "n_links"):
                    rest[c] = rest[c].astype("Int64")
                part["doc_id"] = part["doc_id"].astype("Int64")
                yield pd.concat([part, rest], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(rows.mapInPandas(run, ENCODED), "encoded")


def document_counts(found: DataFrame) -> DataFrame:
    """pair and n, the number of documents that hold it linked; written."""

    def combined(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for frame in frames:
            held += [read_pairs(p) for p in frame["pairs"]]
            rows = sum(map(len, held))
            if rows > MOST_MADE:
                pair, n = np.unique(np.concatenate(held), return_counts=True)
                held = []
                yield pd.DataFrame({"pair": pair, "n": n})
        if held:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"pair": pair, "n": n})

    return materialize(found.select("pairs").mapInPandas(combined, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pair_counts")


def aligned(docs: DataFrame, a_file: str, b_file: str, most: int = MOST_PAIRS) -> DataFrame:
    """Every row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    spark = docs.sparkSession
    found = encoded(docs, a_file, b_file)
    base = len(Pieces(content(spark, b_file)).pieces)
    counts = document_counts(found)
    per_a = Window.partitionBy("a")  # no more rows than the B vocabulary has ids
    counts = materialize(counts.withColumn("a", F.expr(f"pair div {base}")).withColumn("best", F.col("n") == F.max("n").over(per_a)).select("pair", "n", "best"), "pair_facts")
    if counts.count() <= most:
        rows = counts.toPandas().sort_values("pair")
        shared = spark.sparkContext.broadcast((rows["pair"].to_numpy(), rows["n"].to_numpy(np.uint32 if (rows["n"] < 1 << 32).all() else np.int64), rows["best"].to_numpy(bool)))

        def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pair, n, best = shared.value
            for frame in frames:
                out = []
                for raw, times in zip(frame["pairs"], frame["links"], strict=True):
                    own = read_pairs(raw)
                    times, at = numbers(times, len(own)), np.searchsorted(pair, own)
                    out.append((int(times[best[at]].sum()), int((times * n[at].astype(np.int64)).sum())))
                yield pd.concat([frame[["row"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_best", "count_sum"], dtype="int64")], axis=1)

        sums = found.select("row", "pairs", "links").mapInPandas(summed, "row long, n_best long, count_sum long")
    else:

        def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for row, raw, times in zip(frame["row"], frame["pairs"], frame["links"], strict=True):
                    own = read_pairs(raw)
                    yield pd.DataFrame({"row": np.full(len(own), row), "pair": own, "times": numbers(times, len(own))})

        rows = found.select("row", "pairs", "links").mapInPandas(listed, "row long, pair long, times long")
        total = counts.agg(F.sum("n")).first()[0]
        facts = materialize(counts.withColumn("count", F.col("n")), "pair_counts")
        joined = looked_up(rows, facts, "pair", total)
        sums = joined.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    figures = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = found.select("row", *figures, (F.col("part") == 0).alias("head"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    none = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in figures]
    both = own.where("head").unionByName(sums.select("row", *none, F.lit(False).alias("head"), "n_best", "count_sum"))
    per = both.groupBy("row").agg(*[F.max(F.when(F.col("head"), F.col(c))).alias(c) for c in figures], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return per.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_token_alignment": op13_token_alignment}
ORACLE_SQL: dict[str, str] = {}
