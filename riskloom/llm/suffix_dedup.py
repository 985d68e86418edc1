"""Operator 10, suffix dedup: anchor hashing in place of prefix doubling.

A byte goes if a string of LENGTH (100) bytes covers it that also starts earlier.  The method dealt, distributed prefix doubling, is
``prefix_doubling``: it ranks every byte position and moves many times the input in each round (README has measured figures), so it is not
the registered way; tests hold both against brute force.  Here positions are sampled so that no string is missed: of the 81 20-byte strings
within a 100-byte window the one with the least hash is its anchor, so equal windows have equal anchors at equal places.

1. Rank by 20 bytes: anchors are dealt and sorted by hash; an anchor whose 20 bytes are unique drops out with all its windows.
2. Rank by (20 bytes, whole context): where the bytes around two anchors agree throughout, all windows of the later one go.
3. Rank by 100 bytes: for the first of each remaining context, the windows on an anchor are ranked by (anchor, offset, 100-byte
   hash) in order of (doc_id, start); all but the first go.

Common passages.  An anchor that one Arrow batch holds CROWDED times is known to recur: its rows are dealt by (anchor, context), and
one marker per batch tells the anchor's other rows.  Of equal contexts in a batch only the first is dealt by key; the others go at once,
and travel by a random key.  In step 3 the windows of an anchor with over HOT open rows are dealt in slices of SLICE offsets by the hash
of the bytes that a slice's windows share, again only the first of equal ones per batch.  So what meets under one key does not follow
the size of the group.

Whole copies are found by SHA-256 first.  Texts are dealt by document once, into a bucketed table in the shared folder, and later
steps move only hashes, places and the contexts of step 3.

A document is (did, tag): its doc_id, and its place among the different texts that have this id (0 for an id of one text), in order of
128 bits of their hashes.

Defined results: null is empty; texts under 100 bytes keep all; a null doc_id is the smallest long; repeated rows (same id and text)
are one document and each get its result; rows that share an id but not a text, as those with null ids do, are ordered by a hash of the
text; other columns are ignored; an empty table gives an empty result; texts of any length are read whole, in pieces that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.common import by_runs, by_value, chunks, looked_up
from riskloom.operators.dealt import running
from riskloom.session import bucketed, materialize, table

LENGTH, GRAM = 100, 20
SPREAD = LENGTH - GRAM + 1
PIECE = 1 << 19
CROWDED, HOT, SLICE = 32, 20_000, 8
LEAST_ID = -(1 << 63)
POS_BITS, D_BITS = 32, 7
D_MASK, POS_MASK = (1 << D_BITS) - 1, (1 << POS_BITS) - 1

by_value(__name__)


class Hasher:
    """Polynomial hashes modulo 2^64 of any stretch of a byte array, from prefix sums; bytes are first sent to random odd words."""

    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    words = np.random.default_rng(20240101).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    def __init__(self, data: np.ndarray):
        if len(self.up) <= len(data):
            n = max(len(data) + 1, PIECE + 2 * LENGTH)
            for name, x in (("up", self.base), ("down", self.inverse)):
                powers = np.full(n, x, np.uint64)
                powers[0] = 1
                setattr(Hasher, name, np.cumprod(powers))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.words[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, size: int) -> np.ndarray:
        return mixed((self.sums[size:] - self.sums[:-size]) * self.down[: len(self.sums) - size])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the place of its first least one."""
    at, size = np.arange(len(values), dtype=np.int32), 1
    while size < width:
        step = min(size, width - size)
        n = len(values) - step
        later = values[step:] < values[:n]
        at, values = np.where(later, at[step:], at[:n]), np.where(later, values[step:], values[:n])
        size += step
    return at


def anchors(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in a buffer of documents at [begin, end): owner, first and last window, anchor, hash
    of its 20 bytes, hash of the whole context."""
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(data) < LENGTH:
        return none
    hasher = Hasher(data)
    grams = hasher.every(GRAM)
    place = first_least(grams, SPREAD)
    fits = np.zeros(len(place) + 1, np.int32)
    wide = end - begin >= LENGTH
    np.add.at(fits, begin[wide], 1)
    np.add.at(fits, end[wide] - LENGTH + 1, -1)
    ok = np.flatnonzero(np.cumsum(fits[:-1]) > 0)
    if not len(ok):
        return none
    new = np.ones(len(ok), bool)
    new[1:] = (place[ok[1:]] != place[ok[:-1]]) | (np.diff(ok) != 1)
    low = ok[new]
    high = ok[np.append(np.flatnonzero(new)[1:], len(ok)) - 1]
    x = place[low].astype(np.int64)
    context = hasher.of(low, high + LENGTH) ^ mixed(((x - low) << D_BITS | (x - high)).astype(np.uint64))
    owner = np.searchsorted(begin, low, side="right") - 1
    return owner, low, high, x, grams[x], context


def buffers(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, owner, begin, end, offset in the owner's text) of documents, or of pieces of long ones, side by side."""
    parts = [(k, a) for k, t in enumerate(texts) for a in range(0, max(len(t) - LENGTH + 1, 1), PIECE)]
    size = [min(len(texts[k]) - a, PIECE + LENGTH - 1) for k, a in parts]
    for i, j in chunks(size, PIECE):
        data = np.frombuffer(b"".join(texts[k][a : a + n] for (k, a), n in zip(parts[i:j], size[i:j], strict=True)), np.uint8)
        end = np.cumsum(size[i:j])
        yield data, np.array([k for k, _ in parts[i:j]]), end - size[i:j], end, np.array([a for _, a in parts[i:j]])


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Which rows are the first with their key; rows stand in the order that counts."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    out = np.zeros(len(order), bool)
    out[order[new]] = True  # lexsort is stable
    return out


def sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(did, tag, text) to anchors (k, h, c, did, tag, packed, state), dealt by k; packed holds the place of the anchor, and its offsets in
    its windows.  state: 0 to be ranked, 1 known to recur, 2 known to go as a whole, 3 a marker."""
    for frame in frames:
        did, tag, texts = frame["did"].to_numpy(), frame["tag"].to_numpy(), frame["text"].tolist()
        parts = []
        for data, owners, begin, end, offset in buffers(texts):
            # empty texts share their begin with the next one, and have no window
            some = end > begin
            owner, low, high, x, h, c = anchors(data, begin[some], end[some])
            who = owners[some][owner]
            place = x - begin[some][owner] + offset[some][owner]
            packed = place << (2 * D_BITS) | (x - low) << D_BITS | (x - high)
            parts.append((h, c, did[who], tag[who], packed))
        if not parts:
            continue
        h, c, who, tags, packed = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((packed, tags, who))
        h, c, who, tags, packed = h[order], c[order], who[order], tags[order], packed[order]
        values, at, n = np.unique(h, return_inverse=True, return_counts=True)
        crowded = n[at] >= CROWDED
        again = crowded & ~first_of(h, c)
        # a repeated row is the first itself
        same = np.zeros(len(h), bool)
        same[1:] = (who[1:] == who[:-1]) & (tags[1:] == tags[:-1]) & (packed[1:] == packed[:-1])
        state = np.where(again & ~same, 2, np.where(crowded, 1, 0))
        key = np.where(state == 2, spread(who, tags, packed), np.where(crowded, mixed(h ^ c), h))
        yield _anchors(key, h, c, who, tags, packed, state)
        marks = values[n >= CROWDED]
        if len(marks):
            none = np.zeros(len(marks), np.int64)
            yield _anchors(marks, marks, none.view(np.uint64), none, none, none, none + 3)


def _anchors(k: np.ndarray, h: np.ndarray, c: np.ndarray, did: np.ndarray, tag: np.ndarray, packed: np.ndarray, state: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"k": k.view(np.int64), "h": h.view(np.int64), "c": c.view(np.int64), "did": did, "tag": tag, "packed": packed, "state": state.astype("int32")})


def recurring(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Anchors sorted by (k, h, c, did, tag, packed) to those that matter: ``whole`` ones, all of whose windows occur earlier, and the first of
    each context where an anchor has several.  Keeps one row of state, however many rows share an anchor."""
    prev = held = None  # the last row's (h, c) with its class's first (did, tag, packed); an anchor's first row while it is alone
    for frame in frames:
        gone = frame["state"] == 2
        if gone.any():
            yield frame.loc[gone, ["h", "did", "tag", "packed"]].assign(whole=True)
            frame = frame[~gone]
        if not len(frame):
            continue
        h, c, did, tag, packed, state = (frame[k].to_numpy() for k in ("h", "c", "did", "tag", "packed", "state"))
        known, mark = state == 1, state == 3
        new_h, new_c = np.ones(len(h), bool), np.ones(len(h), bool)
        new_h[1:] = h[1:] != h[:-1]
        # a marker is a context of its own
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1]) | (mark[1:] != mark[:-1])
        if prev:
            new_h[0] = h[0] != prev[0]
            new_c[0] = new_h[0] or c[0] != prev[1] or bool(mark[0]) != prev[2]
        first = np.maximum.accumulate(np.where(new_c, np.arange(len(h)), -1))
        begun = [x[first] for x in (did, tag, packed)]
        if prev:
            begun = [np.where(first < 0, was, x) for was, x in zip(prev[3:], begun, strict=True)]
        whole = ~new_c & ~mark & ((did != begun[0]) | (tag != begun[1]) | (packed != begun[2]))
        # an anchor's further contexts, and its first once there is another
        more = new_c & ~new_h
        start = np.maximum.accumulate(np.where(new_h, np.arange(len(h)), -1))
        several = np.zeros(len(h), bool)
        several[start[more & (start >= 0)]] = True
        out = [pd.DataFrame({"h": h, "did": did, "tag": tag, "packed": packed, "whole": whole})[(whole | more | several | (known & new_c)) & ~mark]]
        if held is not None:
            if (more & (start < 0)).any():
                out.append(pd.DataFrame({"h": [held[0]], "did": [held[1]], "tag": [held[2]], "packed": [held[3]], "whole": [False]}))
                held = None
            if new_h.any():
                held = None
        if new_h.any():
            s = start[-1]
            held = None if several[s] or known[s] or mark[s] else (h[s], did[s], tag[s], packed[s])
        prev = (h[-1], c[-1], bool(mark[-1]), *(x[-1] for x in begun))
        yield pd.concat(out, ignore_index=True)


def spread(did: np.ndarray, tag: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Keys that deal rows evenly."""
    return mixed(packed.view(np.uint64) ^ mixed(did.view(np.uint64) ^ mixed(tag.view(np.uint64))))


def places(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, and largest and smallest offset in its windows."""
    return packed >> (2 * D_BITS) & POS_MASK, packed >> D_BITS & D_MASK, packed & D_MASK


def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(did, tag, text, hs, ps, hot) to (k, h, did, tag, packed, context, gone): the bytes of an anchor's windows, dealt by the anchor, or of a slice of
    them where the anchor is hot; ``gone`` rows occur earlier in the batch."""
    for frame in frames:
        h, did, tag, p, ctx, sliced = [], [], [], [], [], []
        for one, own, text, hs, ps, hot in zip(*(frame[c] for c in ("did", "tag", "text", "hs", "ps", "hot")), strict=True):
            packed, hot = np.asarray(ps, np.int64), np.asarray(hot, bool)
            x, most, least = places(packed)
            hs = np.asarray(hs, np.int64)
            if hot.any():
                cold = ~hot
                rows = [(hs[cold], packed[cold], x[cold], most[cold], least[cold], np.zeros(cold.sum(), bool))]
                for a in range(0, SPREAD, SLICE):
                    top, low = np.minimum(most, a + SLICE - 1), np.maximum(least, a)
                    i = np.flatnonzero(hot & (top >= low))
                    rest = packed[i] >> (2 * D_BITS) << (2 * D_BITS)
                    rows.append((hs[i], rest | top[i] << D_BITS | low[i], x[i], top[i], low[i], np.ones(len(i), bool)))
                hs, packed, x, most, least, hot = (np.concatenate(v) for v in zip(*rows, strict=True))
            h.append(hs)
            p.append(packed)
            did.append(np.full(len(packed), one, np.int64))
            tag.append(np.full(len(packed), own, np.int64))
            sliced.append(hot)
            ctx += [text[a:b] for a, b in zip((x - most).tolist(), (x - least + LENGTH).tolist(), strict=True)]
        if not ctx:
            continue
        h, did, tag, p, sliced = (np.concatenate(v) for v in (h, did, tag, p, sliced))
        key, gone = h.copy(), np.zeros(len(h), bool)
        if sliced.any():
            i = np.flatnonzero(sliced)
            i = i[np.lexsort((p[i], tag[i], did[i]))]
            _, most, least = places(p[i])
            size = np.array([len(ctx[j]) for j in i])
            begin = np.cumsum(size) - size
            hasher = Hasher(np.frombuffer(b"".join([ctx[j] for j in i]), np.uint8))
            # bytes that every window of the slice has; a row's own windows may be a part of the slice
            a = least // SLICE * SLICE
            at = begin + most - a
            shared = hasher.of(at, at + LENGTH - SLICE + 1)
            key[i] = mixed(h[i].view(np.uint64) ^ mixed(shared ^ a.astype(np.uint64))).view(np.int64)
            whole = hasher.of(begin, begin + size) ^ mixed((most << D_BITS | least).astype(np.uint64))
            first = first_of(key[i], whole)
            same = np.zeros(len(i), bool)
            same[1:] = (did[i][1:] == did[i][:-1]) & (tag[i][1:] == tag[i][:-1]) & (p[i][1:] == p[i][:-1])
            gone[i] = ~first & ~same
        key = np.where(gone, spread(did, tag, p).view(np.int64), key)
        yield pd.DataFrame({"k": key, "h": h, "did": did, "tag": tag, "packed": p, "context": ctx, "gone": gone})


def later(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by (k, did, tag, packed) to stretches (did, tag, start, end) of windows that occur earlier."""
    for frame in by_runs(frames, ["k"], 1 << 15):
        # the anchors of a repeated row come twice
        who = frame[["k", "did", "tag", "packed"]].to_numpy()
        same = (who[1:] == who[:-1]).all(1)
        frame = frame[np.append(True, ~same)]
        ctx = frame["context"].tolist()
        size = np.array([len(x) for x in ctx])
        begin = np.cumsum(size) - size
        hasher = Hasher(np.frombuffer(b"".join(ctx), np.uint8))
        windows = size - LENGTH + 1
        row = np.repeat(np.arange(len(ctx)), windows)
        j = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[row] + j
        packed, gone = frame["packed"].to_numpy(), frame["gone"].to_numpy()
        x, most, _ = places(packed)
        key = hasher.of(at, at + LENGTH) ^ mixed(frame["h"].to_numpy().view(np.uint64)[row] + (most[row] - j).astype(np.uint64))
        order = np.argsort(key, kind="stable")  # rows stand in order of (did, tag, packed)
        order = order[~gone[row[order]]]
        again = gone[row]
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        hit = np.flatnonzero(again)
        if not len(hit):
            continue
        new = np.ones(len(hit), bool)
        new[1:] = (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)
        a, b = hit[new], hit[np.append(np.flatnonzero(new)[1:], len(hit)) - 1]
        low = (x - most)[row[a]]
        yield pd.DataFrame(
            {"did": frame["did"].to_numpy()[row[a]], "tag": frame["tag"].to_numpy()[row[a]], "start": low + j[a], "end": low + j[b] + LENGTH}
        )


def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, int, int]:
    """The text without the stretches; how many bytes and maximal stretches that took."""
    if not len(starts):
        return text, 0, 0
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    s, e = s[new], e[np.append(np.flatnonzero(new)[1:], len(e)) - 1]
    keep = zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True)
    return b"".join(text[a:b] for a, b in keep), int((e - s).sum()), len(s)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, did, tag, sha and text (bytes) of every row of ``docs``."""
    text, did = F.coalesce("text", F.lit("")), F.coalesce("doc_id", F.lit(LEAST_ID)).cast("long")
    a, b = F.xxhash64(text), F.xxhash64(F.lit(7), text)
    ids = materialize(docs.select(did.alias("did"), a.alias("a"), b.alias("b")).distinct(), "ids")
    several = ids.groupBy("did").agg(F.count("*").alias("n")).where("n > 1").select("did")
    shared = running(materialize(ids.join(several, "did"), "shared"), [F.col("a"), F.col("b")], {"tag": F.lit(1).cast("long")}, ["did"])
    tags = materialize(shared.select(F.col("did").alias("d"), F.col("a").alias("ta"), F.col("b").alias("tb"), "tag"), "tags")
    rows = docs.select("doc_id", did.alias("did"), a.alias("a"), b.alias("b"), F.sha2(text, 256).alias("sha"), text.cast("binary").alias("text"))
    found = rows.join(tags, (F.col("did") == F.col("d")) & (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left")
    return found.select("doc_id", "did", F.coalesce("tag", F.lit(0)).cast("long").alias("tag"), "sha", "text")


def with_stretches(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes), and starts and ends of the stretches to remove, for every row of ``docs``."""
    dealt = bucketed(numbered(docs), "texts", "did", "tag")
    slim = materialize(dealt.select("did", "tag", "sha", F.octet_length("text").cast("long").alias("n")).where(f"n >= {LENGTH}"), "ids")
    firsts = materialize(slim.groupBy("sha").agg(F.min("did").alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    sized = slim.withColumnRenamed("n", "size")
    copies = materialize(looked_up(sized, firsts, "sha", slim.count()).where("did > first").select("did", "tag", F.col("size").alias("n")).distinct(), "copies")
    once = dealt.join(copies.select("did", "tag"), ["did", "tag"], "left_anti").select("did", "tag", "text")
    rows = once.mapInPandas(sampled, "k long, h long, c long, did long, tag long, packed long, state int")
    sorted_rows = rows.repartition("k").sortWithinPartitions("k", "h", "c", "did", "tag", "packed")
    found = materialize(sorted_rows.mapInPandas(recurring, "h long, did long, tag long, packed long, whole boolean"), "anchors")
    some = found.where("not whole")
    hot = materialize(some.groupBy("h").count().where(f"count > {HOT}").select("h", F.lit(True).alias("hot")), "hot")
    marked = some.join(hot, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    open_ = marked.groupBy("did", "tag").agg(F.collect_list("h").alias("hs"), F.collect_list("packed").alias("ps"), F.collect_list("hot").alias("hot"))
    asked = dealt.select("did", "tag", "text").join(open_, ["did", "tag"]).select("did", "tag", "text", "hs", "ps", "hot")
    ranked = asked.mapInPandas(contexts, "k long, h long, did long, tag long, packed long, context binary, gone boolean").repartition("k").sortWithinPartitions("k", "did", "tag", "packed")
    stretches = materialize(ranked.mapInPandas(later, "did long, tag long, start long, end long"), "stretches")
    place, most, least = F.shiftright("packed", 2 * D_BITS).bitwiseAND(F.lit(POS_MASK)), F.shiftright("packed", D_BITS).bitwiseAND(F.lit(D_MASK)), F.col("packed").bitwiseAND(F.lit(D_MASK))
    whole = found.where("whole").select("did", "tag", (place - most).alias("start"), (place - least + LENGTH).alias("end"))
    every = stretches.unionByName(whole).unionByName(copies.select("did", "tag", F.lit(0).cast("long").alias("start"), F.col("n").alias("end")))
    per_doc = every.groupBy("did", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))
    return dealt.join(per_doc, ["did", "tag"], "left").select("doc_id", "text", "starts", "ends")


def remove(docs: DataFrame) -> DataFrame:
    """doc_id, kept (bytes), n_bytes, n_removed, n_spans and kept_sha256 of every row of ``docs``."""

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for text, s, e in zip(frame["text"], frame["starts"], frame["ends"], strict=True):
                none = s is None
                kept, gone, runs = (text, 0, 0) if none else cut(text, np.asarray(s, np.int64), np.asarray(e, np.int64))
                out.append((kept, len(text), gone, runs, hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pd.DataFrame({"doc_id": frame["doc_id"]} | dict(zip(("kept", "n_bytes", "n_removed", "n_spans", "kept_sha256"), columns, strict=True)))

    return with_stretches(docs).mapInPandas(apply, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL: dict[str, str] = {}
