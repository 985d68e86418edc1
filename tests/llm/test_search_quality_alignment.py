"""Operators 11 to 13 against brute force, and their odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.llm import quality_classifier, ranked_search, token_alignment
from riskloom.session import table
from tests.llm.data import EDGES, documents, prose, write

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def result(spark, sf, name):
    return entry.queries()[name](spark, sf).toPandas()


# Operator 11


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=10):
    """(doc_id, text) and (item_id, text) pairs to sorted (item_id, rank, doc_id, score)."""
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, terms in sorted({(i, tuple(sorted(set(words(t))))) for i, t in items if t is not None}, key=str):
        scores = []
        for i, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def tuples(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_search_query_is_brute_force(spark, sf):
    docs, items = table(spark, sf, "documents").toPandas(), table(spark, sf, "benchmark").toPandas()
    got = result(spark, sf, "op11_ranked_search")[["item_id", "rank", "doc_id", "score"]]
    want = brute_search(list(zip(docs.doc_id, docs.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))
    assert sorted(map(tuple, got.itertuples(index=False)), key=str) == [tuple(map(int, r)) for r in want]


@pytest.mark.parametrize("block", [2, 128])
def test_search_odd_rows(spark, monkeypatch, block):
    monkeypatch.setattr(ranked_search, "BLOCK", block)
    monkeypatch.setattr(ranked_search, "MOST_POSTINGS", 200)
    monkeypatch.setattr(ranked_search, "MOST_ITEMS", 4)
    texts = EDGES + [prose(k, 5 + 7 * k) for k in range(40)] + [prose(3, 26)] * 5 + ["alpha " * 70000 + "rare", "RARE Rare_rare"]
    ids = [*range(len(texts) - 3), None, 7, 7]
    docs = documents(spark, texts, ids=ids).withColumn("shard", F.lit(1)).withColumn("term", F.lit("x")).withColumn("score", F.lit(2))
    items = [(0, "alpha Beta née"), (0, "alpha Beta née"), (0, "gamma"), (1, None), (2, ""), (3, "nowhere to be found"), (None, "rare zeta 42"), (5, prose(9, 60)), (6, "größe, größe! Größe"), (7, "日本語")]
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    index = ranked_search.build(docs.repartition(3))
    got = ranked_search.ranked(index, queries).select("item_id", "rank", "doc_id", "score")
    assert tuples(got) == brute_search(list(zip(ids, texts, strict=True)), items)
    for empty in (ranked_search.ranked(ranked_search.build(docs.limit(0)), queries), ranked_search.ranked(index, queries.limit(0))):
        assert empty.count() == 0


def test_search_decompresses_few_blocks(spark):
    rng = random.Random(5)
    common = [f"c{k}" for k in range(40)]
    texts = [" ".join(rng.choices(common, k=rng.randint(20, 200)) + ([f"rare{k % 900}"] * 3 if k % 300 == 0 else [])) for k in range(12000)]
    docs = documents(spark, texts).coalesce(1)
    queries = spark.createDataFrame([(0, "rare0 rare300 rare600 " + " ".join(common[:6]))], "item_id long, text string")
    found = ranked_search.ranked(ranked_search.build(docs), queries).toPandas()
    assert found.decoded.max() < 0.5 * found.blocks.max()
    want = brute_search(list(enumerate(texts)), [(0, "rare0 rare300 rare600 " + " ".join(common[:6]))])
    assert sorted(zip(found["rank"], found.doc_id, found.score, strict=True)) == sorted(r[1:] for r in want)


def test_numbers_are_packed_and_unpacked():
    values = np.array([1, 127, 128, 16383, 16384, 2**31 - 1, 5], np.int64)
    raw, size = ranked_search.packed(values)
    assert size.tolist() == [1, 1, 2, 2, 3, 5, 1] and ranked_search.unpacked(raw).tolist() == values.tolist()
    assert ranked_search.unpacked(np.empty(0, np.uint8)).tolist() == []


# Operator 12


def test_quality_query_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    got = result(spark, sf, "op12_quality_classifier")
    docs, labels = pd.read_parquet(f"{sf}/documents.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    assert sorted(got.doc_id) == sorted(docs.doc_id) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.98
    assert (held.predicted[held.quality == 1] == 1).mean() > 0.98 and (held.predicted[held.quality == 0] == 0).mean() > 0.9


def test_quality_scores_are_those_of_one_text_at_a_time(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    own = documents(spark, EDGES + [prose(1, 30000), prose(1, 30000)]).withColumn("score", F.lit(9)).withColumn("quality", F.lit(1))
    got = quality_classifier.classify(own, model).select("text", "score").collect()
    assert len(got) == len(EDGES) + 2
    for row in got:
        good, bad = (quality_classifier.compressor(d) for d in (model.good, model.bad))
        raw = (row.text or "").encode()
        g, b = (sum(len(c.compress(raw[k : k + 512])) for k in range(0, len(raw), 512)) for c in (good, bad))
        x = [(b - g) / (b + g), (b - g) / len(raw), math.log1p(len(raw))] if raw else [0, 0, 0]
        at = model.weights[0] + sum(w * (v - c) / s for w, v, c, s in zip(model.weights[1:], x, model.centre, model.scale, strict=True))
        assert row.score == pytest.approx(1 / (1 + math.exp(-at)), abs=1e-9)


def test_quality_learns_from_its_share_only(spark):
    texts = [prose(k, 80) for k in range(60)] + ["bad bad | bad\n" * (20 + k) for k in range(60)]
    ids = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 3 != 1][:120]
    docs, labels = documents(spark, texts, ids=ids), spark.createDataFrame([(i, int(k < 60)) for k, i in enumerate(ids)], "doc_id long, quality int")
    held = [k for k in range(1000) if zlib.crc32(str(k).encode()) % 3 == 1][:40]
    more = docs.unionByName(documents(spark, ["bad bad | bad\n" * 9] * 40, ids=held))
    wrong = labels.unionByName(spark.createDataFrame([*[(i, 1) for i in held], (None, 1), (ids[0], None)], "doc_id long, quality int"))
    model = quality_classifier.fit(docs, labels)
    assert quality_classifier.fit(more, wrong) == model and model.weights
    disputed = labels.unionByName(spark.createDataFrame([(ids[0], 0)], "doc_id long, quality int"))
    assert quality_classifier.fit(docs, disputed) != model
    few = quality_classifier.fit(docs, labels, most=20)
    score = [r.score for r in quality_classifier.classify(docs, few).orderBy("doc_id").collect()]
    assert np.mean([(s >= 0.5) == (k < 60) for k, s in enumerate(score)]) > 0.95


def test_quality_without_labels_or_documents(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, quality int")
    for own in (quality_classifier.fit(docs, labels), quality_classifier.fit(docs, labels.limit(0)), quality_classifier.fit(docs.limit(0), labels)):
        assert {r.score for r in quality_classifier.classify(docs, own).collect()} == {0.5}
    assert quality_classifier.classify(docs.limit(0), own).count() == 0


# Operator 13


def brute_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text, written from the contract."""
    import sentencepiece
    from tokenizers import Tokenizer

    first, second = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    first.encode_special_tokens = True
    of = token_alignment.byte_level()
    groups, counts, best = [], Counter(), Counter()
    for text in texts:
        want, own = b" " + (text or "").encode(), []
        if text:
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            said_a = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
            said_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in map(second.id_to_piece, b)]
            if b"".join(said_a) == want == b"".join(said_b):
                ends_a, ends_b = ([sum(map(len, said[: k + 1])) for k in range(len(said))] for said in (said_a, said_b))
                cuts = sorted(set(ends_a) & set(ends_b))
                own = [([i for i, e in zip(a, ends_a, strict=True) if lo < e <= hi], [i for i, e in zip(b, ends_b, strict=True) if lo < e <= hi]) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        groups.append(own)
        counts.update({(i, j) for x, y in own for i in x for j in y})
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for own in groups:
        links = [(i, j) for x, y in own for i in x for j in y]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        out.append((sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if own else ""))
    return out


HARD = ["x" * 3000, "=" * 2000 + " " * 700, "▁ gives itself away", "<|endoftext|> <s> </s> <unk> <0x41>", "ﬁ ① ＃ \x00 ​", "😀😀 á don't  stop\t\n\n  ", "  lead and trail  ", "abc" * 500, "\r\n\r\n" * 40]
FIGURES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_query_is_brute_force(spark, sf):
    docs = table(spark, sf, "documents").toPandas()
    docs["text"] = docs.text.where(docs.text.str.len() < 6000, None)
    short = table(spark, sf, "documents").withColumn("text", F.when(F.length("text") < 6000, F.col("text")))
    got = token_alignment.aligned(short, A, B).toPandas().sort_values("doc_id")[["doc_id", *FIGURES]]
    want = [(i, *x) for i, x in zip(docs.doc_id, brute_alignment(docs.text), strict=True)]
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(want)


@pytest.mark.parametrize(("most", "made"), [(1 << 20, 1 << 21), (10, 1 << 21), (1 << 20, 30)])
def test_alignment_odd_rows(spark, monkeypatch, most, made):
    monkeypatch.setattr(token_alignment, "MOST_MADE", made)
    texts = EDGES + HARD + [prose(k, 60) for k in range(12)] + [prose(2, 60)] * 30
    ids = [*range(len(texts) - 3), None, 5, 5]
    docs = documents(spark, texts, ids=ids).withColumn("row", F.lit(1)).withColumn("part", F.lit("p")).withColumn("n", F.lit(0))
    got = token_alignment.aligned(docs, A, B, most)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert tuples(got.select("doc_id", *FIGURES)) == sorted([(i, *x) for i, x in zip(ids, brute_alignment(texts), strict=True)], key=str)
    assert token_alignment.aligned(docs.limit(0), A, B, most).count() == 0


def test_alignment_of_a_very_long_text(spark):
    text = "".join(prose(k, 4000) for k in range(40)) + "x" * 200_000
    got = token_alignment.aligned(documents(spark, [text, None]), A, B).orderBy("doc_id").collect()
    assert got[0].n_a > 100_000 and got[0].n_links >= got[0].n_groups > 0 and got[0].count_sum == got[0].n_links
    assert got[1][1:] == (0, 0, 0, 0, 0, 0, "")


def test_both_readers_of_a_byte_level_vocabulary_agree(spark):
    with open(A, "rb") as file:
        raw = file.read()
    texts = [" " + t for t in [*[e for e in EDGES if e], *HARD, *[prose(k, 200) for k in range(20)]]]
    assert token_alignment.ByteLevel(raw).encode(texts) == token_alignment.ByteLevel(raw, plain=True).encode(texts)


def test_coalescing_general_intervals():
    a, b = np.array([[0, 2], [2, 5], [9, 12]]), np.array([[1, 3], [5, 7], [8, 9], [10, 11]])
    got = token_alignment.coalesced(a[:, 0], a[:, 1], b[:, 0], b[:, 1])
    assert [x.tolist() for x in got] == [[0, 0, 3], [0, 1, 2, 3]]


def test_queries_of_new_operators_meet_their_columns(spark, sf, tmp_path):
    docs = documents(spark, EDGES)
    write(docs, tmp_path, "documents")
    write(spark.createDataFrame([(1, "a b word")], "item_id long, text string"), tmp_path, "benchmark")
    write(spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    types = {
        "op11_ranked_search": [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")],
        "op12_quality_classifier": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
        "op13_token_alignment": [("doc_id", "bigint"), *[(c, "bigint") for c in FIGURES[:-1]], ("groups_sha256", "string")],
    }
    for name, want in types.items():
        got = entry.queries()[name](spark, str(tmp_path))
        assert got.dtypes == want and got.count() == (len(EDGES) if name != "op11_ranked_search" else 5)
