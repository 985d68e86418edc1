"""All columns of registered queries, through ``queries()``, against brute force."""

import hashlib

import pytest

import __spark_entry__ as entry
from riskloom.llm import language_id, pii, simhash
from riskloom.session import table
from tests.llm import test_text_operators as brute

SF = "/root/testdata/sf0.01"


def result(spark, name, sf=SF):
    return entry.queries()[name](spark, sf).toPandas()


def texts(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").select("doc_id", "text").collect()}


def test_pii_query(spark):
    docs, got = texts(spark), result(spark, "op8_pii")
    assert sorted(got.doc_id) == sorted(docs)
    total = 0
    for r in got.itertuples():
        said = brute.brute_pii(docs[r.doc_id])
        want = {k: sum(kind == k for kind, *_ in said) for k in pii.KINDS}
        assert {k: getattr(r, f"n_{k}") for k in pii.KINDS} == want
        assert r.base_sha256 == hashlib.sha256(pii.written(said).encode()).hexdigest()
        spans = [x for x in r.spans.split(",") if x]
        assert r.n_spans == len(spans) and set(filter(None, pii.written(said).split(","))) <= set(spans)
        total += sum(want.values())
    assert total > 50


def test_a_fitted_network_is_kept(spark, monkeypatch):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    first = pii.train(docs, most=200)
    monkeypatch.setattr(pii.Tagger, "fit", lambda *a, **b: pytest.fail("fitted again"))
    again = pii.train(docs.repartition(3), most=200)
    assert first.p.keys() == again.p.keys() and all((first.p[k] == again.p[k]).all() and first.p[k].dtype == again.p[k].dtype for k in first.p)


def test_simhash_query(spark, sf):
    docs, got = texts(spark, sf), result(spark, "op4_simhash", sf).set_index("doc_id")
    prints = {i: simhash.fingerprint(t) & (1 << 64) - 1 for i, t in docs.items()}
    group = {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for x in ids:
        for y in ids:
            if x < y and (prints[x] ^ prints[y]).bit_count() <= 3:
                a, b = sorted((root(x), root(y)))
                group[b] = a
    assert got.fingerprint.to_dict() == {i: f"{p:016x}" for i, p in prints.items()}
    assert got.component_id.to_dict() == {i: root(i) for i in ids}


def test_language_query(spark, sf):
    import zlib

    got = result(spark, "op3_language_id", sf).set_index("doc_id")
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    assert got.held_out.to_dict() == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}
    assert got.score.between(0, 1).all()
    known = {r.lang for r in docs.values() if r.lang}
    assert set(got.lang_pred) <= known | {language_id.UNDECIDED}
    assert all((got.lang_pred[i] == language_id.UNDECIDED) == (not any(c.isalpha() for c in r.text or "")) for i, r in docs.items())
    held = [i for i in docs if got.held_out[i] and docs[i].lang]
    assert sum(got.lang_pred[i] == docs[i].lang for i in held) >= 0.97 * len(held)


def test_suffix_dedup_query(spark, sf):
    docs, got = texts(spark, sf), result(spark, "op10_suffix_dedup", sf).set_index("doc_id")
    seen, want = set(), {}
    for i in sorted(docs):
        raw = docs[i].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            part = raw[k : k + 100]
            if part in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(part)
        runs = sum(bool(g) and not (k and gone[k - 1]) for k, g in enumerate(gone))
        want[i] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.iterrows()} == want
