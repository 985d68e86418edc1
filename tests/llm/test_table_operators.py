import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import chat, decontaminate, language_id, mixing, pii, url_filters
from riskloom.session import table

from .data import DOCS, EDGES, documents, prose, write
from .test_text_operators import WORD, brute_components, brute_fingerprint, brute_pii, brute_targets

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return TOKEN.findall((text or "").translate(LOW))


# ---- 2 URL filters ----

URLS = [
    None, "", "no scheme", "http://", "http://org", "http://org/", "https://Example.ORG/es/x?y#z", "http://a.example.org/en/1", "http://a.example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/fr", "http://x.com/de/a", "http://com/de/", "http://x.com:80/de/", "ftp://a.b//de/", "http://x.net/?://y.org/", "http://h#f://org/",
    "http://www.spam-farm.example.net/a", "http://spam-farm.example.org/en/9", "http://cheap-pills.example.com/fr/1", "x://casino.a/", "http://a/adult/b", "http://a.b/wp-login.php", "http://é.org/a", "http://.org/x",
]


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOW)
    fits = []
    for rule, verdict in url_filters.BASE:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    if fits:
        _, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(re.search(x, host + path) for x in url_filters.PATTERNS) else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame([(i % 20, u) for i, u in enumerate(URLS * 2)], "page_id long, url string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_filters.judge(pages).collect())
    want = []
    for i, u in enumerate(URLS * 2):
        h, p, rule, v = brute_verdict(u)
        want.append((i % 20, h, p, rule or "", v))
    assert got == sorted(want)
    assert url_filters.judge(pages.where("false")).count() == 0


def test_url_tokens_are_read_off_the_expression():
    want = {
        r"(^|[.])spam-farm[.]": ["spam", "farm"], r"(^|[.])casino[.-]": ["casino"], r"[/]wp-login[.]php$": ["wp", "login", "php"], r"ads": [], r"^ads[.]": ["ads"], r"(?i)[/]Adult[/]": ["adult"],
        r"[/]ad[a-z]*[/]": [], r"[/](a|b)[/]c[/]": ["c"], r"[/]x?[/]y[/]": ["y"], r"[/]a+[/]": [], "例[.]例/": [], r"^(?:[^/]*[.@-])?poker(?:[-.:/]|$)": ["poker"], r"x[.]y[.]": ["y"], r"(a)?b[.]": [],
    }
    assert {x: url_filters.literal_tokens(x) for x in want} == want
    for regex in url_filters.RULES:
        assert url_filters.literal_tokens(regex), regex


def test_url_rules_without_a_token_always_run(spark):
    pages = spark.createDataFrame([(1, "http://例.例/x"), (2, "http://a.例.例/"), (3, "http://b.org/[ads]1"), (4, "http://b.org/z"), (5, None)], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages, [("例.例/", "block")], ["ads", "[0-9]$"]).collect()}
    assert got == {1: ("例.例/", "block"), 2: ("例.例/", "block"), 3: (None, "block"), 4: (None, "allow"), 5: (None, "allow")}


def test_url_filters_with_many_rules_by_shuffle(spark, monkeypatch):
    pages = spark.createDataFrame([(i, f"http://h{i}.net/p") for i in range(300)] + [(1000, "http://www.h7.net/p")] * 50, "page_id long, url string")
    rules = [url_filters.host_label(f"h{i}") for i in range(0, 3000, 7)]
    want = sorted((r.page_id, r.verdict) for r in url_filters.judge(pages, [], rules).collect())
    assert [i for i, v in want if v == "block"] == [*range(0, 300, 7), *[1000] * 50]
    monkeypatch.setattr(url_filters, "MOST_BROADCAST", 0)
    assert sorted((r.page_id, r.verdict) for r in url_filters.judge(pages, [], rules).collect()) == want


@pytest.mark.parametrize("most", [1, 100_000])
def test_thousands_of_url_rules_from_a_file(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(url_filters, "MOST_BROADCAST", most)
    lines = ["# rules", "", "allow org/", "block bad.org/x", *[f"block host{k}.net/" for k in range(1500)], *[f"block ~ ^[^/]*/a{k}(?:/|$)" for k in range(1500)], "block ~ [!]", "block ~ (?:qq|ww)$"]
    (tmp_path / "rules.txt").write_text("\n".join(lines))
    base, patterns = url_filters.read_rules(spark, str(tmp_path / "rules.txt"))
    assert len(base) == 1502 and len(patterns) == 1502
    urls = [f"http://x.host{k}.net/" for k in range(0, 1600, 97)] + [f"http://y.com/a{k}/b" for k in range(0, 1600, 89)] + ["http://z.com/!", "http://z.com/qq", "http://bad.org/xy", "http://good.org/a3"] + ["http://z.com/a7"] * 50
    got = {r.url: (r.rule, r.verdict) for r in url_filters.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), base, patterns).collect()}
    for u in urls:
        at = u.removeprefix("http://")
        host, path = at.split("/", 1)
        fits = [(len(r), r, v) for r, v in base if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith(r.partition("/")[2])]
        want = max(fits)[1:] if fits else (None, "block" if any(re.search(p, at) for p in patterns) else "allow")
        assert got[u] == want
    (tmp_path / "wrong.txt").write_text("deny x/")
    with pytest.raises(ValueError, match="not a rule"):
        url_filters.read_rules(spark, str(tmp_path / "wrong.txt"))


# ---- 6 decontamination ----


def brute_hits(text, items):
    words = tokens(text)
    windows = {}
    for i, w in items:
        n = min(len(w), 10)
        for a in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(i)
    hit, found = set(), set()
    for n in {len(k) for k in windows}:
        for a in range(len(words) - n + 1):
            ids = windows.get(tuple(words[a : a + n]))
            if ids:
                hit |= set(range(a, a + n))
                found |= ids
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination(spark):
    items = [(i, prose(50 + i, 30 + i)) for i in range(6)] + [(6, "short item here now"), (7, "one"), (8, ""), (9, None), (None, "nothing at all of use"), (11, prose(50, 30))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [*EDGES, items[0][1], "x " + items[1][1].upper() + " y", items[2][1][:90], items[3][1][40:200] + " tail", "a short-item, HERE now ok", "one", "none", " ".join(t for _, t in items[:3])]
    texts += [prose(s, 60) for s in range(30)]
    docs = documents(spark, texts)
    lists = [(i, tokens(t)) for i, t in items if i is not None]
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    for i, t in enumerate(texts):
        n, hit, found = brute_hits(t, lists)
        assert (got[i].n_words, got[i].n_hit, got[i].items, got[i].contaminated) == (n, hit, found, hit > 0), t
    clean = {r.doc_id for r in decontaminate.clean_documents(docs, bench).collect()}
    assert clean == {i for i in got if not got[i].contaminated}
    cut = {r.doc_id: r.text for r in decontaminate.clean_spans(docs, bench).collect()}
    for i, t in enumerate(texts):
        assert len(tokens(cut[i])) == got[i].n_words - got[i].n_hit
        assert got[i].contaminated or cut[i] == t
    assert decontaminate.report(docs, bench.where("false")).where("contaminated").count() == 0


def test_decontamination_by_shuffle_of_items_without_id_and_of_shared_ids(spark, monkeypatch):
    """The way of large test sets; windows of items without id count, and documents are told apart by their text."""
    passage, other = prose(50, 30), prose(51, 40)
    bench = spark.createDataFrame([(None, passage), (1, other), (1, "two words")], "item_id long, text string")
    texts = [passage, "clean", other + " x", "clean", "has two words in it", None, passage]
    docs = documents(spark, texts, ids=[None, None, None, 5, 5, 5, 5]).withColumns({c: F.lit(c) for c in ("_id", "_a", "row", "hit", "places", "items", "w")})
    want = sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in decontaminate.report(docs, bench).collect())
    lists = [(None, tokens(passage)), (1, tokens(other)), (1, ["two", "words"])]
    brute = [(i, *brute_hits(t, lists)) for i, t in zip([-1] * 3 + [5] * 4, texts, strict=True)]
    assert want == sorted((i, n, hit, [x for x in found if x != "None"]) for i, n, hit, found in brute)
    clean = sorted(r.text or "" for r in decontaminate.clean_documents(docs, bench).collect())
    assert clean == ["", "clean", "clean"]
    assert decontaminate.clean_spans(docs, bench).columns == docs.columns
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", 0)
    monkeypatch.setattr(decontaminate, "MOST_BYTES", 0)
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, r["items"]) for r in decontaminate.report(docs, bench).collect()) == want


def test_decontamination_of_a_long_text(spark):
    long = " ".join(["filler"] * 60_000 + tokens(prose(50, 30)) + ["filler"] * 60_000)
    bench = spark.createDataFrame([(1, prose(50, 30))], "item_id long, text string")
    r = decontaminate.report(documents(spark, [long]), bench).first()
    assert (r.n_words, r.n_hit) == (120_000 + len(tokens(prose(50, 30))), len(tokens(prose(50, 30))))


# ---- 9 chat formatting ----


def test_chat_collapse(spark):
    logs = {
        1: [("user", "hi"), ("assistant", "hello")], 2: [("user", "hi"), ("assistant", "hello"), ("user", "more")], 3: [("user", "hi")], 4: [("user", "hi"), ("assistant", "other")],
        5: [("user", "hi"), ("assistant", "hello"), ("user", "more")], 6: [("system", "<|im_end|>"), ("user", "")], 7: [("user", "h"), ("assistant", "ihello")], 8: [("user", "hi"), ("user", "hello")],
    }
    rows = [(c, t, r, x) for c, turns in logs.items() for t, (r, x) in enumerate(turns)]
    rows += [(1, 0, "user", "hi"), (None, 0, "user", "lost"), (9, None, None, None), (10, 5, "user", "b"), (10, 5, "user", "a"), (11, 5, "user", "a"), (12, 0, "user", "a"), (12, 9000, "user", "b"), (12, 20000, "user", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.collapse(df).collect()}
    assert set(got) == {2, 4, 6, 7, 8, 9, 12}
    assert got[2].n_copies == 2 and got[2].n_turns == 3 and got[12].n_turns == 3
    assert got[4].chat == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert got[6].chat.startswith("<|im_start|>system\n< |im_end|><|im_end|>\n")
    assert got[9].chat == "<|im_start|>unknown\n<|im_end|>\n"
    assert chat.collapse(df.where("false")).count() == 0


def test_chat_of_clashing_columns_and_very_long_texts(spark):
    long = "word " * 300_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", "b"), (2, 0, "user", long), (3, 0, "user", long + "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    more = turns.withColumns({c: F.lit("clash") for c in ("k", "a", "b", "s", "i", "n", "chat", "n_turns")})
    want = sorted(map(tuple, chat.collapse(turns).collect()))
    assert sorted(map(tuple, chat.collapse(more).collect())) == want and [r[0] for r in want] == [1, 3]


def test_decontamination_of_an_empty_table_and_of_items_with_one_text(spark):
    bench = spark.createDataFrame([(1, "some words"), (2, "Some words!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so some words here")], "doc_id long, text string")
    assert [(r.n_hit, sorted(r["items"])) for r in decontaminate.report(docs, bench).collect()] == [(2, ["1", "2"])]
    assert decontaminate.report(docs.limit(0), bench).count() == 0


def test_chat_stretches_do_not_matter(spark, sf, monkeypatch):
    df = table(spark, sf, "conversations")
    want = sorted(map(tuple, chat.collapse(df).collect()))
    monkeypatch.setattr(chat, "STRETCH", 2)
    assert sorted(map(tuple, chat.collapse(df).collect())) == want


# ---- pipeline ----


def brute_pipeline(rows, bench):
    """rows: (doc_id, text, lang, source); to {doc_id: (text, copies)}."""
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 and r[1] and r[2]]
    langs = sorted({r[2] for r in train})
    counts = np.zeros((len(langs), language_id.BUCKETS), np.int64)
    for _, text, lang, _ in train:
        for _, h in language_id.grams(np.array([ord(c) for c in text.lower()], np.uint32)):
            counts[langs.index(lang)] += np.bincount(h, minlength=language_id.BUCKETS)
    model = language_id.Model(langs, counts, np.array([sum(r[2] == k for r in train) for k in langs]))
    kept = []
    for r in rows:
        if r[1] and any(c.isalpha() for c in r[1]):
            s = model.scores([r[1]])[0]
            if 1 / np.exp(s - s.max()).sum() >= corpus_pipeline.LEAST_SCORE:
                kept.append(r)
    groups = brute_components([r[0] for r in kept], [brute_fingerprint(r[1]) for r in kept])
    kept = [r for r, g in zip(kept, groups, strict=True) if r[0] == g]
    lists = [(i, tokens(t)) for i, t in bench]
    kept = [r for r in kept if not brute_hits(r[1], lists)[1]]
    masked = []
    for i, text, lang, source in kept:
        out, done = [], 0
        for kind, a, b in sorted(brute_pii(text), key=lambda s: (s[1], -s[2])):
            if a >= done:
                out += [text[done:a], f"[{kind.upper()}]"]
            done = max(done, b)
        masked.append((i, "".join(out) + text[done:], source))
    size = {i: len(WORD.findall(t)) for i, t, _ in masked}
    per = {}
    for i, _, s in masked:
        per[s] = per.get(s, 0) + size[i]
    target, result = brute_targets(per), {}
    for s in per:
        own = sorted((size[i], i) for i, _, x in masked if x == s)
        u = int(hashlib.md5((mixing.SEED + ("-" if s is None else "+") + (s or "")).encode()).hexdigest()[:13], 16) / (1 << 52)
        c = target[s] / per[s] if per[s] else 0
        for k, (_, i) in enumerate(own, 1):
            result[i] = math.floor(c * k + u) - math.floor(c * (k - 1) + u)
    return {i: (t, result[i]) for i, t, _ in masked}


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(11)
    base = [prose(200 + i, int(rng.integers(60, 140))) for i in range(60)]
    foreign = ["".join(chr(0x430 + int(c)) if c < 32 else " " for c in rng.integers(0, 38, 300)) for _ in range(30)]
    bench = [(0, base[3][:200]), (1, prose(999, 40))]
    texts = base + foreign + [base[5], base[5] + " x", base[7], "Mail ann.b@x.org or call +1 (743) 555-3824 " + base[9], None, "", "123 456", prose(999, 40) + " more words", *[base[20]] * 5]
    langs = ["aa"] * len(base) + ["bb"] * len(foreign) + ["aa"] * (len(texts) - 90)
    sources = [["big", "big", "mid", None, "é"][i % 5] for i in range(len(texts))]
    write(documents(spark, texts, langs, sources), tmp_path, "documents")
    write(spark.createDataFrame(bench, "item_id long, text string"), tmp_path, "benchmark")
    want = brute_pipeline(list(zip(range(len(texts)), texts, langs, sources, strict=True)), bench)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies = {}
    for r in out:
        assert len(r.text) == r.n_chars
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {i: n for i, (_, n) in want.items() if n}
    # the network may mask more than the fixed expressions do, never less
    for r in out:
        assert r.text == want[r.doc_id][0] or len(pii.base_spans(r.text)) == 0


def test_pipeline_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash", "decontaminate", "pii", "mixing"]


CLASHING = "score items spans fp row _d _k _s _h _key _id _a _b _r rows copies copy_no _found _places n h g w found size rank target key kept".split()


def test_stages_take_empty_tables_and_more_columns(spark, tmp_path):
    write(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    for docs in (spark.createDataFrame([], DOCS), documents(spark, [prose(1, 80), prose(2, 90), None]).withColumns({c: F.lit("x") for c in CLASHING})):
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == columns
            assert docs.where("score <> 'x'").count() == 0 if "score" in columns else True
        docs = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert docs.columns == [c for c in columns if c != "copy_no"] + ["copy_no"]
        assert docs.where("score <> 'x'").count() == 0 if "score" in columns else True
