"""Operators against brute force, and the cases that every operator must stand."""

import gzip
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pitloom.llm import components, debruijn, decontaminate, html, langid, minhash, packing, pii, queries, simhash, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)


def corpus(seed, n=40, words=60, vocabulary=300):
    rng = random.Random(seed)
    pool = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(vocabulary)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(1, words))) for _ in range(n)]
    for _ in range(n // 2):  # near copies, exact copies, passages that repeat inside
        t = rng.choice(texts).split()
        t[rng.randrange(len(t))] = "changed"
        texts.append("  ".join(t) if rng.random() < 0.5 else "\t".join(t + t))
    return [*texts, texts[0], texts[0], "", None, " \n ", "one"]


@pytest.fixture(scope="module")
def texts():
    return corpus(1)


@pytest.fixture(scope="module")
def docs(spark, texts):
    return docs_of(spark, texts).repartition(3).persist()


def test_repeats_against_brute_force(spark, docs, texts):
    first, want = {}, {}
    split = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(split):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, w in enumerate(split):
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for k in range(s, s + 20)}
        want[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in debruijn.remove_repeats(docs).collect()}
    assert got == want and any(x[1] for x in want.values())


def test_long_passages_compact(spark):
    shared = [f"s{i}" for i in range(200)]
    docs = docs_of(spark, [" ".join(shared), " ".join(["x", *shared, "y"])]).repartition(2)
    found = debruijn.passages(debruijn.repeats(debruijn.edges(docs)))
    assert found.count() < 5 and found.agg(F.max("n")).first()[0] > 100


def test_words_at_the_source_decide(spark, docs, monkeypatch):
    """With labels that take all edges of an anchor for equal, spans that differ from their source stay."""
    real = debruijn.edges
    monkeypatch.setattr(debruijn, "edges", lambda *a, **k: real(*a, **k).withColumn("label", F.lit(1).cast("long")))
    words = lambda *w: " ".join([*(f"a{i}" for i in range(30)), *w, *(f"b{i}" for i in range(30))])
    texts = [words("x"), words("y"), words("x")]
    got = {r.doc_id: r.text for r in debruijn.remove_repeats(docs_of(spark, texts).repartition(3)).collect()}
    assert got[0] == texts[0] and set(got[1].split()) >= {"y"}


def test_simhash_against_brute_force(docs, texts):
    prints = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{prints[i]:016x}", find(i)) for i in prints}


def test_fingerprints_at_odd_distances_are_refused(docs):
    with pytest.raises(ValueError):
        simhash.near_duplicates(docs, distance=3)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components.component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140))
    assert components.component_labels(spark.createDataFrame([], "a long, b long")).count() == 0


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda t: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda t: all(int(p) <= 255 for p in t.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda t: 16 <= len(re.sub("[^0-9]", "", t)) <= 19 and luhn(re.sub("[^0-9]", "", t))),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15),
]


def luhn(s):
    return sum(x if k % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for k, x in enumerate(int(c) for c in reversed(s))) % 10 == 0


def test_base_patterns_against_plain_regexes():
    rng = random.Random(3)
    bits = ["a.b@c.de", "@", "x@", "@y.z", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4242 4242-4242 4242", "4242424242424243", "+1 (743) 555-3824", "+", "+12", "é", " ", "-", ".", "a", "9", "a@b.c@d.e"]
    for _ in range(3000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
        want = [(k, m.start(), m.end()) for k, p, ok in BASE for m in p.finditer(t) if ok(m[0])]
        assert pii.base_spans(t) == want, t
    assert pii.base_spans("0" * 5000 + ".1.1.1") == [("ip", 0, 5006)] and pii.base_spans("9" * 5000 + ".1.1.1") == []
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 300_000) == []


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_terms_that_reveal(spark, broadcast):
    rng = random.Random(5)
    words = [f"{a}{b}word" for a in "bcdfghjkl" for b in "aeiou"]
    around = lambda *w: " ".join([*rng.sample(words, 12), *w, *rng.sample(words, 12)])
    texts = [around("zephyr") + " x" * 500 + " ann@example.com" for _ in range(40)] + [around() for _ in range(80)] + [around("ordinary") for _ in range(30)] + [around("ordinary", "bob@example.com")] * 9
    texts += ["Zephyr stands alone", around("Quill", "once@example.com"), around("A7b", "twice@example.com"), around("A7b", "twice@example.com"), None, ""]
    docs = docs_of(spark, texts)
    found = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.terms] for r in pii.all_spans(docs, broadcast_terms=broadcast).collect()}
    told = {i: set(x) for i, x in found.items() if x}
    assert all(told[i] == {("term_removed", "zephyr")} for i in range(40)), "far from the entity"
    assert told[159] == {("term_removed", "Zephyr")}, "and in other documents"
    assert told[160] == {("term", "Quill")} and told[161] == told[162] == {("term", "A7b")} and len(told) == 44
    clean = {r.doc_id: r.text for r in pii.sanitize(docs, broadcast_terms=broadcast).collect()}
    assert "zephyr" not in clean[0] and "<EMAIL>" in clean[0] and clean[50] == texts[50] and clean[159] == " stands alone"
    assert "<NAME>" in clean[160] and "<CODE>" in clean[161] and clean[163] is None and clean[164] == ""


def test_what_terms_leave_secret_against_brute_force(spark):
    rng = random.Random(23)
    names = [f"n{i}@x.org" for i in range(6)]
    pool = [f"term{i:03d}" for i in range(150)]
    texts = [" ".join([*rng.sample(pool, rng.randint(2, 6)), *rng.sample(names, rng.randint(0, 2))]) for _ in range(60)]
    texts += texts[:10]
    terms = [set(pii.terms_of(t)) for t in texts]
    who = [{pii.entity(k, t[a:b]) for k, a, b in pii.base_spans(t)} for t in texts]
    want = {}
    for t in set().union(*terms):
        best = 0.0
        for e in set().union(*who):
            both = [k for k in range(len(texts)) if t in terms[k] and e in who[k]]
            d = len({texts[k] for k in both})
            best = max(best, len(both) / sum(t in x for x in terms) * d / (d + 1))
        if best >= 0.5:
            want[pii.hashed(t)] = -math.log2(best)
    got = {r.term: r.secret for r in pii.revealing_terms(docs_of(spark, texts)).collect()}
    assert got == pytest.approx(want) and len(want) > 5


def test_packing_is_whole_and_tight(spark):
    rng = random.Random(7)
    lengths = sorted((rng.randint(1, 64) for _ in range(500)), reverse=True)
    where, offset, sizes = packing.pack_lengths(lengths, (16, 32, 64), 2)
    spans = {}
    for n, b, o in zip(lengths, where, offset, strict=True):
        spans.setdefault(b, []).append((o, o + n))
    for b, s in spans.items():
        s.sort()
        assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:])) and sizes[b] == min(c for c in (16, 32, 64) if c >= s[-1][1])
    assert sum(lengths) / sum(sizes) > 0.9
    table = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 70, 130, 7, 7, None])], "doc_id long, n_tokens long")
    got = packing.pack(table, capacities=(16, 32, 64), shard_rows=3).collect()
    assert {(r.doc_id, sum(x.n_tokens for x in got if x.doc_id == r.doc_id)) for r in got} == {(0, 0), (1, 5), (2, 70), (3, 130), (4, 7), (5, 7), (6, 0)}
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in got)


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(300, 16)).astype(np.float32) * rng.lognormal(size=(300, 1)).astype(np.float32)
    v[7] = v[8]
    bad = [(1000, None), (1100, [None] * 16), (1200, [float("nan")] * 16), (1300, [float("inf")] * 16)]
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)] + bad, "vec_id long, embedding array<float>")
    x = np.floor(1024 * v.astype(float)).astype(np.int64)
    got = [tuple(r) for r in topk.search(df, every=10, query_block=7).orderBy("query_id", "rank").collect()]
    want = [(q, k + 1, i, -s) for q in range(0, 300, 10) for k, (s, i) in enumerate(sorted((-int(x[i] @ x[q]), i) for i in range(300) if i != q)[:10])]
    assert got == want
    assert topk.search(df.limit(0)).count() == 0 and topk.search(spark.createDataFrame([(0, []), (1, [])], df.schema)).first().score == 0 and topk.search(df.where("vec_id in (0, 3, 5)")).count() == 2


@pytest.mark.parametrize("top", [3.0, 1e9])
def test_topk_of_repeated_rows_and_long_vectors(spark, top):
    """As the SQL has it: every row but those with the query's id, as often as it is there."""
    rng = random.Random(29)
    rows = [(i, [rng.uniform(-top, top) for _ in range(4)]) for i in range(12)]
    rows += [rows[3], rows[3], rows[5], rows[0], (0, [1.0, 0.0, 0.0, 0.0]), (7, [top, top, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows]
    got = [tuple(r) for r in topk.search(df).orderBy("query_id", "rank").collect()]
    found = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, c)))), j) for i, q in x if i % 100 == 0 for j, c in x if i != j)[:10]
    assert got == [(0, k + 1, j, -s) for k, (s, j) in enumerate(found)]


def test_pages():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/a">Menu</a></ul></nav><div class="cookie-notice">We use cookies and the like of it for all that you do here with us</div>
    <div id="main"><article class="with-sidebar"><header><h1>The &amp; title</h1></header><p>It was the best of times and it was the worst of times for all of them &lt;here&gt;<br>and there.
    <p>Short.<p>In the end they had all that they were looking for, and it was as good as it could have been for them.<aside>Related: <a href="#">the other one</a></aside>
    <form><label>Name</label><input></form></article><div id="comments"><p>I think that this is the best of all the articles that I have read on the site.</p></div></div>
    <footer>&copy; all of the rights</footer></body></html>"""
    assert html.main_text(page) == "The & title It was the best of times and it was the worst of times for all of them <here> and there. Short. In the end they had all that they were looking for, and it was as good as it could have been for them."
    plain = "<body><ul><li><a href=a>Home</a><li><a href=b>News of the day</a></ul><div>It is the story of a man who was at the end of his way, and of all that he had seen by then and there.</div><div>So it was.</div><div>And it is the end of the story, as far as anyone who was there with them could say at the time.</div><p>Contact us</p><div><a href=x>more of the same</a></div></body>"
    assert html.main_text(plain).startswith("It is the story") and "Home" not in html.main_text(plain)
    russian = "Это история о человеке, который прошёл весь свой путь до конца и увидел там всё, что хотел увидеть; он рассказал об этом своим детям, а они своим, и так эта история дошла до нас через много лет почти без изменений."
    chinese = "这是一个关于一个人的故事，他走完了自己的路，看到了他想看到的一切；他把这件事告诉了他的孩子们，孩子们又告诉了他们的孩子，就这样，这个故事经过许多年几乎没有改变地传到了我们这里，今天我们把它写下来。"
    for text in (russian, chinese):
        page = f"<body><ul><li><a href=a>Меню</a><li><a href=b>新闻</a></ul><div>{text}</div><div>{text[:20]}</div><div class=footer>{text}</div></body>"
        assert html.main_text(page) == f"{text} {text[:20]}"
    told = "It is the story of a man who was at the end of his way, and of all that he had seen by then"
    assert html.main_text(f"<p>{told} &<b>amp;</b> &lt<i>there</i> ©</p>") == f"{told} &amp; <there ©"
    assert html.main_text(f"<div>{told}.</div><div>{told}.</div><div>It has a © in it.</div><div>© all of it</div>") == f"{told}. {told}. It has a © in it."
    for odd in (None, "", "<", "a < b", "<p", "<!-- x", "<script>", "<a href='x>y", "</", "<p>" * 3000, "<b " * 3000, "<!--" * 3000):
        assert isinstance(html.main_text(odd), str)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://x.org/a", "<html><body><p>Héllo <b>you</b></p><a href='/b'>b</a></body></html>"), (2, "http://x.org/n", None)], "page_id long, url string, html string")
    made = warc.derivatives(warc.responses_of_pages(pages), keep=("page_id",)).persist()
    by = {(r.page_id, r.warc_type): r for r in made.collect()}
    assert len(by) == 4
    meta, text = by[1, "metadata"], by[1, "conversion"]
    assert text.block == "Héllo you\nb" and text.block_digest == warc.digest(text.block.encode()) and meta.refers_to == text.refers_to
    assert "outlink: http://x.org/b\r\n" in meta.block and "source-http-content-type: text/html; charset=utf-8" in meta.block
    payload = pages.first().html.encode()
    assert f"source-payload-digest: {warc.digest(payload)}\r\n" in meta.block and by[2, "conversion"].block == ""
    warc.write(made.drop("page_id"), str(tmp_path / "w"))
    back = {r.record_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    assert back.keys() == {r.record_id for r in by.values()} and all(r.complete for r in back.values())
    assert bytes(back[text.record_id].payload) == text.block.encode() and back[text.record_id].block_digest == text.block_digest


@pytest.mark.parametrize("split", ["128m", "300b"])
def test_responses_are_framed_by_their_lengths(spark, tmp_path, split):
    """Several versions, gzip members, marks inside payloads and headers, encoded bodies, a record that breaks off."""
    page = b"<html><body><p>It says WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc here</p></body></html>"

    def response(version, uri, http, body, cut=0):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n" + http + b"\r\n" + body
        return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:{uri}>\r\nWARC-Target-URI: http://x.org/WARC/{uri}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + (block[:-cut] if cut else block) + b"\r\n\r\n"

    chunked = b"5\r\n" + page[:5] + b"\r\n" + f"{len(page) - 5:x}\r\n".encode() + page[5:] + b"\r\n0\r\n\r\n"
    records = [response("1.0", "a", b"", page), response("1.1", "b", b"Content-Encoding: gzip\r\n", gzip.compress(page)), response("1.1", "c", b"Transfer-Encoding: chunked\r\n", chunked), response("1.0", "d", b"Content-Encoding: deflate\r\n", zlib.compress(page)), response("1.1", "e", b"", page, cut=20)]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[:4]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = warc.read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.record_id, r.complete) for r in got) == sorted([(f"<urn:{u}>", u != "e") for u in "abcde"] + [(f"<urn:{u}>", True) for u in "abcd"])
    by = {r.record_id: r for r in got}
    assert bytes(by["<urn:a>"].payload) == page and by["<urn:a>"].target_uri == "http://x.org/WARC/a"
    for u in "abcd":
        assert warc.derive(by[f"<urn:{u}>"].asDict())[1][-1] == "It says WARC/1.0 WARC-Type: response Content-Length: 3 abc here"


def test_lengths_that_are_no_numbers(spark, tmp_path):
    for k, n in enumerate(["²", "9" * 5000, "-1", "x"]):
        (tmp_path / f"{k}.warc").write_bytes(f"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: {n}\r\n\r\nbody".encode())
    assert [(bytes(r.payload), r.complete) for r in warc.read(spark, str(tmp_path)).collect()] == [(b"body", True)] * 4


def test_masks_survive_any_two_substitutions():
    for a in range(13):
        for b in range(a):
            assert any(all(o + k not in (a, b) for k in m) for m in decontaminate.MASKS for o in range(13 - m[-1]))


def test_decontamination_both_ways(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    items = [[word() for _ in range(n)] for n in (40, 20, 14, 13, 9, 6, 4)]
    filler = lambda n: [word() + "x" for _ in range(n)]
    edited = list(items[0])
    edited[5], edited[17], edited[30] = "zzz", "yyy", "qqq"
    texts = [" ".join(filler(30) + t + filler(5)) for t in (*items[:6], edited, items[1][:13])] + [" ".join(filler(60)), " ".join(items[6] + filler(9)), "!! ".join(filler(3) + items[2]).upper(), None, "", " ".join(items[6]), "“" + "—".join(items[2]) + "”"]
    docs, bench = docs_of(spark, texts), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)] + [(50, None), (51, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 0), (7, 1), (10, 2), (13, 6), (14, 2)}
    joined = decontaminate.overlaps(docs, bench, broadcast_bytes=0)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, decontaminate.overlaps(docs, bench).collect()))


def test_language_model_sums_all_segmentations():
    model = langid.UnigramModel(["x"], {"▁a": 0, "b": 1, "ab": 2, "▁ab": 3}, np.array([[0.3], [0.2], [0.1], [0.4], [0.0]]))
    assert langid.stretches("² ½ Ⅷ 12") == [] and langid.stretches("Ab²c") == ["▁ab", "▁c"]
    got = model.log_likelihoods(["▁ab"])[0, 0]
    assert got == pytest.approx(math.log(0.3 * 0.2 + 0.4))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.001"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in queries.op2_language_id(spark, sf).collect() if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in got]) > 0.95
    assert toxicity.fit_texts(["a"], np.array([0])).bias < 0 and toxicity.fit_texts([], np.array([])).bias < 0


ODD = [(None, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "...", "en", "s", 3), (4, "the word and the other of it " * 3000, "en", "s", 1), (5, "der und die", "de", "s", 1), (5, "der und die", "de", "s", 1), (6, "mail a@b.co +1 (743) 555-3824", "en", "s", 1)]


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows_and_clashing_columns(spark, tmp_path, empty):
    sf = str(tmp_path)
    rows = lambda r, s: spark.createDataFrame([] if empty else r, s + ", id long, start int, text0 string, score double, label string, node long, entity string, key long, spans string, n int")
    pad = (None,) * 10
    rows([r + pad for r in ODD], DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([] if empty else [(1, None, 1), (4, 1, 0), (6, 0, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    rows([(1, None, None) + pad, (None, "u", "<p>the") + pad, (2, "http://[", "<a href='http://['>x</a>") + pad, (2, "http://[", "<a href='http://['>x</a>") + pad], "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    spark.createDataFrame([] if empty else [(100, [0.5, 1.0], 1), (1, [0.5, 1.0], None), (2, None, 1), (None, [1.0, 1.0], 1), (1, [0.5, 1.0], None), (200, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{sf}/embeddings.parquet")
    spark.createDataFrame([] if empty else [(1, "mail nothing to nobody at all today"), (None, "x"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    rows([(1, 0, "user", "Hi.") + pad, (1, 0, "user", "Hi.") + pad, (1, None, None, None) + pad, (None, 1, "", "") + pad, (2, 5, "assistant", " ") + pad], "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    want = {**dict.fromkeys(("op2", "op3", "op4", "op5", "op6", "op11"), len(ODD)), "op12": 600 * len({r[3] for r in ODD}), "op13": 3}
    for name, query in queries.QUERIES.items():
        n = query(spark, sf).count()
        if (op := name.split("_")[0]) in want:
            assert n == (0 if empty else want[op]), name
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == (set() if empty else {4, 5, 6})


def test_pipeline_against_its_parts(spark):
    """On a small table the pipeline keeps what each decision, taken by itself, keeps."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    text = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in letters}
    sets = {i: minhash.shingles(t.lower().encode().split(), 5) for i, t in text.items()}
    name = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if j < i and name[i] != name[j] and minhash.jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((name[i], name[j]))
                name = {k: low if c == high else c for k, c in name.items()}
    first = set(name.values())
    dirty = {r.doc_id for r in decontaminate.overlaps(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert got == (letters & first) - dirty and dirty


@pytest.mark.parametrize("small", [minhash.SMALL, 1])
def test_near_duplicate_stage_against_brute_force(spark, small, monkeypatch):
    """Texts with edited words are near-duplicates by their shingles, however far apart their fingerprints are."""
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 7)
    rng = random.Random(17)
    pool = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(60, 200))) for _ in range(25)]
    for _ in range(90):
        t = rng.choice(texts[:12]).split()
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = "changed"
        texts.append("  ".join(t).upper() if rng.random() < 0.3 else " ".join(t))
    texts += [texts[0], "", None, "one two", "One  two", "one three"]
    sets = [minhash.shingles((t or "").lower().encode().split(), 5) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if minhash.jaccard(sets[i], sets[j]) >= 0.8:
                low, high = sorted((want[i], want[j]))
                want = [low if c == high else c for c in want]
    docs = docs_of(spark, texts)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, small=small).collect()} == dict(enumerate(want))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert kept == set(want) and len(kept) < len({r.component_id for r in simhash.near_duplicates(docs).collect()})


def test_token_counts_are_of_whole_texts(spark):
    """White space counts as the tokenizer has it, wherever texts are cut for the cache."""
    rng = random.Random(19)
    bits = [" ", "  ", "\n", "\t", "\r\n", "\x1c", "\xa0", "　", "​", "word", "it's", "'ll", "12", "é", "日本", "...", "-", "\x85"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["def f(x):\n    return x\n\n\n", "a  b", None, ""]
    encode = packing.read_encoding(packing.DEFAULT_VOCABULARY).encode_ordinary
    got = {r.doc_id: r.n_tokens for r in packing.count_tokens(docs_of(spark, texts)).collect()}
    assert got == {i: len(encode(t or "")) for i, t in enumerate(texts)}


def test_short_items_survive_all_permitted_substitutions():
    for n in range(5, 14):
        item = np.arange(1, n + 1).astype(np.uint64)
        seeds = decontaminate.Seeds.of(np.array([7]), [item])
        for a in range(n):
            for b in range(n) if n >= 10 else [a]:
                doc = np.concatenate([np.full(3, 99), item, np.full(3, 98)]).astype(np.uint64)
                doc[[3 + a, 3 + b]] = 97
                found = [h for salt, m in seeds.masks() for h in seeds.hits(decontaminate.seed_hashes(doc, m, salt), seeds.filter(), np.array([0, len(doc)]))]
                met = {int(d) for at, _, place in found for d in at - place}
                assert 3 in met and decontaminate.best_overlap(doc, item, 3), (n, a, b)


def test_segmentations_against_enumeration():
    """All segmentations into pieces, long ones included."""
    rng = np.random.default_rng(31)
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "aba", "abababababab", "▁ababababab"]
    model = langid.UnigramModel(["x", "y"], {p: k for k, p in enumerate(pieces)}, rng.random((len(pieces) + 1, 2)))

    def total(word, lang):
        if not word:
            return 1.0
        cut = [(p, model.probs[model.pieces[p], lang]) for p in pieces if word.startswith(p)]
        if word[0] not in model.pieces:
            cut.append((word[0], model.probs[-1, lang]))
        return sum(p * total(word[len(w) :], lang) for w, p in cut)

    for word in ("▁ab", "▁abc", "▁" + "ab" * 7, "▁cab" + "ba" * 12):
        assert model.log_likelihoods([word])[0] == pytest.approx([math.log(total(word, k)) for k in (0, 1)])
    assert len(langid.read_pieces(langid.DEFAULT_VOCABULARY)) > 23_000 and max(map(len, langid.read_pieces(langid.DEFAULT_VOCABULARY))) > 8


def test_language_ties_go_to_the_first(spark):
    model = langid.UnigramModel(["a", "b"], {"▁x": 0}, np.array([[0.5, 0.5], [0.1, 0.1]]))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs_of(spark, ["x x", "x" * 100_000, None, "1 2"]), model).collect()}
    assert got == {0: ("a", 0.5), 1: ("a", 0.5), 2: ("und", 0.0), 3: ("und", 0.0)}


def test_toxicity_reads_all_of_a_text(spark):
    """Held-out accuracy, misspelt words anywhere in a text, and a text without spaces whose end tells."""
    rng = random.Random(37)
    calm, rude = [f"{a}{b}{c}m" for a in "lmnr" for b in "aeiou" for c in "lnst"], ["grobzak", "vilkrut", "snorfdum"]
    text = lambda bad: " ".join(rng.choice(calm) for _ in range(40)) + (f" {rng.choice(rude)} {rng.choice(rude)}" if bad else "") + " " + " ".join(rng.choice(calm) for _ in range(rng.randint(1, 60)))
    train = [(text(k % 2), k % 2) for k in range(300)]
    model = toxicity.fit_texts([t for t, _ in train], np.array([y for _, y in train]))
    test = [(text(k % 2), k % 2) for k in range(200)]
    odd = [" ".join(rng.choice(calm) for _ in range(n)) + " grobzaks vilkrutt " + " ".join(rng.choice(calm) for _ in range(20)) for n in range(5, 30)]
    glued = ["".join(rng.choice(calm) for _ in range(500)) + "grobzakvilkrutsnorfdum" * 5, "".join(rng.choice(calm) for _ in range(500))]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs_of(spark, [t for t, _ in test] + odd + glued), model).collect()}
    assert np.mean([got[k] == y for k, (_, y) in enumerate(test)]) > 0.97
    assert np.mean([got[200 + k] for k in range(len(odd))]) > 0.9
    assert (got[200 + len(odd)], got[201 + len(odd)]) == (1, 0)


def test_no_ngram_is_lost_between_parts_of_a_word():
    word = "".join(chr(0x4E00 + k) for k in range(1000))
    parts = toxicity.words_of(f"a {word} b", 6)
    assert parts[0] == "a" and parts[-1] == "b" and all(any(word[k : k + 6] in p for p in parts) for k in range(995))
    assert all(len(p) <= toxicity.LONG + 5 for p in parts)


def test_packing_against_the_rule_by_brute_force():
    rng = random.Random(41)
    for capacities in ((8, 16), (5, 9, 20), (16,)):
        lengths = sorted((rng.randint(1, capacities[-1]) for _ in range(120)), reverse=True)
        bins = []  # [room, contents]
        for at, n in enumerate(lengths):
            left = sum(lengths[at + 1 :])
            fits = [b for b in bins if b[0] >= n]
            if not fits:
                bins.append([min((c for c in capacities if c >= n), key=lambda c: ((c + 2) / (n + min(c - n, left)), c)), 0])
                fits = bins[-1:]
            best = min(fits, key=lambda b: b[0])
            best[0] -= n
            best[1] += n
        where, _, sizes = packing.pack_lengths(lengths, capacities, 2)
        used = [sum(n for n, w in zip(lengths, where, strict=True) if w == b) for b in range(len(sizes))]
        assert len(sizes) == len(bins) and sum(used) == sum(lengths) and all(u <= c for u, c in zip(used, sizes, strict=True))
        if len(capacities) == 1:  # bins with equal room and different sizes may be swapped
            assert sorted(used) == sorted(b[1] for b in bins)


def test_overlaps_against_brute_force(spark):
    """Every pair of a document and an item, window against window."""
    rng = random.Random(43)
    pool = [f"w{i}" for i in range(60)]
    items = [[rng.choice(pool) for _ in range(n)] for n in (3, 5, 6, 8, 10, 12, 13, 20, 30) for _ in range(3)]
    docs = []
    for item in items * 3:
        copy = list(item)
        for k in rng.sample(range(len(copy)), rng.randint(0, len(copy) // 4)):
            copy[k] = "zzz"
        docs.append([rng.choice(pool) for _ in range(rng.randint(0, 15))] + copy + [rng.choice(pool) for _ in range(rng.randint(0, 15))])
    docs += [list(i) for i in items[:6]]

    def dirty(doc, item):
        if len(item) < decontaminate.SHORTEST:
            return doc == item
        width = min(13, len(item))
        windows = lambda x: [x[k : k + width] for k in range(len(x) - width + 1)]
        return any(sum(a == b for a, b in zip(x, y, strict=True)) >= 0.8 * width - 1e-9 for x in windows(doc) for y in windows(item))

    want = {(i, j) for i, d in enumerate(docs) for j, t in enumerate(items) if dirty(d, t)}
    bench = spark.createDataFrame([(j, " ".join(t)) for j, t in enumerate(items)], "item_id long, text string")
    for size in (16 << 20, 0):
        got = {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs_of(spark, [" ".join(d) for d in docs]), bench, broadcast_bytes=size).collect()}
        assert got == want and len(want) > 40


def test_results_of_odd_rows(spark):
    """Null, empty, blank, very long texts without spaces, and repeated rows: what each operator says of them."""
    long = "x" * 200_000
    texts = [None, "", " \n\t", "...", long, "one two", "one two"]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["one two"], first=6)).unionByName(docs_of(spark, ["null id"]).withColumn("doc_id", F.lit(None).cast("long"))).withColumns({"spans": F.lit("clash"), "terms": F.lit(1), "id": F.lit(2), "bands": F.lit(3)})
    by = lambda df, *c: sorted(((r.doc_id, *(r[x] for x in c)) for r in df.collect()), key=str)
    kept = debruijn.remove_repeats(docs)
    assert by(kept, "n_words", "n_removed", "text") == sorted([(0, 0, 0, ""), (1, 0, 0, ""), (2, 0, 0, ""), (3, 1, 0, "..."), (4, 1, 0, long), (5, 2, 0, "one two"), (6, 2, 0, "one two"), (6, 2, 0, "one two"), (None, 2, 0, "null id")], key=str)
    groups = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None}
    assert groups[0] == groups[1] == groups[2] == ("0" * 16, 0) and groups[5] == groups[6] and groups[6][1] == 5 and groups[4][1] == 4
    near = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert near == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 5}
    spans = pii.all_spans(docs)
    assert by(spans, "spans", "terms") == sorted([(i, [], []) for i in (0, 1, 2, 3, 4, 5, 6, 6, None)], key=str)
    packed = packing.pack_documents(docs)
    sizes = {}
    for r in packed.collect():
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0) and r.n_tokens <= 4096
    encode = packing.read_encoding(packing.DEFAULT_VOCABULARY).encode_ordinary
    assert sizes == {**{i: len(encode(t or "")) for i, t in enumerate(texts)}, 6: 2 * len(encode("one two")), None: len(encode("null id"))}
    clean = pii.sanitize(docs)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    pages = spark.createDataFrame([(1, None, None, "a"), (2, "u", "", "b"), (3, "u", "<p>" + long, "c"), (3, "u", "<p>" + long, "c")], "page_id long, url string, html string, text string")
    got = [tuple(r) for r in html.extract(pages).orderBy("page_id").collect()]
    assert got[:2] == [(1, None, "", 0), (2, "u", "", 0)] and got[2] == got[3] and got[2][3] == len(got[2][2])
    made = warc.derivatives(warc.responses_of_pages(pages), keep=("page_id",)).collect()
    assert [len(r.block) for r in made if r.warc_type == "conversion" and r.page_id < 3] == [0, 0] and len({r.record_id for r in made if r.page_id == 3}) == 2
    items = spark.createDataFrame([(1, "one two", 0), (2, None, 0), (None, "one two", 0), (1, "one two", 0), (3, "", 0)], "item_id long, text string, doc_id int")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, items).collect()) == [(5, 1), (6, 1)]


def test_a_hot_window_is_no_window_of_spark(spark):
    """One window in nearly all batches: every place but the earliest comes out, and no task sorts a group."""
    rows = [(7, 9, k, 3, 1, False, None) for k in range(2000)] + [(1000 + k, 1, 2, 40 + k, 2, True, None) for k in range(3)] + [(8, 9, 5, 5, 1, False, None), (None, None, 1, 1, 1, None, 77)]
    found = spark.createDataFrame(rows, "key long, check int, id long, start int, n int, known boolean, mark long")
    got = debruijn._repeated_windows(found)
    assert sorted(map(tuple, got.collect())) == sorted([(k, 3, 1) for k in range(1, 2000)] + [(2, 40 + k, 2) for k in range(3)])
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
