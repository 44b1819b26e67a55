"""Each operator against a plain version, with nulls, empty and repeated rows, and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmask.llm import decontam, exact_dedup, html_text, licenses, near_dedup, packing, pii, quality, queries, substring_dedup, url_filters

DOC = "doc_id long, text string, score string, kept string, hash string, key1 string"


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def documents(seed=3):
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (0, 1, 2, 3, 14, 60, 200, 200, 300)]
    texts = [None, "", " \n\t ", *base]
    for t in base[4:]:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(1, max(2, len(w) // 25 + 1))):
                w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
            texts.append(" ".join(w))
        texts += [t, t.upper(), t + " tail"]
    texts += ["shared passage of some words that is long enough to count as one window here " + prose(rng, 20) for _ in range(4)]
    texts += ["É À a@b.example É", "12 " * 40, "x" * 5000 + " y", "the same the same the same " * 8]
    return [(i, t, "a", "b", "c", "d") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return spark.createDataFrame([*rows, rows[20]], DOC), [*rows, rows[20]]


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def groups(n, links):
    parent = {i: i for i in n}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in n}


@pytest.mark.parametrize(("k", "num", "options"), [(3, 85, {}), (5, 80, {"stars": 0, "block_docs": 4, "hot_rows": 1}), (3, 85, {"stars": 1, "block_docs": 6})])
def test_near_duplicates(docs, k, num, options):
    df, rows = docs
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, k, num, 100, **options).collect()}
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) > 0]
    want = groups(ids, links)
    assert len(links) > 20
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == want[i]) for i, r in got.items())


@pytest.mark.parametrize(("num", "bands", "least"), [(85, 36, 0.9995), (80, 36, 0.998), (80, 40, 0.998)])
def test_near_candidates_are_found(num, bands, least):
    """Share of pairs right at the threshold that share a bucket, at several set sizes."""
    rng = np.random.default_rng(num)
    rows, probes = 7, near_dedup._probe_table(bands * 7, 4096)
    met = pairs = 0
    for n in (20, 60, 300, 3000):
        both = -(-num * n // 100)
        for _ in range(400 if n < 3000 else 100):
            pool = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            a, b = pool[: both + (n - both) // 2], np.concatenate([pool[:both], pool[both + (n - both) // 2 :]])
            x, y = (near_dedup.one_permutation(np.sort(v), bands * rows, probes).reshape(bands, rows) for v in (a, b))
            pairs, met = pairs + 1, met + bool((x == y).all(axis=1).any())
    assert met >= least * pairs


def test_near_copies_of_a_repeated_id(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (2, b), (3, a), (3, b), (4, b), (5, None), (5, "  "), (None, a)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 1, False), (5, 5, True), (5, 5, True)]


def test_large_family_is_joined_by_stars(spark, monkeypatch):
    """Some hundred near copies of one text need no comparison of blocks."""
    rng = random.Random(9)
    base = prose(rng, 300, 10_000).split()
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(300)] = f"y{i}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(near_dedup, "_compare_blocks", None)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 300


def test_link_blocks_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 50).astype(np.uint64)) for _ in range(12)]
    ids = np.arange(12)
    whole = near_dedup.links_within(ids, np.zeros(12, int), sets, 60, 100)
    cut = []
    for a in range(3):
        for b in range(a, 3):
            own = [i for i in range(12) if i % 3 in (a, b)]
            cut += near_dedup.links_within(ids[own], np.array([i % 3 for i in own]), [sets[i] for i in own], 60, 100)
    want = [(i, j) for i in range(12) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))]
    assert groups(range(12), whole) == groups(range(12), cut) == groups(range(12), want)


def test_exact_duplicates(docs):
    df, rows = docs
    lower = {c: c + 32 for c in range(65, 91)}
    texts = [(i, (t or "").translate(lower)) for i, t, *_ in rows]
    same: dict = {}
    for i, t in texts:
        same.setdefault(t, []).append(i)
    want = sorted((i, max(same[t]), len(same[t]), i == max(same[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts)
    for options in ({}, {"hash_bits": 3, "hot_rows": 4}, {"hot_rows": 1, "broadcast_cells": 0}):
        got = sorted(map(tuple, exact_dedup.exact_duplicates(df, capacity=16, start_depth=1, **options).collect()))
        assert got == want, options


def test_exact_duplicates_without_ids(spark):
    rows = [(None, "A"), (3, "a"), (None, "b"), (None, "B"), (3, "c"), (3, "C"), (4, None), (5, "")]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.keep_id or 0, r.group_size, r.kept) for r in got) == [
        (0, 0, 2, True), (0, 0, 2, True), (0, 3, 2, False), (3, 3, 2, True), (3, 3, 2, True), (3, 3, 2, True), (4, 5, 2, False), (5, 5, 2, True)
    ]


def test_exact_duplicates_need_the_directory(docs, monkeypatch):
    whole = exact_dedup.directory
    monkeypatch.setattr(exact_dedup, "directory", lambda *a: whole(*a).filter("bucket % 2 = 0"))
    df, rows = docs
    assert 0 < exact_dedup.exact_duplicates(df, capacity=40, start_depth=2).count() < len(rows)


@pytest.mark.parametrize("cell_bits", [2, 5, 12])
def test_directory_splits_overfull_buckets(spark, cell_bits):
    from quillmask.llm._store import Workspace

    counted = spark.range(1000).select(F.xxhash64("id").alias("hash"), F.lit(2).alias("rows"))
    leaves = exact_dedup.directory(counted, 100, 2, cell_bits, 40, Workspace(spark, "t"))
    placed = exact_dedup._placed(counted, leaves, True)
    sizes = placed.groupBy("bucket", "depth").agg(F.sum("rows").alias("rows")).collect()
    assert sum(r.rows for r in sizes) == 2000 and all(r.rows <= 100 for r in sizes)
    assert sum(2.0**-r.depth for r in sizes) == 1.0
    deep = exact_dedup.directory(spark.range(9).select((F.col("id") % 2).alias("hash"), F.lit(9).alias("rows")), 5, 1, 4, 6, Workspace(spark, "t"))
    assert {(r.bucket, r.depth) for r in deep.collect()} == {(0, 6)}


def test_windows(docs):
    df, rows = docs
    tables = [
        sorted(map(tuple, substring_dedup.remove_repeated_windows(df, **options).collect()))
        for options in ({}, {"bits": 9, "slice_bits": 7, "unit_octets": 9000, "part_octets": 2000}, {"bits": 25, "unit_octets": 9000, "depth": 1})
    ]
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    least: dict = {}
    for i, w in words:
        for j in range(len(w) - 12):
            key = tuple(w[j : j + 13])
            least[key] = min(least.get(key, i), i)
    want = []
    for i, w in words:
        gone = {p for j in range(len(w) - 12) if least[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert [t == sorted(want) for t in tables] == [True] * 3
    assert sum(x[2] for x in want) > 500


def test_share_of_unique_windows_that_pass():
    """At every size; the formula against a sketch that is simulated."""
    for octets in (10**8, 3 * 10**9, 3 * 10**10, 10**14):
        assert substring_dedup.expected_passing(octets / 7.6, substring_dedup.sketch_bits(octets)) < 0.04
    rng = np.random.default_rng(2)
    bits, n = 18, 40_000
    h = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
    both = np.ones(n, dtype=bool)
    for r in range(2):
        c = substring_dedup._cells(h, r, bits).astype(np.int64)
        both &= np.bincount(c, minlength=1 << bits)[c] > 1
    assert abs(both.mean() - substring_dedup.expected_passing(n, bits)) < 0.005


def test_windows_of_odd_rows(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [(None, p), (5, p), (5, p), (5, p + " tail"), (7, p), (9, None), (9, ""), (8, "x " * 40_000 + p)]
    got = substring_dedup.remove_repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got) == [(0, 20, 0), (5, 20, 0), (5, 20, 0), (5, 21, 0), (7, 20, 20), (8, 40_020, 20), (9, 0, 0), (9, 0, 0)]
    assert {r.kept_text for r in got if r.doc_id == 8} == {("x " * 40_000).strip()}


def test_gap_code():
    for cells in ([], [0], [127], [128], [256, 257, 70000], [0, 1, 2, 510, 765], [5, 1 << 40, (1 << 40) + 1, (1 << 55) + 7]):
        c = np.array(cells, dtype=np.int64)
        assert substring_dedup.gap_decode(substring_dedup.gap_code(c)).tolist() == cells


def test_personal_data(spark):
    texts = [
        None, "", "mail a.b@c.example, x_d@e.fr.g. IP 1.2.3.4.5 and 300.1.2.3.4, 010.0.0.255", "a@b.c_d@e.f", "card 4111 1111 1111 1111 or 4111-1111-1111-1112; +1 (212) 555-0100 and +12 3",
        "IBAN GB82WEST12345698765432, GB82WEST12345698765433; my ssn is 123-45-6789 but 987-65-4321 " + "far " * 20 + "123-45-6780", "é" * 10 + " a@b.co é 1.1.1.1", "1 " * 3000, "@" * 2000 + "a" * 3000 + "@b", "+" * 500,
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "digest 04dbebab91ab85687d33eeaaf9ac699e1188f962", "a fake token 04dbebab91ab85687d33eeaaf9ac699e1188f962", "key 04dbebab91ab85687d33eeaaf9ac699e1188f96g",
        "é a.b@c.example " * 3000, "host 1.2.3.4 " + "far " * 12 + "dummy a@b.co",
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, email string")
    got = {r.doc_id: r for r in pii.digest(pii.personal_data(df)).collect()}

    def luhn(d):
        return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(map(int, d[::-1]))) % 10 == 0

    plain = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(re.sub(r"\D", "", v)) <= 19 and luhn(re.sub(r"\D", "", v))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(re.sub(r"\D", "", v)) <= 15),
    ]
    for i, t in enumerate(texts):
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p, ok in plain for m in re.finditer(p, t or "") if ok(m[0])]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), (i, got[i].spans, spans)
        assert set(spans) <= set(got[i].spans.split(","))
    assert "iban:5:27" in got[5].spans and got[5].spans.count("iban") == 1 and got[5].spans.count("ssn") == 2
    assert [got[i].spans.split(",")[-1].split(":")[0] for i in (10, 11, 12, 13)] == ["secret", "", "", ""] and got[10].scores == "0.6"
    assert got[14].n_spans == got[14].n_email == 3000 and set(got[14].scores.split(",")) == {"0.8"}
    assert got[15].scores == "0.5,0.8" and all(r.n_spans == len([x for x in r.scores.split(",") if x]) for r in got.values())
    assert queries.QUERIES["op7_pii"]


def test_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(160):
        good = i % 3 > 0
        rows.append((i, prose(rng, 60) if good else " | ".join(prose(rng, 60).split()), "x"))
        labels.append((i, int(good), 0))
    rows += [(900, None, "x"), (901, "", "x"), (902, "a", "x"), (5, rows[5][1], "x")]
    schema = "doc_id long, text string, score string"
    out = quality.quality_scores(spark.createDataFrame(rows, schema), spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 160]
    assert sum((r.predicted == 1) == (r.doc_id % 3 > 0) for r in held) >= 0.95 * len(held)


def test_pooling_covers_whole_text():
    net = quality.Network(np.zeros((2, 256, 1)), np.zeros(1), np.zeros(1), np.zeros(1), 0.0, chunk=32, overlap=8)
    net.filters[0, ord("!"), 0] = 3.0
    for n in (1, 31, 32, 33, 1000):
        texts = [b"a" * k + b"!" + b"a" * (n - k - 1) for k in {0, n // 2, n - 1}] + [b"", b"a" * n]
        top = quality.pooled(net, net.tables(), texts)[:, 1]
        assert top[:-2].tolist() == [3.0] * (len(texts) - 2) and top[-2:].tolist() == [0.0, 0.0]


def test_main_text(spark):
    menu = "<nav><ul><li><a href=/>Home</a></ul></nav><div class='c1'>Call us today</div>"
    pages = [(i, f"http://h.example/{i}", f"<html><head><title>t</title><script>var a='</p>'</script></head><body>{menu}<div class=body><h1>T{i}</h1><p>One &amp; <b>two</b> {i}\n x<p>last {i}<!-- no --></div><footer>f</footer>", "e") for i in range(12)]
    pages += [(90, None, None, "e"), (91, "http://o.example/", "", "e"), (92, "odd", "<p>a<br>b<ul><li>c<li>d</ul><form>no</form><div id='comments'>no</div> tail < 3", "e"), (0, *pages[0][1:])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    for limit in (100, 0):
        got = {r.page_id: r for r in html_text.main_text(df, broadcast_nodes=limit).collect()}
        assert got[3].text == "T3\nOne & two 3 x\nlast 3" and got[3].n_chars == len(got[3].text)
        assert got[90].text == got[91].text == "" and got[90].n_chars == 0
        assert got[92].text == "a b\nc\nd\ntail < 3"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<svg class=icon /><article><p>one</p></article>", "one"), ("<svg class='icon'/><p>one<svg><text>no</text></svg> two</p>", "one two"), ("<p>a<math/>b</p><p>c</p>", "ab\nc"),
        ("<svg><p>one</p>", "one"), ("<noscript><p>one</p>", "one"), ("<div><object data=x><p>one</div><p>two", "one\ntwo"), ("<template><p>one</p><p>two", "one\ntwo"),
        ("<p>so <math><msup><mi>x</mi><mn>2</mn></msup><mspace/><mo>=</mo><mn>4</mn></math>.</p>", "so x 2 = 4."), ("<p>one</p><script>no<p>no", "one"),
    ],
)
def test_parts_without_an_end(source, want):
    assert html_text.Page(source).text(frozenset()) == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<div class="main-content with-sidebar"><p>main text</p></div>', "main text"),
        ('<article><p>a<div class="notice-of-award">b</div><div class="search-results">c</div><section class="header">d</section></article>', "a\nb\nc\nd"),
        ('<article><p>the article</article><div id="comments"><article class="comment">no</article></div><aside class="related"><article>no</article></aside><header><h1>no</h1></header>', "the article"),
        ("<p>&l<b>t</b>; x &lt;</p><xmp><b>&amp;</b></xmp>y", "&lt; x <\n<b>&amp;</b>\ny"),
        ('<form><article>a long one</article><p>x</form><p data-class="ad">k', "a long one\nx\nk"),
        ('<body class="nav-open sidebar"><div class="site-footer">no</div><div class="ad">no</div><div class="left-sidebar nav">no</div><div class="cookie-notice">no</div><p>t', "t"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<p>" + "long &amp; " * 100_000, ("long & " * 100_000).strip()),
    ],
)
def test_noise_by_name(source, want):
    assert html_text.Page(source).text(frozenset()) == want


def boilerplate_pages(n):
    """Pages of one host: three menus, four adverts and one footer around articles of their own; two pages hold the same article."""
    rng = random.Random(5)
    for i in range(n):
        body = "".join(f"<p>{prose(rng, 30, 5000)}</p>" for _ in range(4 + i % 3)) if i != 1 else body  # noqa: F821
        yield i, "https://h.example/x", f"<div><ul><li>menu {'abc'[i % 3]}<li>home</ul></div><table><tr><td>buy {'wxyz'[i * 7 % 4]}</table><section>{body}</section><pre>made by us</pre>", "e"


def test_style_tree_alone_finds_boilerplate(spark):
    pages = list(boilerplate_pages(24))
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html_text.main_text(df, names=False).collect()}
    assert all(re.findall("<p>(.*?)</p>", h) == got[i].split("\n") for i, _, h, _ in pages)
    few = {r.page_id: r.text for r in html_text.main_text(df, names=False, min_pages=25).collect()}
    assert all("made by us" in t and "menu" in t for t in few.values())


def test_style_tree_removes_menus_of_the_given_pages(spark):
    """Without any name, at the threshold that articles of these pages never fall below."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("html like '%<article>%'")
    host = F.regexp_extract("url", "://([^/:]+)", 1)
    busy = pages.groupBy(host.alias("h")).count().filter("count >= 50").select("h")
    pages = pages.join(busy, host == F.col("h"), "left_semi")
    want = {r.page_id: html_text.Page(re.search("<article>.*</article>", r.html, re.S)[0]).text(frozenset()) for r in pages.collect()}
    got = {r.page_id: r.text for r in html_text.main_text(pages, threshold=0.86, names=False).collect()}
    assert len(want) > 500 and sum(got[i] == t for i, t in want.items()) >= 0.9 * len(want)
    assert {r.page_id: r.text for r in html_text.main_text(pages).collect()} == want


def test_style_importance_against_plain(spark):
    import math
    from collections import Counter, defaultdict

    pages = list(boilerplate_pages(12)) + [(50, "https://h.example/y", "<div>9 one<div>two</div></div><div>3 one</div>", "e")] * 2
    styles, texts, below = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, _, h, _ in pages:
        own, some, pairs = html_text.Page(h).nodes()
        for k, v in own.items():
            styles[k][v] += 1
        for k, v in some:
            texts[k][v] += 1
        for up, k in pairs:
            below[up].add(k)
    want = {}
    for k, c in styles.items():
        m = sum(c.values())
        look = -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1.0
        spread = [math.log(n) / math.log(sum(styles[b].values())) if sum(styles[b].values()) > 1 else 0 for b in below[k] for n in texts[b].values()]
        want[html_text._signed(k)] = (m, 0.1 * look + 0.9 * (1 - sum(spread) / len(spread)))
    df = spark.createDataFrame([("h", h) for _, _, h, _ in pages], "host string, html string")
    got = {r.node: (r.pages, r.importance) for r in html_text.style_importance(df).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want)


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        p, kind = rng.randrange(len(w)), rng.randrange(3)
        if kind == 0:
            w[p] = f"z{rng.randrange(999)}"
        elif kind == 1:
            w.insert(p, f"z{rng.randrange(999)}")
        elif len(w) > 1:
            del w[p]
    return w


def plain_contaminated(docs, items, similarity=0.8):
    """Least distance of each item to any run of words of each document, over all windows."""
    out = {}
    for d, t, *_ in docs:
        text = (t or "").lower().split()
        for i, x in items:
            item = (x or "").lower().split()
            if 0 < len(item) < 5 and item == text:
                out[d, i] = 0
            if len(item) < 5:
                continue
            most = int((1 - similarity) * len(item) + 1e-9)
            row = [0] * (len(text) + 1)  # a run may start anywhere
            for a, word in enumerate(item, 1):
                new = [a]
                for b, other in enumerate(text, 1):
                    new.append(min(row[b] + 1, new[-1] + 1, row[b - 1] + (word != other)))
                row = new
            if min(row) <= most:
                out[d, i] = min(row)
    return out


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(i, prose(rng, n, 300)) for i, n in enumerate((20, 35, 60, 8, 5, 20, 3, 0))] + [(9, None), (10, "two words"), (None, "null id of this item"), (11, "two words")]
    items.append((12, items[0][1].upper()))
    docs = [(0, None, "x"), (1, "", "x"), (2, "same " * 500, "x"), (3, "Two  words", "x"), (4, "two words more", "x"), (5, items[2][1] + " " + items[2][1], "x")]
    for k in range(90):
        w = items[k % 6][1].split()
        w = edited(rng, w, rng.randrange(0, int(0.2 * len(w)) + 1))
        docs.append((10 + k, f"{prose(rng, 40, 900)} {' '.join(w).upper()} {prose(rng, 40 * (k % 3 > 0), 900)}", "x"))
    docs += [(100 + k, prose(rng, 200, 300), "x") for k in range(20)] + [(130, prose(rng, 60_000, 40_000) + " " + items[1][1], "x"), docs[-1]]
    want = plain_contaminated(docs[:-2], [x for x in items if x[0] is not None]) | {(130, 1): 0}
    schema = "doc_id long, text string, item_id string"
    table = spark.createDataFrame(items, "item_id long, text string")
    for octets in (200, 10_000):
        got = {(r.doc_id, r.item_id): r.distance for r in decontam.contaminated(spark.createDataFrame(docs, schema), table, block_octets=octets).collect()}
        assert not got.keys() - want.keys() and len(got) >= 0.99 * len(want) > 80
        assert sum(got[k] == want[k] for k in got) >= 0.97 * len(got) and all(got[k] >= want[k] for k in got)


def test_buckets_reach_their_recall():
    """Passages at the edit limit, by substitutions, insertions and deletions."""
    rng = random.Random(11)
    for n in (8, 20, 40, 80):
        item = prose(rng, n, 10**6)
        held = decontam.Items([(1, item.encode())], 0.8, 5, 2, 32)
        met = 0
        for _ in range(150):
            w = edited(rng, item.split(), int(0.2 * n))
            met += bool(list(held.find([f"{prose(rng, 30, 10**6)} {' '.join(w)} {prose(rng, 30, 10**6)}".encode()])))
        assert met >= 0.97 * 150, (n, met)


def test_within_is_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = random.Random(2)
    for _ in range(300):
        a, b = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(2)]
        for most in (0, 2, 5):
            got, d = decontam.within(a, b, most), plain(a, b)
            assert (got[0] if got else None) == (d if d <= most else None)


def test_packing(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice((0, 3, 50, 200, 900))), "x") for i in range(70)] + [(70, None, "x"), (71, "It's  odd's\n\n é 日本 <|endoftext|>", "x"), (72, "a<|endoftext|>b", "x"), (73, prose(rng, 30_000), "x"), (1, "again", "x"), (None, "null id", "x")]
    path = queries.tokenizer_path(spark)
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, start string"), path, shard_docs=30).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert t.encode("a<|endoftext|>b", add_special_tokens=False).ids == [64, 50256, 65]
    rows = [r for r in rows if r[1] != "again"]
    ids = {i: np.append(np.array(t.encode(x or "", add_special_tokens=False).ids, dtype="<u4"), np.uint32(0)).astype("<u4") for i, x, _ in rows}
    pieces, sequences = {}, {}
    again = np.append(np.array(t.encode("again", add_special_tokens=False).ids, dtype="<u4"), 0).astype("<u4")
    for r in out:
        if r.doc_id == 1 and r.doc_tokens == len(again) and r.ids_crc32 == zlib.crc32(again[r.start : r.start + r.length].tobytes()):
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            continue
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, x in ids.items():
        at = 0
        for s, n in sorted(pieces[i]):
            assert s == at
            at += n
        assert at == len(x)
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_repeats_solve_the_histogram():
    counts = np.zeros(16, dtype=np.int64)
    counts[[4, 6, 12, 10]] = [50, 30, 50, 30]
    combos = packing.combinations(16)
    x = packing.solve_repeats(counts, combos)
    fill = np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=16)
    fill[0] = 0
    assert (combos.sum(axis=1) == 16).all() and np.abs(fill - counts).sum() < 10


def plain_licenses(text, model, least=0.5, overlap=0.75):
    """``(paragraph, family, probability, overlap, confirmed)`` by plain Python."""
    names, lines = licenses.templates()
    found = []
    for p, paragraph in enumerate(re.split(licenses._PARAGRAPH, text) if text else []):
        own = []
        for sentence in re.split(licenses._SENTENCE, paragraph):
            if not re.search(licenses._ANCHOR, sentence):
                continue
            q = model.probabilities(sentence)
            family = model.classes[q.argmax()]
            if family != "none" and q.max() < least:
                family = "unknown"
            if family != "none":
                w = licenses.words_of(sentence)
                best = max([float(f" {' '.join(w)} ".find(n) >= 0) for f, n in names if f == family] + [len(set(x) & set(w)) / len(x) for f, x in lines if f == family] + [0.0])
                own.append((p, family, round(float(q.max()), 3), round(best, 3), best >= overlap))
        found += [x for x in own if x[1] != "Proprietary" or not any(y[4] and y[1] != "Proprietary" for y in own)]
    return found


def test_licenses(spark):
    texts = [
        "a\nReleased under the MIT License.\nb", "Der Hund mit der Katze", "Licensed under CC BY-NC 4.0.\nSPDX-License-Identifier: GPL-2.0-or-later", None, "", "His driving license was revoked",
        "Licensed under the Meadow License 2", "Released under MIT.", "This code is MIT-licensed.", "x\nLicensed under the Apache\nLicense, Version 2.0", "Mozilla\nPublic\nLicense",
        "Er wohnt hier mit zwei Freunden", "See the Apache\n\nLicense, Version 2.0", "All rights reserved.", "Copyright 2020 Foo. All rights reserved. Redistribution and use in source and binary forms, with or without\n"
        "modification, are permitted provided that the following\nconditions are met:\n\nReleased under the MIT License.", "word " * 60_000 + "\n \nReleased under the MIT License.", "Licensed under the Artistic License 2.0.", "\n\n\n",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in [*enumerate(texts), (0, texts[0]), (None, texts[0])]], "doc_id long, text string, found string")
    model = licenses.fit()
    rows = licenses.scan(df, model)
    for r in rows.collect():
        text = texts[r.doc_id or 0]
        got = [(x.paragraph, x.family, round(x.probability, 3), round(x.overlap, 3), x.confirmed) for x in r.found]
        assert got == plain_licenses(text, model), r.doc_id
        assert r.n_paragraphs == (len(re.split(licenses._PARAGRAPH, text)) if text else 0)
    got = {r.doc_id: r for r in licenses.digest(rows).collect()}
    assert [got[i].families for i in range(6)] == ["MIT", "", "CC-BY-NC,GPL", "", "", ""]
    assert got[6].n_confirmed == 0 and "unknown" in got[6].findings
    assert [got[i].families for i in range(7, 17)] == ["MIT", "MIT", "Apache", "MPL", "", "", "Proprietary", "BSD,MIT", "MIT", ""]


def test_licenses_held_out():
    """Forms and unknown names that the model has not seen, and not calibrated with."""
    model = licenses.fit()
    _, _, rows = licenses.notices()
    names, _ = licenses.templates()
    said = hit = wanted = 0
    for text, family in rows:
        q = model.probabilities(text)
        got = model.classes[q.argmax()] if q.max() >= 0.5 else "unknown"
        stated = got not in ("unknown", "none")
        said, wanted = said + stated, wanted + (family not in ("unknown", "none"))
        hit += stated and got == family
    assert hit / said >= 0.95 and hit / wanted >= 0.97
    assert all(frame not in licenses.FRAMES for frame in licenses.HELD_FRAMES)


def test_url_lists(spark):
    from datetime import datetime as D

    entries = [
        ("bad", "host", "a.example.com", "add", D(2024, 1, 10)), ("bad", "host", "a.example.com", "add", D(2024, 1, 20)), ("bad", "host", "a.example.com", "remove", D(2024, 2, 1)),
        ("spam", "domain", "example.com", "add", D(2024, 3, 1)), ("path", "path", "b.org/x/y", "add", D(2024, 1, 1)), ("tie", "host", "b.org", "add", D(2024, 1, 5)), ("tie", "host", "b.org", "remove", D(2024, 1, 5)), (None, "host", "b.org", "add", D(2024, 1, 1)),
    ]
    caps = [
        (1, "https://A.example.com:80/q", D(2024, 1, 9)), (2, "https://a.example.com/", D(2024, 1, 10)), (3, "https://u@a.example.com/", D(2024, 2, 1)), (4, "http://c.a.example.com", D(2024, 3, 2)),
        (5, "http://b.org/x/y/z?k", D(2024, 1, 6)), (6, "http://b.org/x", D(2024, 1, 6)), (7, None, D(2024, 1, 6)), (8, "odd", D(2024, 1, 6)), (9, "http://a.example.com", None), (2, "https://a.example.com/", D(2024, 1, 10)),
    ]
    c = spark.createDataFrame(caps, "capture_id long, url string, fetched_at timestamp").withColumn("kind", F.lit("clash"))
    out = url_filters.listed(c, spark.createDataFrame(entries, "list string, kind string, value string, action string, dated timestamp"))
    got = {r.capture_id: r.lists for r in out.collect()}
    assert got == {1: "", 2: "bad", 3: "", 4: "spam", 5: "path", 6: "", 7: "", 8: "", 9: ""}
    assert out.count() == len(caps)
    salted = url_filters.listed(c, spark.createDataFrame(entries, "list string, kind string, value string, action string, dated timestamp"), buckets=2, hot_rows=1)
    assert sorted(map(tuple, salted.fillna("").collect()), key=repr) == sorted(map(tuple, out.fillna("").collect()), key=repr)
    none = url_filters.listed(c, spark.createDataFrame([], "list string, kind string, value string, action string, dated timestamp"))
    assert none.filter("blocked").count() == 0 and none.count() == len(caps)
    assert url_filters.listed(c.limit(0), spark.createDataFrame([], "list string, kind string, value string, action string, dated timestamp")).count() == 0


def test_url_lists_of_long_paths(spark):
    from datetime import datetime as D

    entries = [("deep", "path", "b.org/1/2/3/4/5", "add", D(2024, 1, 1)), ("flat", "path", "b.org/1", "add", D(2024, 1, 1)), ("none", "path", "b.org", "add", D(2024, 1, 1))]
    urls = ["http://b.org/1/2/3/4/5/6?k", "http://b.org/1/2/3/4/5", "http://b.org/1/2/3/4/55", "http://b.org/2", "http://b.org"]
    c = spark.createDataFrame([(i, u, D(2024, 1, 6)) for i, u in enumerate(urls)], "capture_id long, url string, fetched_at timestamp")
    out = url_filters.listed(c, spark.createDataFrame(entries, "list string, kind string, value string, action string, dated timestamp"))
    assert {r.capture_id: r.lists for r in out.collect()} == {0: "deep,flat", 1: "deep,flat", 2: "flat", 3: "", 4: ""}


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (
        near_dedup.near_duplicates(nothing), exact_dedup.exact_duplicates(nothing), substring_dedup.remove_repeated_windows(nothing), pii.personal_data(nothing), quality.quality_scores(nothing, labels),
        html_text.main_text(pages), decontam.contaminated(nothing, items), packing.pack(nothing, queries.tokenizer_path(spark)), licenses.scan(nothing),
    ):
        assert out.count() == 0
