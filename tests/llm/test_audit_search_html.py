"""Source divergence, lexical search and main text of pages: against plain versions, and over odd rows."""

import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamctx.llm import divergence, html, lexical, staging

ODD = [None, "", " \t\n", "12 34", "é É ß ñ", "A a-A_a\x00a", "the " * 20000]


def prose(n, seed, vocabulary=60):
    r = random.Random(seed)
    return " ".join(f"{'abcdefgh'[r.randrange(8)]}{'xyz'[r.randrange(3)] * (1 + r.randrange(vocabulary // 12))}" for _ in range(n))


# --- source divergence


def plain_divergence(rows, min_df=3, most=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = term.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = []
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        groups = {s: c for (l, s), c in counts.items() if l == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in groups.items()}
        whole = share(sum(groups.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in groups:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in groups if o != s))
            terms = sorted((-f(p[s][t], whole[t]), t.encode()) for t in kept if groups[s][t] and p[s][t] > whole[t])[:most]
            for part, them in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(them, 1)]
    return sorted(out)


ROWS = [(prose(30, i), ["en", "fr", None][i % 3], f"s{i % 7}") for i in range(90)]
ROWS += [(t, "en", s) for t in ODD for s in ("s1", None, "bare")] + [("only two", "xx", "a"), ("only two", "xx", "b"), (None, "yy", None)] + [("Hot HOT hot", "en", "hot")] * 60


@pytest.mark.parametrize("min_df,most", [(3, 200), (1, 5), (40, 200)])
def test_divergence(documents, min_df, most):
    docs = documents([(i, *r) for i, r in enumerate(ROWS)])
    got = divergence.divergence(docs, min_df, most).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == plain_divergence(ROWS, min_df, most)


def test_divergence_of_nothing(documents):
    assert divergence.divergence(documents([])).count() == 0


def test_sums_are_those_of_count_vectors(spark, documents):
    """The vocabulary is CountVectorizer's, the sums are Summarizer's, which are not exact (a mean times a weight)."""
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.stat import Summarizer

    rows = [(i, prose(40, i), "en", f"s{i % 4}") for i in range(60)] + [(100, "rare", "en", "s1")]
    sums, groups = divergence.group_sums(documents(rows))
    got = {(r.source, r.term): r.n for r in sums.collect()}
    words = documents(rows).select("source", F.split("text", " ").alias("words"))
    model = CountVectorizer(inputCol="words", outputCol="v", minDF=3, vocabSize=2**31 - 1).fit(words)
    assert {t for _, t in got} == set(model.vocabulary)
    for r in model.transform(words).groupBy("source").agg(Summarizer.sum(F.col("v")).alias("v")).collect():
        assert {t: round(r.v[i]) for i, t in enumerate(model.vocabulary) if r.v[i]} == {t: n for (s, t), n in got.items() if s == r.source}
    assert sorted(r.source for r in groups.collect()) == ["s0", "s1", "s2", "s3"]


def test_shares_are_exact_beyond_longs(spark):
    n, total, terms = 9 * 10**15, 10**16 + 1, 10**9
    assert spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms))).first()[0] == 1 + 10**9 * (n + 1) // (total + terms)


def test_shared_sums_in_slices():
    r = np.random.default_rng(3)
    begins = np.array([0, 5, 6, 20], np.int64)
    source, p, p0 = np.concatenate([r.permutation(30)[:n] for n in (5, 1, 14, 10)]).astype(np.int64), r.integers(1, 10**9, 30), r.integers(1, 1000, 30)
    f = lambda x, y: int(x - y) ** 2 // int(y)
    want = Counter()
    for lo, hi in zip(begins, [*begins[1:], 30], strict=True):
        for i in range(lo, hi):
            for j in range(lo, hi):
                if i != j:
                    want[int(source[i]) << 32 | int(source[j])] += f(p[i], p[j]) - f(p[i], p0[j]) - f(p0[i], p[j]) + f(p0[i], p0[j])
    for most in (1, 7, 1 << 20):
        got = Counter()
        for codes, values in divergence.shared_sums(source, p, p0, begins, most):
            got.update(dict(zip(codes.tolist(), values.tolist(), strict=True)))
        assert got == want


# --- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ascii_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_search(rows, items, k):
    docs = [(i, Counter(ascii_terms(t))) for i, t in rows]
    docs = [(i, c) for i, c in docs if c]
    n, total = len(docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(ascii_terms(text)) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, rank, None if r[1] else r[2], -r[0]) for rank, r in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def found(spark, documents, rows, items, k=10, **how):
    docs = staging.stage(documents(rows), "test")
    asked = spark.createDataFrame(items, "item_id long, text string")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in lexical.search(docs, lexical.build_index(docs), asked, k, **how).collect()), key=str)


CORPUS = [(i, prose(5 + 3 * (i % 40), i)) for i in range(300)] + list(enumerate(ODD, 300)) + [(i % 7 + 400, "ax by cz ax") for i in range(60)] + [(None, "ax by dz"), (None, prose(3000, 9))]
ITEMS = [(0, "ax by"), (1, prose(20, 5)), (2, prose(60, 6)), (3, None), (4, "--- "), (5, "absent words only"), (6, "AX"), (7, "é 12"), (8, "ax by cz"), (8, "the")]


@pytest.mark.parametrize("k,seeds", [(10, 32), (3, 1), (1000, 32)])
def test_search(spark, documents, k, seeds):
    assert found(spark, documents, CORPUS, ITEMS, k, seeds=seeds) == plain_search(CORPUS, ITEMS, k)


def test_search_in_blocks_of_queries(spark, documents, monkeypatch):
    monkeypatch.setattr(lexical, "QUERIES", 3)
    monkeypatch.setattr(lexical, "BLOCK", 16)
    assert found(spark, documents, CORPUS, ITEMS) == plain_search(CORPUS, ITEMS, 10)


def test_search_of_nothing(spark, documents):
    assert found(spark, documents, [], ITEMS) == []
    assert found(spark, documents, CORPUS[:5], []) == []
    assert found(spark, documents, [(1, None), (2, " ")], ITEMS) == []


def test_bounds_never_fall_below_scores_and_leave_most_out():
    r = random.Random(4)
    texts = [prose(r.randrange(1, 400), i, 600).encode() for i in range(500)] + [b"ax " * 5000]
    batch = lexical.Batch.of([(i, prose(12, 1000 + i, 600).encode()) for i in range(20)])
    df = Counter(lexical.hashed(t) for x in texts for t in lexical.terms_of(x))
    batch.weigh(len(texts), sum(lexical.terms_of(x).total() for x in texts), df)
    block = lexical.Block(4096)
    entered = [lexical.of_document(np.array([lexical.hashed(t) for t in c], np.uint64), np.fromiter(c.values(), np.int64)) for c in map(lexical.terms_of, texts)]
    for x, e in zip(texts, entered, strict=True):
        block.add(e, (lexical.terms_of(x).total(), 0, "", b""))
    bounds = batch.bounds(block.row())
    exact = np.array([batch.scores(x, range(20)) for x in texts]).T
    assert (bounds >= exact).all()
    kth = np.sort(exact, axis=1)[:, -10]
    assert (bounds >= kth[:, None]).mean() < 0.06
    assert sum(len(e) for e in entered) > sum(len(lexical.terms_of(x)) for x in texts)  # terms that occur again are entered for each level


# --- main text of pages

P = "Some plain words of the article, with commas, and of a fair length for a paragraph. "
PAGES = {
    "article": (f"<body><nav><a href=/>x</a></nav><div class=ad>{P * 3}</div><article><h1>Title &amp; more</h1><p><b>{P}<br>{P}<p>Short.</p></article><footer>&copy; {P * 9}</footer>", ["Title & more", P + P, "Short."]),
    "boxes": (f"<div id=page-header>{P}</div><div id=content><h1>T</h1><p>{P}</p><p>{P}</p><ul><li>one<li>two</ul></div><div class=sidebar><p>{P * 5}</p></div>", ["T", P, P, "one", "two"]),
    "comments longer than the text": (f"<div class=post><h2>T</h2><div class=entry><p>{P}</p></div><div id=comments>{f'<div class=comment-body><p>{P}</p></div>' * 20}</div></div>", ["T", P]),
    "an article of comments": (f"<main><article><p>{P}</p><article class=comment><p>{P * 9}</p></article></article></main>", [P]),
    "sections": (f"<div class='content with-sidebar'><section><h2>A</h2><p>{P * 4}</p></section><section><h2>B</h2><p>{P}</p></section></div>", ["A", P * 4, "B", P]),
    "links": (f"<div><p>{P} <a href=x>a link</a> in text.</p><ul><li><a href=1>Home page of it</a></li><li><a href=2>All the other pages</a></li></ul><p>{P}</p></div>", [f"{P} a link in text.", P]),
    "roles": (f"<div role=navigation><p>{P * 9}</p></div><div><p>{P}</p></div><div hidden><p>{P * 9}</p></div><div style='display: none'>{P * 9}</div>", [P]),
    "script": (f"<div><script>var t = '</p><p>{P * 9}';</script><p>{P}</p><style>p{{}}</style><!-- <p>{P * 9}</p> --></div>", [P]),
    "table": (f"<table><tr><td>{P}<td>{P}</table>", [P, P]),
    "header of an article": (f"<header>{P * 9}</header><article><header><h1>Title</h1></header><p>{P}</p><aside>{P * 9}</aside><form>{P * 9}</form></article>", ["Title", P]),
    "a quoted mark": (f'<div title="a > b"><p class=">">{P}</p></div>', [P]),
    "plain text": (f"{P}\n\n  {P} a < b", [f"{P}  {P} a < b"]),
    "references": ("<p>&lt;b&gt; &eacute; &#233; &#x1F600; &amp;amp; &nosuch; &nbsp;x</p>", ["<b> é é 😀 &amp; &nosuch; x"]),
    "empty": ("<html><body></body></html>", []),
    "a menu only": ("<nav><a href=1>x</a></nav>", []),
    "a box around text and sidebar": (f"<div class='content-sidebar-wrap has-ads'><div class=main-content><p>{P}</p></div><div id=mainMenu><p>{P * 9}</p></div><div class='col ad-wrapper'>{P * 9}</div></div>", [P]),
    "header of a post": (f"<div class=post><div class=post-header><h1>T</h1></div><div class=entry><p>{P}</p></div><div class=post-footer>{P * 4}</div></div>", ["T", P]),
    "cut off": (f"<article><p>{P}</p><p>{P}<a hre", [P, P]),
}


@pytest.mark.parametrize("name", PAGES)
def test_main_text(name):
    page, want = PAGES[name]
    assert html.main_text(page) == "\n\n".join(" ".join(x.split()) for x in want)


def test_pages_keep_ids_and_odd_rows(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<p>a\nb</p><p> </p>"), (3, "v", ""), (4, "w", "<p>😀é")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in html.extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (1, "u", "", 0), (None, None, "a b", 3), (3, "v", "", 0), (4, "w", "😀é", 2)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page", ["<" * 200_000, "<!--" * 50_000, "<a " * 50_000, "<p x=\"" * 50_000, "<div>" * 100_000 + "x", "</div>" * 100_000, "<p>" * 100_000, "<li>" * 100_000, "<script>" * 50_000, "<table><tr><td>" * 20_000, "a " * 1_000_000, "<nav>" * 50_000, "&" * 300_000])
def test_long_pages_take_linear_time(page):
    began = time.perf_counter()
    html.main_text(page)
    assert time.perf_counter() - began < 8
