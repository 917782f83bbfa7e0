"""The other operators and the pipeline, against brute force or held-out data."""

import math
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_dedup import classes, removed_bytes, shingles
from agewise.llm import decontaminate, html_extract, licenses, mixing, quality_model, quality_rules, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tie(text):
    return zlib.crc32((text or "").encode()) & ((1 << 26) - 1)


def test_decontamination_finds_exact_and_changed_items(spark, odd_documents, no_documents):
    item = "the quick brown fox jumps over a lazy dog while seven green birds watch from an old stone wall nearby"
    words = item.split()
    changed = list(words)
    changed[3], changed[11] = "cat", "blue"
    docs = [(1, f"before {item} after"), (2, "x " + " ".join(changed).upper() + "!"), (3, "x " * 30), (4, " ".join(words[:9]) + " and then something else"),
            (5, None), (6, ""), (7, " ".join(reversed(words))), (8, "Éa ÜB " + "one two three four five six seven eight NINE"),
            (9, "prefix " + " ".join(words[:14])), (1, f"before {item} after")]
    items = [(10, item), (11, "one two three four five six seven eight nine"), (12, "too short"), (13, None), (10, item), (None, item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.id, r.item) for r in decontaminate.contaminations(d, b).collect()}
    null = -(1 << 63)
    assert got == {(1, 10), (2, 10), (9, 10), (8, 11), (1, null), (2, null), (9, null)}
    left = decontaminate.without_contaminated(d, b)
    assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6, 7] and left.columns == d.columns
    assert decontaminate.contaminations(d, b.where("1 = 0")).count() == 0
    assert decontaminate.without_contaminated(no_documents, b).count() == 0
    assert decontaminate.without_contaminated(odd_documents, b).count() == odd_documents.count()


def test_seed_verification_against_all_diagonals():
    rng = np.random.default_rng(3)
    item = rng.integers(1, 1 << 60, 30).astype(np.uint64)
    doc = np.concatenate([rng.integers(1, 1 << 60, 50).astype(np.uint64), item, rng.integers(1, 1 << 60, 50).astype(np.uint64)])
    assert decontaminate.covered(doc, item, range(-30, 130)) == 30
    doc[50 + np.array([6, 14, 22])] = 5
    assert decontaminate.covered(doc, item, [50]) == 30  # equal tokens at both ends, nine in ten equal
    assert decontaminate.covered(doc, item, [49]) == 0


def test_quality_classifier_held_out(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = {r.doc_id: r for r in quality_model.op6_quality_classifier(spark, "/root/testdata/sf0.01").collect()}
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in out.items())
    held = [(out[r.doc_id].score, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert np.mean([g >= 0.3 for g in good]) > 0.98
    # labels of held-out rows don't matter
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert np.array_equal(quality_model.fit(docs, labels), quality_model.fit(docs, flipped))
    weights = quality_model.fit(odd_documents, labels.selectExpr("doc_id", "cast(null as int) as quality"))
    rows = quality_model.score(odd_documents, weights).collect()
    assert len(rows) == odd_documents.count() and all(r.score == 0.5 for r in rows)
    assert quality_model.score(no_documents, weights).count() == 0
    kept = quality_model.accepted(odd_documents, labels)
    assert kept.columns == odd_documents.columns


def test_quality_rules(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (2, 1, 1), (88, 0, 0), (None, 1, 0), (0, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules.assess(odd_documents, labels).collect()
    texts = defaultdict(set)
    for r in odd_documents.collect():
        texts[-(1 << 63) if r.doc_id is None else r.doc_id].add(r.text or "")
    assert len(out) == odd_documents.count()
    for r in out:
        want = []
        for t in texts[r.id]:
            w = WORD.findall(t)
            lines = [x for x in t.split("\n") if WORD.search(x)]
            seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
            cover = {j for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
            want.append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover),
                         len(w) < 10 or 100 * len(cover) > 20 * len(w)))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) in want
        assert not (r.base_failed and r.kept)
    assert quality_rules.assess(no_documents, labels).count() == 0


def test_quality_rules_likelihood_ratio(spark):
    """The score from the weights, n-gram by n-gram; label-1 rows stay, junk goes."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    weight = {r.bucket: r.weight for r in quality_rules.weights(docs, labels).collect()}
    assert len(weight) == quality_rules.BUCKETS
    n = quality_rules.BUCKETS  # the n-grams of a text in one row: marks of last characters, words, pairs
    grams = docs.select("doc_id", quality_rules.words_column().alias("words")).withColumns(
        {"hashes": quality_rules.hashes_column(), "ends": F.expr("transform(words, w -> least(128, ascii(substring(w, -1, 1))))")}).selectExpr("doc_id", f"""if(size(words) = 0, array(), concat(
        transform(ends, c -> get({quality_rules.mark_buckets(spark)}, c)), transform(hashes, h -> pmod(h, {n})),
        zip_with(slice(hashes, 1, size(words) - 1), slice(hashes, 2, size(words) - 1), (g, h) -> pmod(if(g = h, 3L, xxhash64(g, h)), {n})))) as g""").collect()
    want = {r.doc_id: sum(weight[g] for g in r.g) / max(1, len(r.g)) / 1e6 for r in grams}
    raw, target, trusted = Counter(), Counter(), {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    for r in grams:
        raw.update(r.g)
        if r.doc_id in trusted:
            target.update(r.g)
    n, all_raw, all_target = quality_rules.BUCKETS, sum(raw.values()), sum(target.values())
    for b in range(0, n, 97):
        w = math.log((target[b] + 1) / (all_target + n)) - math.log((raw[b] + 1) / (all_raw + n))
        assert abs(weight[b] - w * 1e6) <= 1
    out = {r.doc_id: r for r in quality_rules.op8_quality_rules(spark, sf).collect()}
    for i, r in out.items():
        assert abs(r.score - want[i]) < 1e-9 and r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)
    passed = [(r.quality, out[r.doc_id].kept) for r in labels.collect() if not out[r.doc_id].base_failed]
    assert all(k for q, k in passed if q == 1) and np.mean([not k for q, k in passed if q == 0]) > 0.9


@pytest.mark.parametrize("docs", ["odd", "tables"])
def test_token_counts(spark, odd_documents, no_documents, docs):
    scores = token_counts.load_vocabulary()
    fallback, longest = min(scores.values()) - 5, max(map(len, scores))

    @lru_cache(None)
    def best(w):
        rows = [(0.0, 0)]
        for i in range(1, len(w) + 1):
            x = (rows[i - 1][0] + fallback, rows[i - 1][1] + 1)
            for k in range(1, min(longest, i) + 1):
                if w[i - k:i] in scores:
                    y = (rows[i - k][0] + scores[w[i - k:i]], rows[i - k][1] + 1)
                    if y[0] > x[0] + 1e-9 or abs(y[0] - x[0]) <= 1e-9 and y[1] < x[1]:
                        x = y
            rows.append(x)
        return rows[-1]

    def pre(word):
        b, first = word.encode(), True
        while b:
            c = len(b) if len(b) <= token_counts.MAX_BYTES else token_counts.MAX_BYTES
            while c < len(b) and b[c] & 0xC0 == 0x80:
                c -= 1
            yield ("▁".encode() if first else b"") + b[:c]
            b, first = b[c:], False

    df = odd_documents.where("doc_id <> 91 or doc_id is null") if docs == "odd" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    want = {}
    for r in df.collect():
        parts = [best(p) for w in WORD.findall(r.text or "") for p in pre(w)]
        want[(-(1 << 63) if r.doc_id is None else r.doc_id, tie(r.text))] = (len(parts), sum(n for _, n in parts), sum(s for s, _ in parts))
    out = token_counts.count_tokens(df, scores).collect()
    assert len(out) == df.count()
    for r in out:
        n, tokens, score = want[(r.id, r.tie)]
        assert (r.n_pretokens, r.n_tokens) == (n, tokens) and abs(r.score - score) <= 1e-6 * max(1, abs(score))
    assert token_counts.count_tokens(no_documents, scores).count() == 0


def test_trie_visits_shared_prefixes_once():
    words = [b"shared", b"sharing", b"share", b"other"]
    n = np.array([len(w) for w in words])
    chars = np.zeros((4, n.max()), np.uint8)
    for i, w in enumerate(words):
        chars[i, :len(w)] = np.frombuffer(w, np.uint8)
    _, _, nodes = token_counts.forward(chars, n, token_counts.Pieces({b"sh": -1.0, b"ar": -1.0, b"e": -1.0}))
    assert nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)})


def test_mixing(spark, odd_documents, no_documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for df, near in ((docs, 0.02), (odd_documents, None)):
        rows = mixing.mix(df).collect()
        assert len(rows) == df.count()
        sizes, taken, targets = Counter(), Counter(), {}
        for r in rows:
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            targets[r.source] = r.target
            assert r.taken <= 2 * r.size and r.taken == r.copies * r.size
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
        left, free, want = 1.5 * sum(sizes.values()), set(order), {}
        while free:
            total = sum(weight[s] for s in free)
            over = [s for s in free if left * weight[s] / total > 2 * sizes[s] + 1e-9]
            if not over:
                want |= {s: left * weight[s] / total for s in free}
                break
            for s in over:
                want[s] = 2.0 * sizes[s]
                left -= want[s]
                free.discard(s)
        for s in order:
            assert abs(targets[s] - want[s]) <= 1e-6 * max(1, want[s])
            if near:
                assert abs(taken[s] - want[s]) <= max(near * want[s], 100), s
        again = mixing.mix(df.repartition(7)).collect()
        key = lambda r: (r.id, r.tie, r.source or "", r.copies)
        assert sorted(map(key, again)) == sorted(map(key, rows))
    assert mixing.mix(no_documents).count() == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(5)
    units = [(i, float(s), 0.37) for i, s in enumerate(rng.integers(0, 500, 2000))]
    out = dict(mixing.flight(units, mixing._draws(9)))
    assert sum(p not in (0.0, 1.0) for p in out.values()) <= 2
    assert abs(sum(out.values()) - 0.37 * 2000) < 1e-6
    assert abs(sum(p * units[i][1] for i, p in out.items()) - 0.37 * sum(u[1] for u in units)) < 1e-3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="header-fixed"><header><h1>Site</h1></header>
<nav><a href=1>Home</a></nav><div class="cookie-notice">We use cookies, ok, fine, yes, really, indeed.</div><div id=wrap>
<div class="sidebar"><p>Side, bar, text, with, many, commas, here, and, there, long enough to score.</p></div>
<div id="content"><h2>Title &amp; more</h2><p>First para, with text. <a href=2>link</a> and&nbsp;more<p>Second   para
 here, with, commas &#233; <b>bold</b>ness</p><ul><li><a href=1>Rel one</a></li><li><a href=2>Rel two</a></li></ul></div>
<div id="comments"><p>I, a reader, say, things, at, length, for, ever, and ever, and, so, on.</p></div></div>
<form><p>subscribe, now</p></form><script>var t="</p>";</script><footer>c</footer></body></html>"""


def test_html_extraction(spark):
    text = "Title & more First para, with text. link and more Second para here, with, commas é boldness"
    cases = [(1, "u", PAGE, text), (2, "u", None, ""), (3, None, "", ""), (4, "u", "plain <text", "plain"), (5, "u", "<p>a<p>b", "a b"),
             (6, "u", "<article><h1>H</h1><div><p>One, two.</p></div><aside>x</aside><p>3 &lt; 4</p></article>", "H One, two. 3 < 4"),
             (7, "u", "<nav>menu only</nav>", ""), (1, "u", PAGE, text), (None, "v", "<div>x<b>y</b>z</div><!-- c", "xyz"),
             (8, "u", "<p>" + "<b>" * 3000 + "deep" + "</b>" * 3000, "deep")]
    df = spark.createDataFrame([c[:3] for c in cases], "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as row")
    assert [r.text for r in html_extract.extract(df).collect()] == [c[3] for c in cases]
    assert html_extract.extract(df.where("1 = 0")).count() == 0


LONG = "<p>A first paragraph, with commas, and words, so that it scores, well, above the rest of the page, by far.</p>" * 3


@pytest.mark.parametrize("html, kept, gone", [
    # beside the best container: a short section, a closing box; a menu and an unmarked box of links go
    (f"<body><div>{LONG}</div><section><h2>Also</h2><p>Brief.</p></section><div><p>The end.</p></div>"
     "<div><a href=1>Home</a> <a href=2>Away</a></div></body>", ["Also Brief.", "The end."], ["Home", "Away"]),
    # a list of references stays with its heading, also within a box; a menu of links without one goes
    (f"<article>{LONG}<div><h2>References</h2><ol><li><a href=1>Smith 2001</a></li><li><a href=2>Doe 2002</a></li></ol></div>"
     "<ul><li><a href=1>Prev</a></li><li><a href=2>Next</a></li></ul></article>", ["References Smith 2001 Doe 2002"], ["Prev", "Next"]),
    (f"<article>{LONG}<p>See also the sources:</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>End.</p></article>",
     ["sources: One Two End."], []),
    (f"<article>{LONG}<h3>Related stories</h3><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul><p>End.</p></article>",
     ["by far. End."], ["Related", "One", "Two"]),
    # paragraphs named after a topic stay, those that are links go; notices and adverts go whatever their tag
    (f'<article>{LONG}<p class="social">A social matter.</p><p id="tags">Price tags, old.</p><p class="tags"><a href=1>t1</a> <a href=2>t2</a></p>'
     '<p class="notice">Closed.</p><p class="advert">Buy.</p></article>', ["A social matter. Price tags, old."], ["t1", "t2", "Closed", "Buy"]),
    # readers' comments of any length don't beat the article; its header goes; of two articles the better one is the text
    (f'<article><header><h1>Title</h1></header>{LONG}</article><div id="discussion">{LONG * 9}Reader</div>', ["by far."], ["Title", "Reader"]),
    (f"<article>{LONG}</article><article><p>Teaser.</p></article>", ["by far."], ["Teaser"]),
])
def test_html_extraction_keeps_article_text(html, kept, gone):
    text = html_extract.main_text(html)
    assert all(k in text for k in kept) and not any(g in text for g in gone), text


def test_html_extraction_of_the_table(spark, small_dir):
    """The table's pages put their article between plain tags."""
    import html
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small_dir}/pages.parquet").collect()}
    for r in html_extract.op7_html_extraction(spark, small_dir).collect():
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(h1|p|br|li)[^>]*>", " ", body))
        assert r.text == " ".join(html.unescape(body).split()) and r.n_chars == len(r.text)


def test_licenses(spark):
    apache, mit = "Licensed under the Apache License, Version 2.0.", "// Released under the MIT License."
    files = [("a/LICENSE", "intro\n" + apache), ("a/b/x.py", "code\n" + mit), ("a/b/y.py", "code"), ("a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
             ("a/b/c/z.py", None), ("ab/q.py", ""), ("top.py", "the use of this"), (None, mit), ("a/b/y.py", "code"), ("a/NOTLICENSE", "x")]
    df = spark.createDataFrame(files, "path string, text string").selectExpr("*", "1 as line", "2 as license")
    got = [(r.path, r.license, r.how, r.from_path) for r in licenses.scan(df).collect()]
    assert len(got) == len(files) and set(got) == {
        ("a/LICENSE", "Apache-2.0", "own", None), ("a/b/x.py", "MIT", "own", None), ("a/b/y.py", "Apache-2.0", "inherited", "a/LICENSE"),
        ("a/b/c/COPYING.txt", "GPL-3.0", "own", None), ("a/b/c/z.py", "GPL-3.0", "inherited", "a/b/c/COPYING.txt"),
        ("ab/q.py", None, "none", None), ("top.py", None, "none", None), (None, "MIT", "own", None), ("a/NOTLICENSE", "Apache-2.0", "inherited", "a/LICENSE")}
    assert licenses.scan(df.where("1 = 0")).count() == 0


def test_license_headers_over_lines(spark):
    notice = ("/* This program is free software: you can redistribute it\n * and/or modify it under the terms of the GNU {}General Public License as published by\n"
              " * the Free Software Foundation, either version {} of the License, or (at your option)\n * any later version.\n *\n"
              " * This program is distributed in the hope that it will be useful. */\nint main() {{}}")
    title = "                    GNU {}GENERAL PUBLIC LICENSE\n                       Version {}, {}\n\n Copyright (C) Free Software Foundation, Inc.\n Everyone is permitted to copy it\n"
    whole = dict(licenses._WHOLE)
    wrap = lambda text: "Copyright (c) 2020 A. Nybody\n\n" + re.sub(r"((?:\S+ ){9})", r"\1\n", text)
    cases = {"a.py": ("# Licensed under the GNU General Public\n# License, version 3 or later.\nimport os", "GPL-3.0"),
             "b.py": ("# Licensed under the GNU General Public\n# License, version 2 or later.\nimport os", "GPL-2.0"),
             "c.c": (notice.format("", 3), "GPL-3.0"), "d.c": (notice.format("", 2), "GPL-2.0"), "e.c": (notice.format("Lesser ", "2.1"), "LGPL-2.1"),
             "f.c": (notice.format("Affero ", 3), "AGPL-3.0"), "g/COPYING": (title.format("", 3, "29 June 2007"), "GPL-3.0"),
             "h/COPYING": (title.format("", 2, "June 1991"), "GPL-2.0"), "i/COPYING": (title.format("LESSER ", 3, "29 June 2007"), "LGPL-3.0"),
             "j/LICENSE": ("  Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n", "Apache-2.0"),
             "k/x.c": ("# GNU General Public License\n", "GPL"), "k/y.c": ("see the GNU General Public License for more", None),
             "l.txt": ("words before\nLicensed under CC\n\nBY-NC 4.0", None), "l2.txt": ("words before\nLicensed under CC\nBY-NC 4.0", "CC-BY-NC-4.0"),
             "m.py": ("the public may use and copy this for any purpose, with a fee", None), "n.py": ("x " * 30_000 + "\nLicensed under CC BY 4.0.", "CC-BY-4.0"),
             **{f"w{k}/LICENSE": (wrap(whole[k]), k) for k in whole}}
    df = spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")
    assert {r.path: r.license for r in licenses.scan(df).collect()} == {p: want for p, (_, want) in cases.items()}


def test_license_scan_twin(spark):
    import duckdb
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    out = licenses.op2_license_scan(spark, sf)
    want = {tuple(None if isinstance(x, float) and x != x else x for x in r) for r in con.sql(f"select {', '.join(out.columns)} from ({licenses.oracle()})").fetchall()}
    assert {tuple(r) for r in out.collect()} == want


def test_pipeline_stages(spark, odd_documents, no_documents, small_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "mixing_sources"]
    for docs in (odd_documents, no_documents):
        rows = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before, rows = rows, stage(spark, rows, small_dir)
            if k < 4:
                assert rows.columns == docs.columns and rows.count() <= before.count()
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_against_brute_force(spark, small_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, small_dir).collect()}
    scored = {r.doc_id: r.predicted for r in quality_model.op6_quality_classifier(spark, small_dir).collect()}
    left = {(i, 0): t for i, t in docs.items() if scored[i]}
    of = classes({k: shingles(t) for k, t in left.items()})
    left = sorted((k, t) for k, t in left.items() if of[k] == k)
    cut = {}
    for k, (b, gone) in removed_bytes(left, 100).items():
        cut[k[0]] = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    token = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
    items = [token.findall(r.text.lower()) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]

    def contains(words):  # on every diagonal, not only where seeds hit
        for item in items:
            ids = {w: i + 1 for i, w in enumerate(item)}
            a, b = (np.array([ids.get(w, 0) for w in x]) for x in (words, item))
            found = {d for n, w in enumerate(words) for m, v in enumerate(item) if w == v for d in [n - m]}
            if found and decontaminate.covered(a, b, sorted(found)) >= decontaminate.needed(len(item)):
                return True
        return False

    want = {i: t for i, t in cut.items() if not contains(token.findall(t.lower()))}
    assert set(out) == set(want)
    assert all(out[i].size == len(WORD.findall(t)) and 0 <= out[i].taken <= 2 * out[i].size for i, t in want.items())
