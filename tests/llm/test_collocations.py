"""Collocations against counts of every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from agewise.llm import collocations as co

LOWER = {c: c + 32 for c in range(65, 91)}


def expected(rows, top, least):
    counts: dict = {}
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = tuple(re.findall("[^\x20\x09]+", piece))
            c = counts.setdefault(lang or "und", Counter())
            c.update(words[i:i + k] for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for lang, c in counts.items():
        n, found = sum(v for p, v in c.items() if len(p) == 1), []
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            if len(p) == 2 and any(len(q) == 3 and 100 * b >= 50 * a and p in (q[:2], q[1:]) for q, b in candidates.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def texts(seed=3):
    rng, rows = random.Random(seed), []
    passages = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(30)) for _ in range(9)) for _ in range(12)]
    for i in range(150):
        body = [rng.choice(passages) if rng.random() < .3 else " ".join(rng.choice(["New", "york", "City", "é", "d", "e"]) for _ in range(7))
                for _ in range(8)]
        rows.append((rng.choice(["en", "en", "de", None]), rng.choice([" ", ". ", "\t", ",", "\n", " \x00 "]).join(body)))
    return rows + [("en", None), ("fr", ""), ("fr", " .,; "), ("es", "one"), ("en", "x " * 3000), ("xx", "solo words here " * 20)]


@pytest.mark.parametrize("top,least,width,grow,bits", [(2000, 10, 2, 8, 1 << 16), (15, 10, 1, 2, 1 << 16), (5, 3, 1, 2, 1 << 15), (40, 2, 1, 3, 1 << 18)])
def test_equals_all_phrases_counted(spark, top, least, width, grow, bits):
    """Also where bars go down several times, and where bitmaps let much through."""
    rows = texts()
    df = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 as x", "2 as a", "3 as n").repartition(3)
    got = sorted(tuple(r) for r in co.collocations(df, top, least, width, grow, bits).collect())
    assert got == expected(rows, top, least)


def test_counts_are_sent_early_and_in_pieces(monkeypatch):
    import pyarrow as pa
    rows = [(a or "und", b or "") for a, b in texts(8)]

    def counted():
        got = Counter()
        source = iter([pa.RecordBatch.from_pydict({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})])
        sent = sorted((r for b in co._words(0, 5)(source) for r in b.to_pylist()), key=lambda r: r["bucket"])
        for batch in co._added(1, 1)(iter([pa.RecordBatch.from_pylist(sent, schema=co._SENT)])):
            got.update({(r["lang"], r["word"]): r["n"] for r in batch.to_pylist()})
        return got, len(sent)
    want, few = counted()
    assert want["en", "x"] == 3000 and ("en", None) not in want
    monkeypatch.setattr(co, "HELD", 50)
    monkeypatch.setattr(co, "HELD_WORDS", 40)
    monkeypatch.setattr(co, "PIECE", 100)
    monkeypatch.setattr("agewise.llm.hashing.PIECE", 64)
    got, many = counted()
    assert got == want and many > 2 * few


def test_words_with_one_fingerprint_show():
    import pyarrow as pa
    key, n = np.array([7], np.uint64).tobytes(), np.array([3]).tobytes()
    sent = pa.RecordBatch.from_pylist([{"bucket": 0, "langs": ["en"], "keys": key, "counts": n, "words": w} for w in (b"0 a", b"0 b")], schema=co._SENT)
    assert [r["word"] for b in co._added(1, 1)(iter([sent])) for r in b.to_pylist()] == [None]


def test_empty_table(no_documents):
    assert co.collocations(no_documents).count() == 0


def test_products_beyond_64_bits(spark):
    a, left, right = 9 * 10 ** 13, 95 * 10 ** 12, 99 * 10 ** 12
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(co._ratio("a a", "l r", "s")).first().s
    assert got == 10 ** 6 * a * a // (left * right)
