"""SimHash classes against fingerprints made word by word and all pairs compared."""

import random

import numpy as np
import pytest
import xxhash

from agewise.llm import simhash_index as si
from agewise.llm.graph import components

LOWER = {c: c + 32 for c in range(65, 91)}


def slow_fingerprint(text, k=4):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def slow_components(codes, most=4):
    """The least code reachable, of each distinct code."""
    codes, root = sorted(codes), {}
    for c in codes:
        root[c] = c

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(codes):
        for b in codes[i + 1:]:
            if (a ^ b).bit_count() <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {c: find(c) for c in codes}


def balls(seed, n=500):
    """Codes around a few centres, in chains and on their own."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(5)]
    out = {0, (1 << 64) - 1, 15, 255}
    while len(out) < n:
        c = rng.choice(centres)
        for _ in range(rng.randrange(9)):
            c ^= 1 << rng.randrange(64)
        out.add(c if rng.random() < .8 else rng.getrandbits(64))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_forest_joins_what_all_pairs_join(seed):
    codes = np.array(sorted(balls(seed)), np.uint64)
    bucket = np.arange(len(codes)) % 3 if seed % 2 else np.zeros(len(codes), int)
    forest = si.GrayForest(bucket, codes, 4)
    label = forest.spanning(4)
    for b in set(bucket.tolist()):
        want = slow_components([int(c) for c in codes[bucket == b]])
        place = {int(c): i for i, c in enumerate(forest.codes)}
        classes = {}
        for c, r in want.items():
            classes.setdefault(r, set()).add(int(label[place[c]]))
        assert all(len(x) == 1 for x in classes.values()) and len({x for y in classes.values() for x in y}) == len(classes)


@pytest.mark.parametrize("sizes", [{}, {"limit": 20, "free": 30, "share": 10}, {"limit": 4, "free": 12, "share": 2}])
def test_links_connect_what_all_pairs_connect(spark, sizes):
    """Also where buckets are divided, before the shuffle and behind it."""
    codes = balls(9)
    df = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    got = {r.node & si._ALL: r.component & si._ALL for r in components(si.links(df, **sizes)).collect()}
    want = slow_components(codes)
    pairs = {}
    for c in codes:
        pairs.setdefault(got.get(c, c), set()).add(want[c])
    assert all(len(x) == 1 for x in pairs.values()) and len(pairs) == len(set(want.values()))


def test_fingerprints_of_long_texts(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["Ab", "cDé", "x" * 50, "z"]) + rng.choice(["", "\t", "\n\x0b"]) for _ in range(400))
    data = np.frombuffer(text.encode(), np.uint8)
    want = slow_fingerprint(text)
    assert si.fingerprint(data) == want
    monkeypatch.setattr("agewise.llm.hashing.PIECE", 64)
    assert si.fingerprint(data) == want


def test_classes_equal_brute_force(spark, odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    codes = [slow_fingerprint(t) for _, t in rows]
    root, least = slow_components(set(codes)), {}
    for (i, _), c in zip(rows, codes, strict=True):
        least[root[c]] = min(least.get(root[c], 1 << 62), -1 if i is None else i)
    want = sorted((-1 if i is None else i, f"{c:016x}", least[root[c]]) for (i, _), c in zip(rows, codes, strict=True))
    got = sorted((max(-1, r.id), f"{r.code & si._ALL:016x}", max(-1, r.component)) for r in si.simhash_classes(odd_documents).collect())
    assert got == want


def test_empty_table(no_documents):
    assert si.simhash_classes(no_documents).count() == 0
