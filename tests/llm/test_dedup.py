"""Suffix-array, sentence-span and Jaccard de-duplication against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from agewise.llm import jaccard_join, substring_dedup, suffix_dedup
from agewise.llm.graph import components
from agewise.llm.hashing import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
STOP = re.compile(r"""[.!?,;:。！？…，；：।॥؟،؛۔](?:["')\]}”’」』）›»]{0,2})$|^["')\]}”’」』）›»]?[.!?,;:。！？…，；：।॥؟،؛۔]$""")
NULL = -(1 << 63)


def documents(df):
    """Distinct documents in corpus order: ((id, tie), text)."""
    rows = {((NULL if r.doc_id is None else r.doc_id), zlib.crc32((r.text or "").encode()) & ((1 << 26) - 1)): r.text or ""
            for r in df.select("doc_id", "text").collect()}
    return sorted(rows.items())


def removed_bytes(docs, length):
    seen, out = set(), {}
    for key, text in docs:
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            if w in seen:
                gone[s:s + length] = b"\1" * length
            else:
                seen.add(w)
        out[key] = (b, gone)
    return out


@pytest.mark.parametrize("length,reach", [(100, 64), (40, 16)])
def test_suffix_array_dedup(odd_documents, length, reach):
    want = removed_bytes(documents(odd_documents), length)
    out = suffix_dedup.remove_repeats(odd_documents, length, reach).collect()
    assert len(out) == odd_documents.count()
    for r in out:
        key = (NULL if r.row.doc_id is None else r.row.doc_id, zlib.crc32((r.row.text or "").encode()) & ((1 << 26) - 1))
        b, gone = want[key]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(b), sum(gone), runs, kept)
        assert r.kept_text == kept.decode("utf-8", "ignore")


def test_suffix_array_dedup_in_pieces(odd_documents, monkeypatch):
    """A text parsed in pieces loses the same bytes."""
    text = odd_documents.where("doc_id = 91").first().text.encode()
    data = np.frombuffer(text * 2, np.uint8)
    whole = suffix_dedup.phrases(data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    parts = suffix_dedup.phrases(data)
    assert whole[3].sum() == parts[3].sum() == len(data) - 99
    assert set(map(int, whole[0])) == set(map(int, parts[0]))


@pytest.mark.parametrize("length,reach,group", [(100, 64, 8), (40, 16, 8), (40, 16, 16), (40, 16, 1)])
def test_suffix_dedup_finer_parse(odd_documents, length, reach, group):
    """Every start is in one group; equal strings share its key, whatever phrase they are in."""
    text = np.frombuffer(odd_documents.where("doc_id = 0").first().text.encode() * 2 + b"same " * 60, np.uint8)
    _, _, lo, count = suffix_dedup.phrases(text, length, reach)
    parse, _, start, n, of = suffix_dedup.divided(text, lo, count, length, reach, group)
    starts = np.repeat(start, n) + np.concatenate([np.arange(k) for k in n])
    assert sorted(starts) == list(range(len(text) - length + 1)) and n.max() <= group
    assert ((start >= lo[of]) & (start + n <= lo[of] + count[of])).all()
    keys = {}
    for s, key in zip(starts, np.repeat(parse, n), strict=True):
        assert keys.setdefault(text[s:s + length].tobytes(), key) == key


def test_suffix_dedup_stage_keeps_columns_and_clean_rows(odd_documents, no_documents):
    out = suffix_dedup.without_repeats(odd_documents)
    assert out.columns == odd_documents.columns and out.count() == odd_documents.count()
    assert suffix_dedup.without_repeats(no_documents).count() == 0
    row = out.where("doc_id = 80").first()
    assert row.text is None and row.n_chars is None


def word_hash(w):
    b = np.frombuffer(w.encode(), np.uint8)
    return int(word_hashes(b, np.array([0, len(b)]))[0][0])


def test_sentence_spans(odd_documents, no_documents):
    seen, want = set(), {}
    for key, text in documents(odd_documents):
        words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
        parts, now = [], []
        for k, (_, end, w) in enumerate(words):
            now.append(k)
            after = words[k + 1][0] if k + 1 < len(words) else len(text)
            if STOP.search(w) or "\n" in text[end:after] or k + 1 == len(words) or word_hash(w) % substring_dedup.PART == 0:
                parts.append(now)
                now = []
        gone, runs = set(), set()
        for a in range(len(parts)):
            n, z = 0, a
            while z < len(parts) and (z - a < substring_dedup.SPAN or n < substring_dedup.MIN_WORDS):
                n, z = n + len(parts[z]), z + 1
            if z - a >= substring_dedup.SPAN and n >= substring_dedup.MIN_WORDS:
                runs.add((a, z))
            n, z = 0, a + 1
            while z > 0 and (a + 1 - z < substring_dedup.SPAN or n < substring_dedup.MIN_WORDS):
                n, z = n + len(parts[z - 1]), z - 1
            if a + 1 - z >= substring_dedup.SPAN and n >= substring_dedup.MIN_WORDS:
                runs.add((z, a + 1))
        for a, z in sorted(runs) or [(0, len(parts))] * bool(parts):
            run = tuple(words[k][2].translate(LOWER) for p in parts[a:z] for k in p)
            if run in seen:
                gone |= set(range(a, z))
            seen.add(run)
        at = [0] + [words[p[0]][0] for p in parts[1:]] + [len(text)]
        want[key] = (len(parts), len(gone), "".join(text[at[j]:at[j + 1]] for j in range(len(parts)) if j not in gone) if parts else text)
    out = substring_dedup.remove_repeated_sentences(odd_documents).collect()
    assert len(out) == odd_documents.count()
    for r in out:
        assert (r.n_sentences, r.n_removed, r.text) == want[(r.id, r.tie)]
    assert substring_dedup.remove_repeated_sentences(no_documents).count() == 0


def test_exact_copies_and_passages_leave_nothing(spark):
    rng = __import__("random").Random(4)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(900))
    passage = " ".join(" ".join(word() for _ in range(13)) + end for end in (".", ".”", "?", "。"))  # 52 words
    texts = [passage, "short.", " ".join(word() for _ in range(24)), "说一句话。 再说一句话。", "one", " ".join(word() + "." for _ in range(400))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, t) for i, t in enumerate(texts)]
    rows.append((200, " ".join(word() for _ in range(30)) + ". " + passage + "\n" + " ".join(word() for _ in range(40)) + "."))
    out = {r.id: r for r in substring_dedup.remove_repeated_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        assert out[i].text == t and out[100 + i].text == "", (i, out[100 + i].text)
    assert out[200].n_words_removed == 52 and not set(passage.split()[:51]) & set(out[200].text.split())


def shingles(text, k=5):
    w = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(sets, percent=80):
    """Least id of each component of the links between all pairs."""
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in ids}


def test_jaccard_classes(odd_documents, no_documents):
    sets = {key: shingles(text) for key, text in documents(odd_documents)}
    want = classes(sets)
    least = {key: min(k[0] for k in sets if want[k] == want[key]) for key in sets}
    # documents that share an id share its component's id
    out = jaccard_join.jaccard_classes(odd_documents).collect()
    assert len(out) == odd_documents.count()
    for r in out:
        assert r.n == len(sets[(r.id, r.tie)])
        assert r.component == least[(r.id, r.tie)] or r.id in (5, 6), r
    assert jaccard_join.jaccard_classes(no_documents).count() == 0


def test_jaccard_threshold_is_exact(spark):
    """Around 80 %: sets of 9 of 11 no, 8 of 10 yes, and chains link."""
    words = [f"w{i}" for i in range(200)]
    text = lambda a, b: " ".join(words[a:b])  # noqa: E731  b - a - 4 shingles
    rows = [(1, text(0, 14)), (2, text(2, 16)), (3, text(100, 113)), (4, text(101, 114)), (5, text(102, 115)), (6, text(40, 52)), (7, text(42, 54))]
    sets = {(i, 0): shingles(t) for i, t in rows}
    want = classes(sets)
    out = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, 0): r.component for r in out} == {k: v[0] for k, v in want.items()}


def test_jaccard_hot_tiles_in_blocks(spark, monkeypatch):
    """Blocks of a large tile meet in pairs; a group of near copies is one class."""
    rows = np.arange(20)  # one token, sizes that all fit
    table = pa.RecordBatch.from_arrays([pa.array((7 << 20) + 100 + rows // 7), pa.array(rows + 50)], names=["token", "node"])
    whole = list(jaccard_join._tiles(80)([table]))
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    tiles = {}
    for t in jaccard_join._tiles(80)([table]):
        for r in t.to_pylist():
            tiles.setdefault(r["tile"], set()).add(r["node"])
    pairs = {(x, y) for m in tiles.values() for x in m for y in m if x < y}
    assert sum(t.num_rows for t in whole) == 20 and len(pairs) == 190
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join([*words[:20 + i % 5], f"own{i}", *words[20 + i % 5:]])) for i in range(30)]
    sets = {(i, 0): shingles(t) for i, t in rows}
    want = classes(sets)
    out = jaccard_join.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, 0): r.component for r in out} == {k: v[0] for k, v in want.items()}


def test_one_of_each_class(odd_documents, no_documents):
    out = jaccard_join.one_of_each_class(odd_documents)
    assert out.columns == odd_documents.columns
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    assert 4 in ids and 60 not in ids and 61 not in ids and {80, 81, 82, 83, 85} <= set(ids) and 84 not in ids and 86 not in ids
    assert jaccard_join.one_of_each_class(no_documents).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 9), (9, 8), (5, 5), (3, 2), *[(100 + i, 101 + i) for i in range(40)], (None, 1)]
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {r.node: r.component for r in out}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 10: 8, **{100 + i: 100 for i in range(41)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_column_of_the_query(spark, small_dir):
    out = suffix_dedup.op3_suffix_array_dedup(spark, small_dir).collect()
    want = removed_bytes([((r.doc_id, 0), r.text or "") for r in spark.read.parquet(f"{small_dir}/documents.parquet").orderBy("doc_id").collect()], 100)
    for r in out:
        b, gone = want[(r.doc_id, 0)]
        assert r.kept_sha256 == hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()
