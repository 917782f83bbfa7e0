"""SimHash near-duplicates: 64-bit fingerprints of word shingles, classes by links of few differing bits.

A document's shingles are its runs of ``k`` lower-cased words, repeats included, joined by one space
(with fewer words: the whole sequence).  A fingerprint's bit is 1 if more than half of the shingles'
XXH64 values (seed 42) have it; without words the fingerprint is zero.

Method, a Gray-order hierarchical index:

1. Equal fingerprints are one code, gathered by an aggregation; everything below sees distinct codes.
2. *Buckets.*  The 64 bits are cut in ``most + 2`` blocks; two codes that differ in at most ``most`` bits
   agree on at least two blocks, so every pair to link meets in a bucket of equal bits on two blocks (15
   choices for 4 bits).  A bucket of more than ``BUCKET`` codes is divided again in the same way by the
   bits that are still free, so its pairs meet in smaller buckets; where at most ``FREE`` bits are free it
   holds at most 2**``FREE`` codes.  Buckets that hold a large share of all codes are divided before any
   shuffle (their number is bounded by that share), others as a task streams over them, so no bucket is
   gathered beyond its bound.
3. *Index.*  A task sorts a bucket's codes by Gray rank, so that neighbours share most bits, and builds a
   tree over windows of ``FAN`` of them.  A node has the bits that all codes below it share, as a mask and
   a pattern; bits that the node above has already are left to that one.  The join goes down from (root,
   root): a pair of nodes has the differences on the bits that both share, those of the pair above plus
   those that become shared here.  More than ``most``: the pair ends, with all below it.  So few differences
   and free bits that no two codes below can differ by more: the whole groups link at once.  Pairs of groups
   that are already in one component end as well, so a group of near copies is linked without all its pairs.
4. A bucket gives each member's link to the least member of its component there (fewer rows than
   members); these links give the components of all codes, and a code's component its least doc_id.

Links are exact: only pairs within the distance, or groups whose every pair is, are joined.

Defined results: null and empty texts have fingerprint zero and link like any other; rows that repeat a
doc_id are each given their own text's class; a null doc_id counts as the smallest (component_id null
where it is that one); an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import bytes_and_offsets, id_column, original_id, partitions
from agewise.llm.graph import components
from agewise.llm.hashing import U, signed, text_pieces
from agewise.session import materialize

K, MOST, SEED = 4, 4, 42
#: Codes that a task indexes at a time, unless so few bits are free that there can't be many more.
BUCKET, FREE = 1 << 14, 18
#: Buckets of more than one in so many codes are divided before they are shuffled.
SHARE = 1000
FAN = 8
#: Node pairs that are looked at in one step.
STEP = 1 << 14
_ALL = (1 << 64) - 1


def fingerprint_counts(data: np.ndarray, k: int = K) -> tuple[int, np.ndarray]:
    """Number of shingles of a text (bytes) and, for each bit, how many of their hashes have it."""
    total, bits, carry, few = 0, np.zeros(64, np.int64), [], True
    for a, b in text_pieces(data, 0, len(data)):
        words = carry + data[a:b].tobytes().lower().split()
        if len(words) < k:
            carry = words
            continue
        few = False
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        h = np.fromiter([digest(line[s:e], SEED) for s, e in zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)],
                        U, len(words) - k + 1)
        total += len(h)
        for i in range(0, len(h), 1 << 16):
            bits += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        carry = words[len(words) - k + 1:]
    if few and carry:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(carry), SEED)], U)
        return 1, np.unpackbits(h.view(np.uint8), bitorder="little").astype(np.int64)
    return total, bits


def fingerprint(data: np.ndarray, k: int = K) -> int:
    """The text's fingerprint, as an unsigned number."""
    total, bits = fingerprint_counts(data, k)
    return int(np.packbits(2 * bits > total, bitorder="little").view(U)[0])


def _fingerprints(k: int):
    schema = pa.schema([("id", pa.int64()), ("code", pa.int64())])

    def run(batches):
        for b in batches:
            data, off = bytes_and_offsets(b.column("text"))
            codes = np.fromiter((fingerprint(data[s:e], k) for s, e in zip(off[:-1], off[1:], strict=True)), U, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(signed(codes))], schema=schema)
    return run


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray order, in which neighbours differ by one bit."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(s)
    return rank


class GrayForest:
    """A tree over the codes of each of several buckets, codes in Gray order.

    Of each level, leaves first: the nodes' patterns and masks of shared bits, where their children and
    their codes begin."""

    def __init__(self, bucket: np.ndarray, codes: np.ndarray, fan: int = FAN):
        order = np.lexsort((gray_rank(codes), bucket))
        self.codes, bucket = codes[order], bucket[order]
        self.fan, n = fan, len(codes)
        self.levels = [(self.codes, np.full(n, _ALL, U), None, np.arange(n + 1))]
        while True:
            first = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            if first.all():
                break
            pattern, mask, _, begins = self.levels[-1]
            place = np.arange(len(bucket)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            starts = np.flatnonzero(place % fan == 0)
            ones = np.bitwise_and.reduceat(pattern & mask, starts)
            zeros = np.bitwise_and.reduceat(~pattern & mask, starts)
            self.levels.append((ones, ones | zeros, np.append(starts, len(bucket)), np.append(begins[starts], n)))
            bucket = bucket[starts]

    def spanning(self, most: int) -> np.ndarray:
        """Of each code (in the forest's order), the place of the least one of its component."""
        label = np.arange(len(self.codes))
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(self.fan), np.arange(self.fan), indexing="ij"))
        # level, nodes a <= b, their differences so far, the bits that these are on
        stack = [(top, roots, roots, np.zeros(len(roots), np.int64), np.zeros(len(roots), U))]
        while stack:
            level, a, b, differ, above = stack.pop()
            if len(a) > STEP:
                stack.append((level, a[STEP:], b[STEP:], differ[STEP:], above[STEP:]))
                a, b, differ, above = (x[:STEP] for x in (a, b, differ, above))
            pattern, mask, children, begins = self.levels[level]
            shared = mask[a] & mask[b]
            differ = differ + np.bitwise_count((pattern[a] ^ pattern[b]) & shared & ~above)
            keep = differ <= most
            if level:
                keep &= ~self._joined(label, begins, a, b)
            a, b, differ, shared = (x[keep] for x in (a, b, differ, shared))
            near = differ + np.bitwise_count(~shared) <= most  # whole groups
            if near.any():
                for x in (a, b):
                    sizes = begins[x[near] + 1] - begins[x[near]]
                    each = np.repeat(begins[x[near]] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
                    label = union(label, np.repeat(begins[a[near]], sizes), each)
            if level and not near.all():
                a, b, differ, shared = (x[~near] for x in (a, b, differ, shared))
                x, y = children[a][:, None] + i, children[b][:, None] + j
                ok = ((x < children[a + 1][:, None]) & (y < children[b + 1][:, None]) & (x < y + (level > 1))).ravel()
                stack.append((level - 1, x.ravel()[ok], y.ravel()[ok], np.repeat(differ, len(i))[ok], np.repeat(shared, len(i))[ok]))
        return label

    def _joined(self, label: np.ndarray, begins: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether all codes below two nodes are in one component already (of a pair of a node with itself: all but one code)."""
        least, most = np.minimum.reduceat(label, begins[:-1]), np.maximum.reduceat(label, begins[:-1])
        return (least[a] == most[a]) & (least[b] == most[b]) & (least[a] == least[b])


def union(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Components after joining ``x`` with ``y``: the least member's place for each."""
    while True:
        u, v = label[x], label[y]
        apart = u != v
        if not apart.any():
            return label
        x, y, u, v = x[apart], y[apart], u[apart], v[apart]
        root = label.copy()
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        label = root[label]


def _blocks(free: int, most: int) -> list[int]:
    """Masks of the bits of every choice of two out of ``most + 2`` blocks of the bits that are free."""
    places = [i for i in range(64) if free >> i & 1]
    blocks = [sum(1 << int(i) for i in part) for part in np.array_split(places, most + 2)]
    return [x | y for x, y in combinations(blocks, 2)]


_ROWS = pa.schema([("mask", pa.int64()), ("key", pa.int64()), ("code", pa.int64())])


def _divided(mask: int, codes: np.ndarray, most: int):
    """The codes of a bucket (equal bits on ``mask``) in all the buckets it is divided into."""
    for m in _blocks(~mask & _ALL, most):
        whole = np.array([mask | m], U)
        n = len(codes)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, signed(whole)[0])), pa.array(signed(codes & whole[0])), pa.array(signed(codes))],
                                         schema=_ROWS)


def _free(mask: int) -> int:
    return 64 - (mask & _ALL).bit_count()


def _spread(most: int, hot: dict):
    """Codes with the mask and key of each of their buckets; buckets in ``hot`` (keys by mask) are divided at once."""
    def each(mask, codes):
        for b in _divided(mask, codes, most):
            own = b.column(0)[0].as_py() if b.num_rows else None
            if own in hot:
                large = np.isin(b.column(1).to_numpy(), hot[own])
                if large.any():
                    yield from each(own & _ALL, b.column(2).to_numpy()[large].view(U))
                    b = b.filter(pa.array(~large))
            if b.num_rows:
                yield b

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield from each(0, b.column("code").to_numpy().view(U))
    return run


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("mask", pa.int64())])


def _links(most: int, limit: int, free: int):
    """From rows sorted by mask and key: links of each bucket (a < b, as signed numbers); the codes of a
    bucket that is too large come back with the mask by which it has to be divided (``a`` null)."""
    def of(bucket: np.ndarray, codes: np.ndarray):
        forest = GrayForest(bucket, codes)
        label, named = forest.spanning(most), signed(forest.codes)
        own = np.flatnonzero(label != np.arange(len(label)))
        if len(own):
            x, y = named[label[own]], named[own]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.nulls(len(own), pa.int64())], schema=_LINKS)

    def ready(mask, key, codes, last):
        """Whole buckets of these rows; all but the last one, which may go on, unless ``last``."""
        new = np.concatenate(([True], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])))
        starts = np.flatnonzero(new)
        end = len(codes) if last else int(starts[-1])
        size = np.diff(np.append(starts, len(codes)))
        several = np.repeat(size > 1, size)[:end]
        if several.any():
            yield from of(np.cumsum(new)[:end][several], codes[:end][several])

    def run(batches):
        held: list = []
        n, large = 0, None
        for b in batches:
            rows = tuple(b.column(c).to_numpy() for c in ("mask", "key", "code"))
            if large is not None:  # the rest of a bucket that was too large
                same = (rows[0] == large[0]) & (rows[1] == large[1])
                if same.any():
                    yield _rest(rows[0][same], rows[2][same])
                rows = tuple(x[~same] for x in rows)
                large = None if len(rows[0]) else large
            if not len(rows[0]):
                continue
            held.append(rows)
            n += len(rows[0])
            if n < limit:
                continue
            mask, key, code = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from ready(mask, key, code.view(U), False)
            mine = (mask == mask[-1]) & (key == key[-1])
            held, n = [(mask[mine], key[mine], code[mine])], int(mine.sum())
            if n > limit and _free(int(mask[-1])) > free:
                yield _rest(mask[mine], code[mine])
                large, held, n = (mask[-1], key[-1]), [], 0
        if n:
            mask, key, code = (np.concatenate(x) for x in zip(*held, strict=True))
            yield from ready(mask, key, code.view(U), True)
    return run


def _rest(mask: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(len(code), pa.int64()), pa.array(code), pa.array(mask)], schema=_LINKS)


def _again(most: int):
    """Codes of buckets that were too large, divided further."""
    def run(batches):
        for b in batches:
            mask, codes = b.column("mask").to_numpy(), b.column("b").to_numpy().view(U)
            for m in np.unique(mask):
                yield from _divided(int(m) & _ALL, codes[mask == m], most)
    return run


def _hot_buckets(codes: DataFrame, most: int, limit: int, free: int, share: int) -> dict:
    """Keys, by mask, of buckets that seem to hold more than ``limit`` codes and one in ``share`` of all.

    Counted on one code in 64 (by hash); there are at most 15 * ``share`` of them a level.  Which buckets are
    divided before the shuffle and which behind it makes no difference to the links."""
    hot: dict = {}
    n = codes.count()
    if n <= limit:
        return hot
    some = materialize(codes.select("code").where("pmod(xxhash64(code), 64) = 0"))
    while True:
        rows = (some.mapInArrow(_spread(most, hot), "mask long, key long, code long").groupBy("mask", "key").count()
                .where(F.col("count") * 64 > max(limit, n // share)).collect())
        rows = [r for r in rows if _free(r["mask"]) > free]
        if not rows:
            return hot
        for mask in {r["mask"] for r in rows}:
            keys = np.array([r["key"] for r in rows if r["mask"] == mask], np.int64)
            hot[mask] = np.concatenate((hot[mask], keys)) if mask in hot else keys


def links(codes: DataFrame, most: int = MOST, limit: int = BUCKET, free: int = FREE, share: int = SHARE) -> DataFrame:
    """``(a, b)``: links that connect the distinct ``code`` longs of a table as all links within ``most`` bits do."""
    p, sql = partitions(codes), "mask long, key long, code long"
    first = codes.select("code").mapInArrow(_spread(most, _hot_buckets(codes, most, limit, free, share)), sql)
    found, rows = None, first
    while True:
        dealt = rows.repartition(p, "mask", "key").sortWithinPartitions("mask", "key")
        out = materialize(dealt.mapInArrow(_links(most, limit, free), "a long, b long, mask long"))
        mine = out.where("a is not null").select("a", "b")
        found = mine if found is None else found.unionByName(mine)
        left = out.where("a is null")
        if left.isEmpty():
            return found
        rows = left.mapInArrow(_again(most), sql)


def simhash_classes(docs: DataFrame, most: int = MOST, k: int = K, **sizes) -> DataFrame:
    """``(id, code, component)`` of every row; component: least id reachable by links."""
    text = docs.select(id_column().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialize(text.mapInArrow(_fingerprints(k), "id long, code long"))
    codes = materialize(rows.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    of = components(links(codes, most, **sizes))
    placed = codes.join(of, codes.code == of.node, "left").select("code", "least", "n", F.coalesce("component", "code").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    named = materialize(placed.join(least, "root").select("code", "component", "n"))
    # a code of more than one row in SHARE doesn't meet in a shuffle; there are fewer than SHARE of these
    hot = F.broadcast(named.where(F.col("n") > rows.count() // SHARE).select("code", "component"))
    often = rows.join(hot, "code").select("id", "code", "component")
    return often.unionByName(rows.join(hot.select("code"), "code", "left_anti").join(named, "code").select("id", "code", "component"))


def op12_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every row of ``documents``."""
    out = simhash_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(original_id().alias("doc_id"), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
                      original_id("component").alias("component_id"))
