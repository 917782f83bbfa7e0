"""Exact similarity join on word shingles: Jaccard >= ``percent`` %, classes by links.

A document's set has its distinct ``k``-word shingles (with fewer words: the whole sequence as one).
Documents with equal sets are one node.  Two nodes link when 100 * intersection >= percent * union.

1. *Tiles.*  Linked sets share an element among the first ``n - ceil(percent n / 100) + 1`` of each,
   in any order that all sets use.  The order puts elements that the corpus uses often last (counts
   of all documents' elements in ``ORDER_BUCKETS`` hash buckets), so common passages make few tiles.
   The nodes that share an element form a tile, sorted by set size; where sizes differ too much for a
   link the tile ends, large ones are cut in blocks that meet in pairs (:data:`BLOCK`), and equal
   tiles are kept once.
2. *Signatures.*  A node's bitmap has a bit for each hash value, toggled by every element; its width
   goes with the set's size.  Differing bits of two bitmaps never outnumber the differing elements,
   so their count bounds the overlap from above.  Narrow bitmaps (about a bit an element) leave in each
   tile only the members whose bound allows a link with another one; these get wide ones, whose bound
   is almost the overlap itself.
3. *Candidates.*  A tile's members are taken by size; each becomes a candidate with one earlier member
   of every group of members joined so far that its bound allows: a spanning forest, at most one
   candidate fewer than members, however many copies a tile holds.
4. *Verification* of candidates by intersecting the sorted arrays.
5. Links found give components.  Of tiles with several components the members whose bound allows a link
   with another one are kept, their sets are brought to the tile, and all such pairs are intersected there;
   only links that join components leave the task.  So no link between two components is missed.

Where links are to be counted (``links``), the nodes of each component meet in pairs of hashed blocks, each
pair of nodes once, and a task counts the common elements of all pairs of two blocks by one matrix product
over the elements that several of them have.  Only (node, links) sums leave it, so that of a group of near
copies no pair is ever a row; documents with equal sets are one node and count with their copies.

The result is exact but for collisions of 64-bit fingerprints.  Defined results: null or empty texts
have the empty set and no links; rows that repeat a document agree; a null doc_id counts as the
smallest id (component_id null where that is the smallest); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import bytes_and_offsets, cut, keyed, one_row_each, original_id, partitions, slices
from agewise.llm.graph import components
from agewise.llm.hashing import PIECE, U, mix, signed, word_hashes

K = 5
PERCENT = 80
#: Counts that order the elements: 512 KB whatever the corpus; more buckets tell more common elements apart.
ORDER_BUCKETS = 1 << 16
#: Nodes of a tile that one task holds at a time.
BLOCK = 1024
_SIZE_BITS = 20
_MULTIPLIERS = mix(np.arange(11, 11 + 64, dtype=U)) | U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = K):
    """The sorted distinct shingle fingerprints of every row, one array a row."""
    h, _, _, row = word_hashes(data, offsets)
    n = len(offsets) - 1
    ends = np.searchsorted(row, np.arange(n + 1))
    m = max(0, len(h) - k + 1)
    sh = np.zeros(m, U)
    for j in range(k):
        sh += h[j:j + m] * _MULTIPLIERS[j]
    sh = mix(sh)
    for r in range(n):
        a, b = ends[r], ends[r + 1]
        if b - a >= k:
            yield np.unique(sh[a:b - k + 1])
        elif b > a:
            yield mix((h[a:b] * _MULTIPLIERS[:b - a]).sum(keepdims=True) + U(b - a))
        else:
            yield sh[:0]


def node_of(s: np.ndarray) -> int:
    """A set's fingerprint: equal sets are one node."""
    total = mix(s).sum(dtype=U) + U(len(s)) * U(0x9E3779B97F4A7C15)
    return int(mix(np.array([total], U)).view(np.int64)[0])


def _each_set(batch: pa.RecordBatch, k: int):
    """(row number, set) of every row of a batch, in pieces of bounded size."""
    data, off = bytes_and_offsets(batch.column("text"))
    for a, b in slices(off, PIECE):
        part = data[off[a]:off[b]]
        yield from zip(range(a, b), shingle_sets(part, off[a:b + 1] - off[a], k), strict=True)


def _arrays(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _describe(k: int):
    """One row a document: (id, tie, n, node)."""
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for b in batches:
            n, node = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for r, s in _each_set(b, k):
                n[r], node[r] = len(s), node_of(s)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), pa.array(n), pa.array(node)], schema=schema)
    return run


def _count_buckets(k: int):
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total = np.zeros(ORDER_BUCKETS, np.int64)
        for b in batches:
            for _, s in _each_set(b, k):
                np.add.at(total, (s >> U(48)).astype(np.int64), 1) if len(s) < 64 else \
                    np.add(total, np.bincount((s >> U(48)).astype(np.int64), minlength=ORDER_BUCKETS), out=total)
        used = np.flatnonzero(total)
        if len(used):
            yield _arrays(schema, (used.astype(np.int32), total[used]))
    return run


def _levels(text: DataFrame, k: int) -> np.ndarray:
    """How common each bucket's elements are: 0 up to 1.2 times the mean, then one more for each fourth of a doubling.

    Bucket counts of rare elements stay near the mean, the nearer the larger the corpus."""
    rows = text.mapInArrow(_count_buckets(k), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ORDER_BUCKETS)
    for r in rows:  # at most ORDER_BUCKETS rows
        counts[r["bucket"]] = r["n"]
    mean = max(1.0, counts.sum() / ORDER_BUCKETS)
    return np.clip(np.ceil(4 * np.log2(np.maximum(counts / mean, 1) / 1.2)), 0, 200).astype(np.uint8)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _prefixes(k: int, percent: int, levels: np.ndarray):
    """(element and set size, node) of the elements in a set's prefix; a node once a batch."""
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for b in batches:
            seen, tokens, nodes = set(), [], []
            for _, s in _each_set(b, k):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                level, p = levels[(s >> U(48)).astype(np.int64)], prefix_length(len(s), percent)
                first = s[:p] if not level.any() else s[np.lexsort((s, level))[:p]]
                size = U(min(len(s), (1 << _SIZE_BITS) - 1))
                tokens.append((first >> U(_SIZE_BITS) << U(_SIZE_BITS)) | size)
                nodes.append(np.full(len(first), node))
            if tokens:
                yield _arrays(schema, (signed(np.concatenate(tokens)), np.concatenate(nodes)))
    return run


def _fits(small: np.ndarray, large: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can link (sizes at the top of the packed range are unknown)."""
    return (100 * small >= percent * large) | (large >= (1 << _SIZE_BITS) - 1)


def _members(nodes: np.ndarray) -> int:
    """A tile's fingerprint, from its members."""
    return int(mix(np.array([mix(nodes.view(U)).sum(dtype=U) + U(len(nodes))], U)).view(np.int64)[0])


def _tiles(percent: int):
    """From rows sorted by token, size and node: the tiles, a row (tile, node) for each member."""
    schema = pa.schema([("tile", pa.int64()), ("node", pa.int64())])

    def of_run(size: np.ndarray, node: np.ndarray, out: list) -> None:
        # a chain of sizes that can link with the next one is worked on alone
        for part in np.split(np.arange(len(node)), np.flatnonzero(~_fits(size[:-1], size[1:], percent)) + 1):
            if len(part) < 2:
                continue
            blocks = [part[i:i + BLOCK] for i in range(0, len(part), BLOCK)]
            for i, x in enumerate(blocks):
                for y in [None] * (len(blocks) == 1) or blocks[i + 1:] or [None] * (i == 0):
                    if y is not None and not _fits(size[x[-1]], size[y[0]], percent):
                        break
                    both = np.sort(node[x] if y is None else node[np.concatenate((x, y))])
                    out.append((np.full(len(both), _members(both)), both))

    def flush(out: list, seen: set):
        keep = []
        for tile, nodes in out:
            if tile[0] not in seen:
                if len(seen) > 1_000_000:
                    seen.clear()  # it only saves rows; equal tiles merge later
                seen.add(tile[0])
                keep.append((tile, nodes))
        if keep:
            yield _arrays(schema, (np.concatenate([x[0] for x in keep]), np.concatenate([x[1] for x in keep])))

    def run(batches):
        rest_t, rest_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        seen: set = set()
        mask = np.int64((1 << _SIZE_BITS) - 1)
        for b in batches:
            t = np.concatenate([rest_t, b.column(0).to_numpy(zero_copy_only=False)])
            n = np.concatenate([rest_n, b.column(1).to_numpy(zero_copy_only=False)])
            cutoff = int(np.searchsorted(t >> _SIZE_BITS, t[-1] >> _SIZE_BITS)) if len(t) else 0
            out: list = []
            yield from _runs(t[:cutoff], n[:cutoff], mask, out, seen)
            rest_t, rest_n = t[cutoff:], n[cutoff:]
        out = []
        yield from _runs(rest_t, rest_n, mask, out, seen)

    def _runs(t, n, mask, out, seen):
        if not len(t):
            return
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (n[1:] != n[:-1])  # a node comes once from each batch of the map
        t, n = t[new], n[new]
        starts = np.flatnonzero(np.concatenate(([True], (t[1:] >> _SIZE_BITS) != (t[:-1] >> _SIZE_BITS))))
        ends = np.append(starts[1:], len(t))
        several = ends - starts > 1
        pairs = ends - starts == 2
        # most tiles have two nodes: all at once
        a, z = starts[pairs], starts[pairs] + 1
        ok = _fits(t[a] & mask, t[z] & mask, percent)
        a, z = a[ok], z[ok]
        both = np.sort(np.stack([n[a], n[z]], 1), axis=1)
        if len(both):
            h = mix(both.copy().view(U))
            tile = mix(h[:, 0] + h[:, 1] + U(2)).view(np.int64)
            _, first = np.unique(tile, return_index=True)
            fresh = [i for i in first if int(tile[i]) not in seen]
            if len(seen) > 1_000_000:
                seen.clear()
            seen.update(int(tile[i]) for i in fresh)
            if fresh:
                yield _arrays(schema, (np.repeat(tile[fresh], 2), both[fresh].ravel()))
        for s, e in zip(starts[several & ~pairs], ends[several & ~pairs], strict=True):
            of_run(t[s:e] & mask, n[s:e], out)
            if sum(len(x[0]) for x in out[-64:]) > 50_000 or len(out) > 2000:
                yield from flush(out, seen)
                out.clear()
        yield from flush(out, seen)
        out.clear()
    return run


#: Bits an element of the two signatures, up to the next power of two.
NARROW, WIDE = 1, 8


def bitmap(s: np.ndarray, per_element: int) -> np.ndarray:
    """The signature as 64-bit words: bit ``hash mod width`` is toggled by each element."""
    width = max(64, 1 << (per_element * len(s) - 1).bit_length())
    bits = np.bincount((s & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(U)


def folded(words: np.ndarray, to: int) -> np.ndarray:
    """A signature (or rows of them) at a smaller width: halves laid over one another."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _signatures(k: int):
    """Of every document: key, node, size and narrow signature."""
    schema = pa.schema([("id", pa.int64()), ("tie", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def run(batches):
        for b in batches:
            ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
            rows: list = []
            for r, s in _each_set(b, k):
                if len(s):
                    rows.append((ids[r], ties[r], node_of(s), len(s), bitmap(s, NARROW).tobytes()))
                if len(rows) >= 1000:
                    yield _arrays(schema, zip(*rows, strict=True))
                    rows = []
            if rows:
                yield _arrays(schema, zip(*rows, strict=True))
    return run


def _sets(k: int):
    """Node, size, wide signature and sorted set of documents that stand for nodes."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("bits", pa.binary()), ("items", pa.binary())])

    def run(batches):
        for b in batches:
            rows: list = []
            for _, s in _each_set(b, k):
                rows.append((node_of(s), len(s), bitmap(s, WIDE).tobytes(), s.tobytes()))
                if len(rows) >= 500:
                    yield _arrays(schema, zip(*rows, strict=True))
                    rows = []
            if rows:
                yield _arrays(schema, zip(*rows, strict=True))
    return run


def _bound_allows(n: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether overlaps of ``n`` elements with others may reach the threshold.

    differing elements >= differing bits, and 100 (a + b - d) / 2 >= percent (a + b + d) / 2 for a link."""
    to = min(len(bits), others.shape[1])
    differ = np.bitwise_count(folded(others, to) ^ folded(bits, to)).sum(axis=1, dtype=np.int64)
    return (100 * (n + sizes - differ) >= percent * (n + sizes + differ)) & (100 * np.minimum(n, sizes) >= percent * np.maximum(n, sizes))


class _Tile:
    """The members of one tile by size, their signatures grouped by width."""

    def __init__(self, n: np.ndarray, raw: list):
        self.n = n
        words = [len(x) // 8 for x in raw]
        self.width = np.array(words)
        self.bands = {w: np.flatnonzero(self.width == w) for w in sorted(set(words))}
        self.bits = {w: np.frombuffer(b"".join(raw[i] for i in at), U).reshape(len(at), w) for w, at in self.bands.items()}

    def partners(self, i: int, percent: int) -> np.ndarray:
        """The earlier members with which the bound allows a link."""
        own = int(self.width[i])
        bits = self.bits[own][np.searchsorted(self.bands[own], i)]
        found = []
        for w, at in self.bands.items():
            if own // 4 <= w <= own:  # smaller sets: widths at or below its own
                at = at[:np.searchsorted(at, i)]
                at = at[np.searchsorted(100 * self.n[at], percent * self.n[i]):]  # by size, so the large ones come last
                if len(at):
                    first = int(np.searchsorted(self.bands[w], at[0]))
                    ok = _bound_allows(self.n[i], bits, self.n[at], self.bits[w][first:first + len(at)], percent)
                    found.append(at[ok])
        return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _each_tile(batches):
    """(tile's node, n, bits, comp or node, its rows) from rows sorted by (tile, n, node)."""
    rest = None
    for b in batches:
        b = pa.Table.from_batches([b])
        rest = b if rest is None else pa.concat_tables([rest, b])
        tile = rest.column("tile").to_numpy()
        cutoff = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if len(tile) and (tile != tile[-1]).any() else 0
        if cutoff:
            yield from _tiles_of(rest.slice(0, cutoff).combine_chunks())
            rest = rest.slice(cutoff)
    if rest is not None and rest.num_rows:
        yield from _tiles_of(rest.combine_chunks())


def _tiles_of(t: pa.Table):
    tile, node, n = (t.column(c).to_numpy() for c in ("tile", "node", "n"))
    comp = t.column("comp").to_numpy() if "comp" in t.column_names else node
    raw = t.column("bits").to_pylist()
    starts = np.flatnonzero(np.concatenate(([True], tile[1:] != tile[:-1])))
    for s, e in zip(starts, np.append(starts[1:], len(tile)), strict=True):
        yield node[s:e], n[s:e], raw[s:e], comp[s:e], t.slice(s, e - s)


def _narrowed(percent: int):
    """Tiles without the members whose bound allows no link with another member."""
    schema = pa.schema([("tile", pa.int64()), ("node", pa.int64())])

    def run(batches):
        out: list = []
        held = 0
        for node, n, raw, *_ in _each_tile(batches):
            t, some = _Tile(n, raw), np.zeros(len(node), bool)
            for i in range(1, len(node)):
                j = t.partners(i, percent)
                some[j] = True
                some[i] |= len(j) > 0
            if some.any():
                left = np.sort(node[some])
                out.append((np.full(len(left), _members(left)), left))
                held += len(left)
            if held > 50_000:
                yield _arrays(schema, [np.concatenate(x) for x in zip(*out, strict=True)])
                out, held = [], 0
        if out:
            yield _arrays(schema, [np.concatenate(x) for x in zip(*out, strict=True)])
    return run


def _candidates(percent: int):
    """Pairs (a, b), a < b, of tile members: a spanning forest of those whose bound allows a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        out: set = set()
        for node, n, raw, *_ in _each_tile(batches):
            t, group = _Tile(n, raw), np.arange(len(node))
            for i in range(1, len(node)):
                j = t.partners(i, percent)
                if len(j):
                    groups, first = np.unique(group[j], return_index=True)
                    j = j[first]  # the smallest member of each group, so that tiles agree on it
                    group[np.isin(group, groups)] = i
                    group[i] = i
                out.update((min(node[i], x), max(node[i], x)) for x in node[j])
            if len(out) > 20_000:
                yield _arrays(schema, zip(*out, strict=True))
                out = set()
        if out:
            yield _arrays(schema, zip(*out, strict=True))
    return run


def _bordering(percent: int):
    """Of tiles of several components, the members whose bound allows a link with another component's member."""
    schema = pa.schema([("tile", pa.int64()), ("node", pa.int64())])

    def run(batches):
        for node, n, raw, comp, rows in _each_tile(batches):
            t, some = _Tile(n, raw), np.zeros(len(node), bool)
            for i in range(1, len(node)):
                j = t.partners(i, percent)
                j = j[comp[j] != comp[i]]
                some[j] = True
                some[i] |= len(j) > 0
            if some.any():
                yield _arrays(schema, (np.full(int(some.sum()), rows.column("tile")[0].as_py()), node[some]))
    return run


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _joining(percent: int):
    """Links (a, b) of tile members that join components: all pairs of two that the bound allows are intersected
    until one of them links."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for node, n, raw, comp, rows in _each_tile(batches):
            t, group, items, found = _Tile(n, raw), comp.copy(), rows.column("items"), []
            for i in range(1, len(node)):
                x = np.frombuffer(items[i].as_buffer(), U)
                for j in t.partners(i, percent):
                    if group[j] != group[i] and _linked(x, np.frombuffer(items[j].as_buffer(), U), percent):
                        found.append((min(node[i], node[j]), max(node[i], node[j])))
                        group[group == group[j]] = group[i]
            if found:
                yield _arrays(schema, zip(*found, strict=True))
    return run


#: Nodes of a component that a task compares with as many others, and elements that it looks at in one product.
COUNT_BLOCK, COUNT_ELEMENTS = 1024, 4096


def common_elements(sets: list) -> np.ndarray:
    """The number of common elements of every two sets."""
    at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    elements, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number, at = (np.cumsum(several) - 1)[number[several[number]]], at[several[number]]
    order = np.argsort(number, kind="stable")
    number, at = number[order], at[order]
    out = np.zeros((len(sets), len(sets)), np.float32)  # exact below 2**24
    for a in range(0, int(several.sum()), COUNT_ELEMENTS):
        s, e = np.searchsorted(number, [a, a + COUNT_ELEMENTS])
        has = np.zeros((len(sets), COUNT_ELEMENTS), np.float32)
        has[at[s:e], number[s:e] - a] = 1
        out += has @ has.T
    return out.astype(np.int64)


def _link_sums(percent: int):
    """(node, links) from rows sorted by component and pair of blocks: how many rows of the other block (in a
    block's pair with itself: of the same) a node links with."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64())])

    def sums(t: pa.Table):
        node, block, copies = (t.column(c).to_numpy() for c in ("node", "block", "n_copies"))
        sets = [np.frombuffer(x.as_buffer(), U) for x in t.column("items")]
        n, both = np.array([len(x) for x in sets]), common_elements(sets)
        link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
        link &= (block[:, None] != block[None, :]) if block.min() != block.max() else ~np.eye(len(n), dtype=bool)
        yield _arrays(schema, (node, link @ copies))

    def run(batches):
        rest = None
        for b in batches:
            b = pa.Table.from_batches([b])
            rest = b if rest is None else pa.concat_tables([rest, b])
            place = np.stack([rest.column(c).to_numpy() for c in ("comp", "x", "y")])
            cuts = np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1 if rest.num_rows else []
            for s, e in zip([0, *cuts[:-1]], cuts, strict=True) if len(cuts) else ():
                yield from sums(rest.slice(s, e - s).combine_chunks())
            rest = rest.slice(int(cuts[-1])) if len(cuts) else rest
        if rest is not None and rest.num_rows:
            yield from sums(rest.combine_chunks())
    return run


def link_counts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(node, others)``: the rows of other nodes that a node's rows link with; ``members``: (node, comp, n_copies)."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("size")).where("size > 1")
    placed = members.join(sizes, "comp").withColumn("blocks", F.ceil(F.col("size") / COUNT_BLOCK).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("node", "comp", "n_copies", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    dealt = (placed.join(sets.select("node", "items"), "node").repartition(partitions(sets), "comp", "x", "y")
             .sortWithinPartitions("comp", "x", "y", "node"))
    # two blocks meet once; a pair of a block with itself has the rows of that block alone
    return dealt.mapInArrow(_link_sums(percent), "node long, links long").groupBy("node").agg(F.sum("links").alias("others"))


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("linked", pa.bool_())])

    def run(batches):
        for t in batches:
            common, linked = [], []
            for x, y in zip(t.column("x"), t.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                common.append(both)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield _arrays(schema, (t.column("a"), t.column("b"), common, linked))
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b, common, linked)`` of candidate pairs."""
    one = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
            .mapInArrow(_verify(percent), "a long, b long, common long, linked boolean"))


def jaccard_classes(docs: DataFrame, percent: int = PERCENT, k: int = K, links: bool = False) -> DataFrame:
    """``(id, tie, n, n_copies, component)`` of every document; component: least id reachable by links.

    ``n_copies``: rows of the table with the same set, itself included (0 for the empty set).
    ``links`` adds ``n_links``: the other rows of the table that a row links with, equal sets among them."""
    text, p = keyed(docs), partitions(docs)
    described = cut(text.mapInArrow(_describe(k), "id long, tie long, n long, node long"))
    nodes = (described.where("n > 0").groupBy("node")
             .agg(F.min(F.struct("id", "tie")).alias("rep"), F.count("*").alias("n_copies")))
    levels = _levels(text, k)
    prefixes = text.mapInArrow(_prefixes(k, percent, levels), "token long, node long")
    by_token = prefixes.withColumn("t", F.shiftright("token", _SIZE_BITS)).repartition(p, "t").drop("t")
    tiles = cut(by_token.sortWithinPartitions("token", "node").mapInArrow(_tiles(percent), "tile long, node long").distinct())

    def representatives(members: DataFrame) -> DataFrame:
        return members.select("node").distinct().join(nodes, "node").select("rep.id", "rep.tie")

    def by_tile(members: DataFrame) -> DataFrame:
        return members.repartition(p, "tile").sortWithinPartitions("tile", "n", "node")

    narrow = (text.mapInArrow(_signatures(k), "id long, tie long, node long, n long, bits binary")
              .join(representatives(tiles), ["id", "tie"]).select("node", "n", "bits").dropDuplicates(["node"]))
    tiles = cut(by_tile(tiles.join(narrow, "node")).mapInArrow(_narrowed(percent), "tile long, node long").distinct())
    sets = cut(text.join(representatives(tiles), ["id", "tie"]).select("text")
               .mapInArrow(_sets(k), "node long, n long, bits binary, items binary").dropDuplicates(["node"]))
    members = tiles.join(sets.select("node", "n", "bits"), "node")
    first = cut(_verified(by_tile(members).mapInArrow(_candidates(percent), "a long, b long").distinct(), sets, percent))
    linked = first.where("linked").select("a", "b")
    of = components(linked).withColumnRenamed("component", "comp")
    placed = members.join(of, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    several = placed.groupBy("tile").agg(F.min("comp").alias("l"), F.max("comp").alias("m")).where("l <> m").select("tile")
    border = by_tile(placed.join(several, "tile", "left_semi")).mapInArrow(_bordering(percent), "tile long, node long")
    border = border.join(placed, ["tile", "node"]).join(sets.select("node", "items"), "node")
    linked = cut(linked.unionByName(by_tile(border).mapInArrow(_joining(percent), "a long, b long")).distinct())
    names = nodes.select("node", F.col("rep.id").alias("least"), "n_copies")
    edges = (linked.join(names.select(F.col("node").alias("a"), F.col("least").alias("x")), "a")
             .join(names.select(F.col("node").alias("b"), F.col("least").alias("y")), "b"))
    of = components(edges.select("x", "y"), "x", "y")
    classes = names.join(of, names.least == of.node, "left").select(
        names.node, "n_copies", F.coalesce("component", "least").alias("component"))
    if links:
        joined = components(linked).withColumnRenamed("component", "comp")
        others = link_counts(joined.join(names.select("node", "n_copies"), "node"), sets, percent)
        classes = classes.join(others, "node", "left").withColumn("n_links", F.col("n_copies") - 1 + F.coalesce("others", F.lit(0)))
    return described.join(classes, "node", "left").select(
        "id", "tie", "n", F.coalesce("n_copies", F.lit(0)).alias("n_copies"), F.coalesce("component", "id").alias("component"),
        *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * links)


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The class of every row of ``documents`` and with how many other rows it links (each link counts at both)."""
    out = jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"), links=True)
    return out.select(original_id().alias("doc_id"), F.col("n").alias("n_shingles"),
                      original_id("component").alias("component_id"), "n_copies", "n_links")


def one_of_each_class(docs: DataFrame, percent: int = PERCENT, k: int = K) -> DataFrame:
    """One row of each class: of its smallest doc_id, then of the smallest ``tie``, repeated rows once.

    Documents without words are linked with nothing, so each stays."""
    least = (jaccard_classes(docs, percent, k).groupBy("component", (F.col("n") > 0).alias("has"),
                                                       F.when(F.col("n") == 0, F.col("id")).alias("own"))
             .agg(F.min(F.struct("id", "tie")).alias("rep")).select("rep.id", "rep.tie"))
    return one_row_each(docs, least)
