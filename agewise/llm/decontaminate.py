"""Benchmark decontamination by spaced seeds.

Tokens are runs of letters, digits and non-ASCII characters, in lower case.  Fixed masks lie over every
token position of the benchmark items and of the documents and ignore some positions, so a seed still
hits when words there were exchanged.  Seeds are joined; around every hit the item is laid over the
document and its stretches of at least ``IDENTITY`` equal tokens are found, substitutions included.
A document is contaminated by an item when such stretches of ``MIN_STRETCH`` tokens or more cover
``MIN_TOKENS`` of its tokens, or all if it has fewer, however long the item is.

Items shorter than a mask are sought whole.  Documents send on only seeds that pass a bitmap of the
benchmark's seeds (2 MB whatever the benchmark's size); the seeds themselves are joined, not broadcast.
Defined results: null or empty texts and items contaminate or contain nothing; repeated items or
documents agree; empty tables give no contamination; see :mod:`agewise.llm.frames` for ids.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import bytes_and_offsets, keyed, original_id, packed, slices, unpacked
from agewise.llm.hashing import PIECE, U, mix, signed, word_hashes

#: Positions that count are 1.
MASKS = ("1101100111", "1110010111", "1011011011", "11111111")
IDENTITY = 0.8
MIN_STRETCH = 8
MIN_TOKENS = 13
_FILTER_BITS = 24
_MULTIPLIERS = mix(np.arange(201, 201 + 16, dtype=U)) | U(1)

#: ASCII characters other than letters and digits stand between tokens.
BREAKS = np.ones(256, bool)
BREAKS[128:] = False
for _a, _z in (("0", "9"), ("A", "Z"), ("a", "z")):
    BREAKS[ord(_a):ord(_z) + 1] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token fingerprints and their rows."""
    h, _, _, row = word_hashes(data, offsets, breaks=BREAKS)
    return h, row


def seeds(h: np.ndarray, row: np.ndarray, whole: tuple[int, ...] = ()):
    """For each mask (and each length in ``whole``, as a mask without holes): seed hashes and their positions."""
    for number, mask in enumerate((*MASKS, *("1" * n for n in whole))):
        n = len(h) - len(mask) + 1
        if n < 1:
            continue
        s = np.full(n, U(len(mask) * 64 + number if number < len(MASKS) else len(mask)))
        for j, c in enumerate(mask):
            if c == "1":
                s += h[j:j + n] * _MULTIPLIERS[j]
        at = np.flatnonzero(row[:n] == row[len(mask) - 1:])
        yield mix(s)[at], at


_SHORTEST = min(map(len, MASKS))


def _item_seeds(batches):
    schema = pa.schema([("seed", pa.int64()), ("item", pa.int64()), ("item_tie", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])
    for b in batches:
        data, off = bytes_and_offsets(b.column("text"))
        ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
        h, row = tokens(data, off)
        first = np.searchsorted(row, np.arange(b.num_rows + 1))
        length = np.diff(first)
        for r in np.flatnonzero(length):
            own = h[first[r]:first[r + 1]]
            m = len(own)
            for s, at in seeds(own, np.zeros(m, np.int64), (m,) if m < _SHORTEST else ()):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    signed(s), np.full(len(s), ids[r]), np.full(len(s), ties[r]), at, np.full(len(s), m))], schema=schema)


def _item_tokens(batches):
    schema = pa.schema([("item", pa.int64()), ("item_tie", pa.int64()), ("tokens", pa.binary())])
    for b in batches:
        data, off = bytes_and_offsets(b.column("text"))
        h, row = tokens(data, off)
        first = np.searchsorted(row, np.arange(b.num_rows + 1))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"),
                                          pa.array([h[first[r]:first[r + 1]].tobytes() for r in range(b.num_rows)], pa.binary())], schema=schema)


def _document_seeds(bitmap: np.ndarray, whole: tuple[int, ...]):
    schema = pa.schema([("seed", pa.int64()), ("id", pa.int64()), ("tie", pa.int64()), ("pos", pa.int64())])

    def run(batches):
        for b in batches:
            data, off = bytes_and_offsets(b.column("text"))
            ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
            for a, z in slices(off, PIECE):
                h, row = tokens(data[off[a]:off[z]], off[a:z + 1] - off[a])
                first = np.searchsorted(row, np.arange(z - a))
                for s, at in seeds(h, row, whole):
                    bucket = s >> U(64 - _FILTER_BITS)
                    hit = np.flatnonzero((bitmap[(bucket >> U(6)).astype(np.int64)] >> (bucket & U(63))) & U(1))
                    if len(hit):
                        r = row[at[hit]]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                            signed(s[hit]), ids[a + r], ties[a + r], at[hit] - first[r])], schema=schema)
    return run


def _bitmap(item_seeds: DataFrame) -> np.ndarray:
    """A bit for each hash bucket that a seed of the benchmark falls in; the driver gets 2**18 words at most."""
    bucket = F.shiftrightunsigned("seed", 64 - _FILTER_BITS)
    rows = (item_seeds.select(F.shiftright(bucket, 6).alias("word"), bucket.bitwiseAND(63).cast("int").alias("bit")).distinct()
            .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).collect())
    words = np.zeros(1 << (_FILTER_BITS - 6), np.int64)
    for r in rows:
        words[r["word"]] = r["bits"]
    return words.view(U)


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The best-scoring stretch, a token counting 1 if equal and ``-IDENTITY / (1 - IDENTITY)`` if not."""
    score = np.concatenate(([0.0], np.cumsum(np.where(equal, 1.0, -IDENTITY / (1 - IDENTITY)))))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    return (int(np.argmin(score[:end + 1])), end) if end else (0, 0)


def stretches(equal: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The best-scoring stretch, then the best ones of what is left on either side, of ``least`` tokens or more."""
    out, left = [], [(0, len(equal))]
    while left:
        a, z = left.pop()
        if z - a < least:
            continue
        s, e = best_stretch(equal[a:z])
        if e > s:
            if e - s >= least:
                out.append((a + s, a + e))
            left += [(a, a + s), (a + e, z)]
    return out


def needed(m: int) -> int:
    """Tokens of an item of ``m`` tokens that must be covered."""
    return min(m, MIN_TOKENS)


def covered(document: np.ndarray, item: np.ndarray, diagonals) -> int:
    """Tokens of the item that stretches found on these diagonals (document less item position) cover."""
    got = np.zeros(len(item), bool)
    least = min(MIN_STRETCH, len(item))
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(document) - d)
        for s, e in stretches(document[lo + d:hi + d] == item[lo:hi], least):
            got[lo + s:lo + e] = True
    return int(got.sum())


_FOUND = "id long, tie long, item long, item_tie long, n_covered long"


def _verify(batches):
    for b in batches:
        data, off = bytes_and_offsets(b.column("text"))
        out: list = []
        for r, hits in enumerate(b.column("hits").to_pylist()):
            h, _ = tokens(data[off[r]:off[r + 1]], np.array([0, off[r + 1] - off[r]]))
            for x in hits:
                item = np.frombuffer(x["tokens"], U)
                n = covered(h, item, x["diagonals"])
                if n >= needed(len(item)):
                    out.append((b.column("id")[r].as_py(), b.column("tie")[r].as_py(), x["item"], x["item_tie"], n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)],
                                             names=["id", "tie", "item", "item_tie", "n_covered"])


def contaminations(docs: DataFrame, benchmark: DataFrame, item_id: str = "item_id") -> DataFrame:
    """``(id, tie, item, item_tie, n_covered)`` of every document and item it contains."""
    items, text = (keyed(x, c).withColumn("text", F.lower("text")) for x, c in ((benchmark, item_id), (docs, "doc_id")))
    items = items.dropDuplicates(["id", "tie"])
    item_seeds = items.mapInArrow(_item_seeds, "seed long, item long, item_tie long, at long, length long")
    whole = tuple(sorted(r["length"] for r in item_seeds.where(F.col("length") < _SHORTEST).select("length").distinct().collect()))
    found = text.mapInArrow(_document_seeds(_bitmap(item_seeds), whole), "seed long, id long, tie long, pos long")
    diagonals = (found.join(item_seeds, "seed").select("id", "tie", "item", "item_tie", (F.col("pos") - F.col("at")).alias("d")).distinct()
                 .groupBy("id", "tie", "item", "item_tie").agg(F.collect_list("d").alias("diagonals")))
    hits = (diagonals.join(items.mapInArrow(_item_tokens, "item long, item_tie long, tokens binary"), ["item", "item_tie"])
            .groupBy("id", "tie").agg(F.collect_list(F.struct("item", "item_tie", "diagonals", "tokens")).alias("hits")))
    return text.join(hits, ["id", "tie"]).mapInArrow(_verify, _FOUND).distinct()


def op4_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: whether it is contaminated, by which items, and the most tokens covered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = (contaminations(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).groupBy("id", "tie")
             .agg(F.array_sort(F.collect_set(original_id("item"))).alias("item_ids"), F.max("n_covered").alias("n_covered")))
    rows = keyed(docs).select("id", "tie").join(found, ["id", "tie"], "left")
    return rows.select(original_id().alias("doc_id"), F.col("n_covered").isNotNull().alias("contaminated"),
                       F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
                       F.coalesce("n_covered", F.lit(0)).alias("n_covered"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no benchmark item."""
    found = contaminations(docs, benchmark).select("id", "tie").distinct()
    return unpacked(packed(docs).join(found, ["id", "tie"], "left_anti"))
