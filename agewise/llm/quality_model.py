"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

Features of a text: its words and marks (runs of letters and digits, runs of other characters, A-Z in
lower case), pairs of neighbouring white-space words, and one feature for pairs of equal neighbours; all
are hashed into ``2**DIM_BITS`` columns, weigh ``1 + ln(count)`` and are scaled to length 1.  Nothing
but the text enters.  Labels are learned from at most ``sample`` labelled training documents (the ones
with the least hash of their id), a documented bound that keeps the fit in one task of bounded memory; FTRL-proximal takes
them in a fixed order, several times over.  The weights (2 MB whatever the corpus) go to all tasks,
which score whole texts as sparse dot products.

Defined results: empty or null texts have no features and get the bias's score; a document labelled
more than once counts once, by its mean label (half and half: 1); null labels teach nothing; without
any label every score is 0.5; repeated rows agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.decontaminate import BREAKS
from agewise.llm.frames import bytes_and_offsets, keep_documents, keyed, original_id, slices
from agewise.llm.hashing import PIECE, U, WHITE, mix, word_hashes

DIM_BITS = 18
SAMPLE = 8192
EPOCHS = 8
THRESHOLD = 0.3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
_EQUAL_PAIR = U(0x51ED270B7A3C19F5)
#: Marks are the bytes that neither words nor white space have.
_NOT_MARKS = ~BREAKS | WHITE


def features(data: np.ndarray, offsets: np.ndarray):
    """Column numbers (ascending) and values of each row's features."""
    n = len(offsets) - 1
    parts = []
    for breaks in (BREAKS, _NOT_MARKS):
        h, _, _, row = word_hashes(data, offsets, breaks=breaks)
        parts.append((h, row))
    h, _, _, row = word_hashes(data, offsets)
    inside = row[1:] == row[:-1]
    pair = mix(h[:-1] * U(0x8CB92BA72F3D8DD7) + h[1:])
    parts.append((np.where(h[1:] == h[:-1], _EQUAL_PAIR, pair)[inside], row[1:][inside]))
    h, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    key = np.sort((row.astype(U) << U(DIM_BITS)) | (mix(h + U(7)) >> U(64 - DIM_BITS)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    value = 1 + np.log(np.diff(np.append(first, len(key))))
    key = key[first]
    at = np.searchsorted(key >> U(DIM_BITS), np.arange(n + 1, dtype=U))
    column = (key & U((1 << DIM_BITS) - 1)).astype(np.int32)
    for r in range(n):
        v = value[at[r]:at[r + 1]]
        yield column[at[r]:at[r + 1]], v / np.sqrt((v * v).sum()) if len(v) else v


def _each(batch: pa.RecordBatch):
    data, off = bytes_and_offsets(batch.column("text"))
    for a, z in slices(off, PIECE):
        yield from zip(range(a, z), features(data[off[a]:off[z]], off[a:z + 1] - off[a]), strict=True)


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the bias, free of L1."""

    def __init__(self, size: int = 1 << DIM_BITS):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, column: np.ndarray, value: np.ndarray, label: float) -> None:
        at = np.append(column, len(self.z) - 1)
        x = np.append(value, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - label) * x
        s = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - s * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _featurise(batches):
    """Of the sample's documents: place in the order, label, columns, values."""
    schema = pa.schema([("place", pa.int64()), ("label", pa.float64()), ("columns", pa.binary()), ("values", pa.binary())])
    for b in batches:
        rows = [(c.tobytes(), v.astype(np.float32).tobytes()) for _, (c, v) in _each(b)]
        yield pa.RecordBatch.from_arrays([b.column("place"), b.column("label"), *(pa.array(x, pa.binary()) for x in zip(*rows, strict=True))],
                                         schema=schema)


def _fit(batches):
    examples = []
    for b in batches:
        for label, c, v in zip(b.column("label").to_pylist(), b.column("columns").to_pylist(), b.column("values").to_pylist(), strict=True):
            examples.append((np.frombuffer(c, np.int32), np.frombuffer(v, np.float32).astype(np.float64), label))
    model = Ftrl()
    for _ in range(EPOCHS):
        for x in examples:
            model.learn(*x)
    w = model.weights()
    used = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(w[used])], names=["column", "weight"])


def in_test_fold(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5 (a null id counts as the empty text)."""
    return F.crc32(F.encode(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The weights, learned from ``labels(doc_id, quality)`` outside the test fold."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~in_test_fold())
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    # at most ``sample`` rows of three numbers, so a broadcast of bounded size
    chosen = known.select("id", "label", F.xxhash64("id").alias("place"))
    examples = keyed(docs).join(F.broadcast(chosen), "id").dropDuplicates(["id", "tie"]).select("place", "label", "text")
    rows = (examples.mapInArrow(_featurise, "place long, label double, columns binary, values binary")
            .repartition(1).sortWithinPartitions("place", "columns")
            .mapInArrow(_fit, "column long, weight double").collect())  # 2**DIM_BITS + 1 rows at most
    weights = np.zeros((1 << DIM_BITS) + 1)
    for r in rows:
        weights[r["column"]] = r["weight"]
    return weights


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``(id, tie, score)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = shared.value
        for b in batches:
            out = np.empty(b.num_rows)
            for r, (column, value) in _each(b):
                out[r] = w[column] @ value + w[-1]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("tie"), pa.array(sigmoid(out))], names=["id", "tie", "score"])

    return keyed(docs).mapInArrow(run, "id long, tie long, score double")


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score and decision for every row of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return (out.select(original_id().alias("doc_id"), "score")
            .select("doc_id", in_test_fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier does not reject."""
    return keep_documents(docs, score(docs, fit(docs, labels)).where(F.col("score") >= THRESHOLD))
