"""Mixing sources to target weights by the cube method (balanced sampling).

Targets.  Sources in code point order, null last, weigh 5, 2, 1, 5, 2, 1, ...; together they get
``share`` (1.5) times all words.  A target stops at ``cap`` (2) times its source's words, and the excess
goes to the others by weight until none is above.

Sample.  A document of a source whose target is ``r`` times its words is taken ``floor(r)`` times, and
once more with probability ``r - floor(r)``.  The cube method draws these extra copies for each source
so that the number of words and the number of documents come out as expected: from three undecided
documents it moves the probabilities along the one direction that changes neither total (the null
space of the two constraints) until one of them is 0 or 1, and goes on with the next document.

On Spark the flight runs in blocks of about ``BLOCK`` documents of one source, each a stream of which
three documents are held.  It leaves at most two undecided, and its last ``RESERVE`` documents untouched;
both meet in blocks of the next level.  When a source has one block left, the same ``RESERVE + 2``
documents or fewer are the landing problem: of all their combinations the one is taken whose words,
then documents, come nearest to what is expected.  Choices come from hashes of source and document and
the order from their ids, so reruns agree.

Defined results: a null text has size 0; documents of size 0 take 0 words; a source without words has
target 0; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agewise.llm.frames import cut, id_column, original_id, partitions, tie_column

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
BLOCK = 1024
RESERVE = 14
_EPS = 1e-9


def size_column(text: str = "text"):
    """The number of words (runs of anything but space, tab to carriage return) of a text."""
    return F.coalesce(F.size(F.expr(rf"regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+', 0)")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, n_docs, target)`` from rows ``(source, size)``.

    With targets ``min(cap size, x weight)`` the level ``x`` follows from the sources sorted by
    size over weight: those before some place are at their cap.  One row a source is all that is sorted."""
    per = cut(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    ranked = per.withColumn("weight", F.element_at(weights, (place % len(WEIGHTS) + 1).cast("int")))
    whole = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    after = whole.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (ranked.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * cap)
              .withColumn("total", F.sum("source_size").over(everything) * share)
              .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(after))
              .withColumn("open", F.col("level") * F.col("weight") <= F.col("source_size") * cap)
              .withColumn("x", F.min(F.when(F.col("open"), F.struct(F.col("source_size") / F.col("weight"), "level"))).over(everything)["level"]))
    target = F.when(F.col("x").isNull(), F.col("source_size") * cap).otherwise(
        F.least(F.col("source_size") * cap, F.col("x") * F.col("weight")))
    return levels.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def flight(units, draw):
    """One pass over ``(key, size, probability)``: yields ``(key, 0.0 or 1.0)`` for units as they are decided;
    at most two stay undecided and come last, with their probabilities.  ``draw()`` gives numbers in [0, 1)."""
    held: list = []
    for unit in units:
        held.append(list(unit))
        if len(held) < 3:
            continue
        sizes = [u[1] for u in held]
        # orthogonal to (1, 1, 1) and to the sizes; with equal sizes, two of them trade places
        u = (sizes[1] - sizes[2], sizes[2] - sizes[0], sizes[0] - sizes[1])
        if not any(u):
            u = (1, -1, 0)
        up = min((1 - h[2]) / x if x > 0 else -h[2] / x for h, x in zip(held, u, strict=True) if x)
        down = min(h[2] / x if x > 0 else (h[2] - 1) / x for h, x in zip(held, u, strict=True) if x)
        step = up if draw() * (up + down) < down else -down
        left = []
        for h, x in zip(held, u, strict=True):
            p = h[2] + step * x
            if p < _EPS or p > 1 - _EPS:
                yield h[0], float(p > 0.5)
            else:
                left.append([h[0], h[1], p])
        held = left
    for h in held:
        yield h[0], h[2]


def landing(undecided: list, words: float, documents: float) -> list[int]:
    """0 or 1 for each of the last ``(size, probability)``: totals nearest to those expected."""
    n = len(undecided)
    take = (np.arange(1 << n)[:, None] >> np.arange(n)) & 1
    off = np.abs(take @ np.array([s for s, _ in undecided], float) - words)
    return take[np.lexsort((np.abs(take.sum(axis=1) - documents), np.round(off, 6)))[0]].tolist()


_UNIT = "source string, block long, mix_key long, id long, tie long, size long, p double"
_OUT = pa.schema([("source", pa.string()), ("block", pa.int64()), ("mix_key", pa.int64()), ("id", pa.int64()),
                  ("tie", pa.int64()), ("size", pa.int64()), ("p", pa.float64())])


def _draws(seed: int):
    state = seed & ((1 << 64) - 1)

    def draw() -> float:
        nonlocal state
        state = (state + 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
        z = state
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & ((1 << 64) - 1)
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & ((1 << 64) - 1)
        return ((z ^ (z >> 31)) >> 11) / (1 << 53)

    return draw


def _fly(last: bool):
    def run(batches):
        out: list = []

        def units():
            for b in batches:
                yield from zip(*(b.column(i).to_pylist() for i in range(7)), strict=True)

        def blocks(rows):
            now, held = None, []
            for r in rows:
                if r[:2] != now:
                    if now is not None:
                        yield held
                    now, held = r[:2], []
                held.append(r)
                if len(held) >= 64 * BLOCK:  # a hot id may fill a block; the flight needs no whole block
                    yield held
                    held = []
            if held:
                yield held

        for rows in blocks(units()):
            draw = _draws(rows[0][2] * 31 + rows[0][1] * 0x2545F4914F6CDD1D + len(rows))
            undecided = [(r, r[6]) for r in rows[-RESERVE:]]
            for r, p in flight(((r, r[5], r[6]) for r in rows[:-RESERVE]), draw):
                if p in (0.0, 1.0):
                    out.append((*r[:6], p))
                else:
                    undecided.append((r, p))
            if last and undecided:
                choice = landing([(r[5], p) for r, p in undecided], sum(r[5] * p for r, p in undecided), sum(p for _, p in undecided))
                undecided = [(r, float(c)) for (r, _), c in zip(undecided, choice, strict=True)]
            out.extend((*r[:6], p) for r, p in undecided)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)
    return run


def mix(docs: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(id, tie, source, size, source_size, target, copies, taken)`` of every row."""
    sized = cut(docs.select(id_column().alias("id"), tie_column().alias("tie"), F.col("source").cast("string").alias("source"),
                            size_column().alias("size")))
    targets = cut(source_targets(sized, share, cap))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    n_blocks = F.ceil(F.col("n_docs") / BLOCK)
    # one row a source; Spark broadcasts it only where its measured size allows, else splits the hot source
    rows = sized.join(targets, sized.source.eqNullSafe(targets.source)).select(
        sized.source, "id", "tie", "size", "source_size", "target", F.floor(rate + _EPS).alias("base"),
        F.greatest(rate - F.floor(rate + _EPS), F.lit(0.0)).alias("p"), F.xxhash64("id", "tie", sized.source).alias("mix_key"),
        n_blocks.alias("n_blocks"))
    p = partitions(docs)
    whole = rows.where(F.col("p") <= _EPS).select("id", "tie", "source", "size", F.lit(0.0).alias("extra"))
    going = rows.where(F.col("p") > _EPS).select("source", F.pmod("mix_key", F.col("n_blocks")).alias("block"), "mix_key", "id", "tie", "size", "p")
    levels = max(1, math.ceil(math.log(max(2, targets.agg(F.max(F.ceil(F.col("n_docs") / BLOCK))).first()[0] or 1), BLOCK // 2)) + 1)
    decided = whole
    for level in range(levels):
        flown = cut(going.repartition(p, "source", "block").sortWithinPartitions("source", "block", "mix_key", "id", "tie", "size", "p")
                    .mapInArrow(_fly(level == levels - 1), _UNIT))
        decided = decided.unionByName(flown.where("p in (0.0, 1.0)").select("id", "tie", "source", "size", F.col("p").alias("extra")))
        going = (flown.where("p not in (0.0, 1.0)")
                 .withColumn("block", F.lit(0).cast("long") if level == levels - 2 else F.floor(F.col("block") / (BLOCK // 2))))
    out = decided.join(targets, decided.source.eqNullSafe(targets.source)).select(
        "id", "tie", decided.source, "size", "source_size", "target",
        (F.floor(rate + _EPS) + F.when(F.col("size") >= 0, F.col("extra"))).cast("long").alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def op9_mixing_sources(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(original_id().alias("doc_id"), "size", "source_size", "target", "taken", "copies")
