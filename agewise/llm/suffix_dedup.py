"""Exact substring de-duplication in the manner of prefix-free parsing.

Every byte that is covered by a ``length``-byte string (100) which also starts earlier in the corpus
goes; strings are judged on the input, overlaps count, and no string crosses documents.  Prefix-free
parsing sorts a repetitive corpus by way of a dictionary of phrases and a parse, so that repeated
text is handled once a phrase and not once a byte.  Here, as Spark jobs:

1. *Parse* (one scan).  A rolling hash of 8 bytes triggers phrase ends: the trigger of a string that
   starts at ``s`` is the position of the least hash among its first ``reach`` positions, so it
   depends on the string alone.  Consecutive starts with one trigger ``t`` form a phrase.  The phrase
   occurrence becomes one row: a fingerprint of the parse after the trigger (the ``length - reach + 1``
   bytes from ``t`` that all its strings contain) and one of the whole phrase with its 100-byte outlook.
2. *Order of the parse.*  The rows are sorted by (parse fingerprint, phrase fingerprint, doc, position).
   Equal phrases come together: all but the first are repeats in full.  A phrase whose parse
   fingerprint belongs to no other phrase is settled.  The rest (where repeats begin or end) go on.
3. *Finer parse.*  Each remaining distinct phrase is divided, once, at its first occurrence: starts
   whose distances from the trigger lie in one group of ``GROUP`` become a phrase of their own, with a
   parse fingerprint of the ``length - GROUP + 1`` bytes they all contain, and step 2 is done again.
4. *Order of the dictionary.*  What is left is spelled out; the suffixes, cut at ``length`` bytes, are
   sorted (a suffix array of the phrases at hand), neighbours with ``length`` bytes in common merge,
   and the survivors meet corpus-wide by fingerprint in corpus order, where all but the first are repeats.
5. The repeated ranges join their documents, which lose those bytes.

Rows are streamed through sorted partitions; no phrase, group or document list is held whole, and a
map task sends at most one row of each distinct phrase in a batch for comparison.

Defined results: a null text is empty; texts under ``length`` bytes lose nothing; of repeated rows of
one document (same id and text) each gets the document's result; see :mod:`agewise.llm.frames` for
ids that are null or shared; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agewise.llm.frames import bytes_and_offsets, cut, original_id, packed, partitions
from agewise.llm.hashing import PIECE, U, Fingerprints, byte_values, mix, signed
from agewise.llm.repeats import (KNOWN, PLACES_DDL, START_BITS, CODE_BITS, code_of, later_places, mark_repeats, pack,
                                 place_batch, start_of, tie_from)

LENGTH = 100
#: Strings that share a trigger start at most so many bytes before it; 6 bits hold the count less one.
REACH = 64
#: Starts that the finer parse keeps together; their common bytes are nearly a whole string.
GROUP = 8
_ROLL = 8


def _rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 8 bytes from each position but the last seven."""
    n = len(data) - _ROLL + 1
    h = np.empty(n, U)
    for o in range(_ROLL):
        k = (n - o + _ROLL - 1) // _ROLL
        if k > 0:
            h[o::_ROLL] = data[o:o + k * _ROLL].view("<u8")
    return mix(h) >> U(32)


def triggers(data: np.ndarray, length: int, reach: int) -> np.ndarray:
    """The trigger position of the string of ``length`` bytes from each start (all that fit)."""
    n = len(data) - length + 1
    least = (_rolling(data) << U(32)) | np.arange(len(data) - _ROLL + 1, dtype=U)
    width = 1
    while width < reach:  # least over a window, doubling; the leftmost of equal hashes wins
        step = min(width, reach - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return (least[:n] & U(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, length: int = LENGTH, reach: int = REACH):
    """Of one text: parse fingerprint, phrase fingerprint, first start and number of starts of each phrase.

    Long texts are parsed in pieces; a phrase cut there has its own fingerprint and is settled in step 3 or 4."""
    out = []
    for a in range(0, len(data) - length + 1, PIECE):
        piece = data[a:min(a + PIECE + length - 1, len(data))]
        trigger = triggers(piece, length, reach)
        lo = np.flatnonzero(np.concatenate(([True], trigger[1:] != trigger[:-1])))
        count = np.diff(np.append(lo, len(trigger)))
        t = trigger[lo]
        f = Fingerprints(byte_values(False)[piece])
        parse = f(t, t + (length - reach + 1))
        phrase = mix(f(lo, lo + count + length - 1) + (t - lo).astype(U))
        out.append((parse, phrase, lo + a, count))
    if not out:
        z = np.zeros(0, np.int64)
        return z.view(U), z.view(U), z, z
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_OCCURRENCES_DDL = "key long, phrase long, id long, pos long"


def _parse(length: int, reach: int):
    def run(batches):
        for b in batches:
            data, off = bytes_and_offsets(b.column("text"))
            ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
            rows: list = []
            held = 0
            for i in range(b.num_rows):
                if off[i + 1] - off[i] >= length:
                    parse, phrase, lo, count = phrases(data[off[i]:off[i + 1]], length, reach)
                    pos = pack(np.full(len(lo), ties[i]), lo, count - 1)
                    rows.append((signed(parse), signed(phrase), np.full(len(lo), ids[i]), pos))
                    held += len(lo)
                if held > 200_000 or i == b.num_rows - 1 and rows:
                    yield _occurrences(rows)
                    rows, held = [], 0
    return run


def _occurrences(rows: list) -> pa.RecordBatch:
    """Occurrences of phrases; those that repeat a phrase of the same batch are marked and dealt out evenly."""
    parse, phrase, ident, pos = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((pos, ident, phrase, parse))
    parse, phrase, ident, pos = (x[order] for x in (parse, phrase, ident, pos))
    same = np.zeros(len(pos), bool)
    same[1:] = (parse[1:] == parse[:-1]) & (phrase[1:] == phrase[:-1])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(pos))))
    known = same & ((ident != ident[first]) | (pos != pos[first]))
    spread = signed(mix(pos.view(U) + ident.view(U) * U(0x9E3779B97F4A7C15)))
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (np.where(known, spread, parse), phrase, ident, np.where(known, pos | np.int64(KNOWN), pos))],
        names=["key", "phrase", "id", "pos"])


#: What step 2 finds: a phrase that is a repeat in full, or one whose strings must be compared.
_REPEAT, _COMPARE = 0, 1


def _order_of_parse(batches):
    """Of rows sorted by (key, phrase, id, pos): repeats, and the first of each phrase of keys with several."""
    first_row = None  # (key, phrase, id, pos, already passed on) of the phrase now open
    for b in batches:
        key, phrase, ident, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        known = pos < 0
        out = [(ident[known], pos[known] & ~np.int64(KNOWN), np.full(int(known.sum()), _REPEAT))]
        k, f, i, p = (x[~known] for x in (key, phrase, ident, pos))
        if len(k):
            if first_row is not None:  # the open phrase's first row stands before the batch
                k, f, i, p = (np.concatenate(([v], x)) for v, x in zip(first_row[:4], (k, f, i, p), strict=True))
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
            again = (i != i[at]) | (p != p[at])
            out.append((i[again], p[again], np.full(int(again.sum()), _REPEAT)))
            heads = np.flatnonzero(new)
            shared = np.zeros(len(heads), bool)
            with_next = k[heads][1:] == k[heads][:-1]
            shared[1:] |= with_next
            shared[:-1] |= with_next
            done = np.zeros(len(heads), bool)
            if first_row is not None:
                done[0] = first_row[4]
            go = heads[shared & ~done]
            out.append((i[go], p[go], np.full(len(go), _COMPARE)))
            h = heads[-1]
            first_row = (k[h], f[h], i[h], p[h], bool(shared[-1] | done[-1]))
        ident, pos, kind = (np.concatenate(x) for x in zip(*out, strict=True))
        if len(ident):
            yield pa.RecordBatch.from_arrays([pa.array(ident), pa.array(pos), pa.array(kind.astype(np.int32))],
                                             names=["id", "pos", "kind"])


def _places(batch: pa.RecordBatch):
    """(id, text, sorted distinct places) of every row of a batch."""
    data, off = _text(batch)
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    lists = batch.column("places")
    values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    for r in range(batch.num_rows):
        yield ids[r], data[off[r]:off[r + 1]], np.unique(values[ends[r]:ends[r + 1]])


def divided(text: np.ndarray, lo: np.ndarray, count: np.ndarray, length: int, reach: int, group: int):
    """Of phrases of one text: parse and phrase fingerprint, first start, number of starts and phrase number of each group."""
    # every phrase's bytes side by side; past the end of the text the last byte fills up, which no fingerprint covers
    at = np.minimum(lo[:, None] + np.arange(reach + length - 1), len(text) - 1)
    window = text[at]
    near = reach + _ROLL - 1
    roll = _rolling(np.concatenate((window[:, :near].ravel(), np.zeros(_ROLL - 1, np.uint8)))).reshape(len(lo), near)
    trigger = roll[:, :reach].argmin(axis=1)  # the leftmost of equal hashes, counted from the first start
    low, high = trigger - count + 1, trigger  # distances of the starts from the trigger
    parts = high // group - low // group + 1
    of = np.repeat(np.arange(len(lo)), parts)
    which = (low // group)[of] + np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    bottom, top = np.maximum(low[of], which * group), np.minimum(high[of], which * group + group - 1)
    f = Fingerprints(byte_values(False)[window.ravel()])
    head = of * window.shape[1]
    core = head + trigger[of] - which * group
    parse = mix(f(core, core + length - group + 1) + which.astype(U))
    start, n = trigger[of] - top, top - bottom + 1
    phrase = mix(f(head + start, head + start + n + length - 1) + top.astype(U))
    return parse, phrase, lo[of] + start, n, of


def _divide(length: int, reach: int, group: int):
    """The finer parse of the phrases to compare."""
    def run(batches):
        for b in batches:
            rows: list = []
            held = 0
            for ident, text, places in _places(b):
                for a in range(0, len(places), 4096):
                    pos = places[a:a + 4096]
                    parse, phrase, lo, n, of = divided(text, start_of(pos), code_of(pos) + 1, length, reach, group)
                    tie = (pos >> np.int64(START_BITS + CODE_BITS))[of]
                    rows.append((signed(parse), signed(phrase), np.full(len(lo), ident), pack(tie, lo, n - 1)))
                    held += len(lo)
                    if held > 200_000:
                        yield _occurrences(rows)
                        rows, held = [], 0
            if rows:
                yield _occurrences(rows)
    return run


def _spell_out(length: int):
    """Strings of the phrases to compare: sorted suffixes of the batch's phrases, equal neighbours merged.

    Places that are marked as repeats are passed on as they are."""
    def run(batches):
        for b in batches:
            rows: list = []
            held = 0
            for ident, text, pos in _places(b):
                known, pos = pos[pos < 0], pos[pos >= 0]
                if len(known):
                    spread = signed(mix(known.view(U) + np.full(len(known), ident).view(U) * U(0x9E3779B97F4A7C15)))
                    yield place_batch(spread, np.full(len(known), ident), known)
                lo, count = start_of(pos), code_of(pos) + 1
                start = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                tie = np.repeat(pos >> np.int64(START_BITS + CODE_BITS), count)
                for a in range(0, len(start), 50_000):
                    s = start[a:a + 50_000]
                    rows.append((text[s[:, None] + np.arange(length)], np.full(len(s), ident), pack(tie[a:a + 50_000], s)))
                    held += len(s)
                    if held >= 50_000:
                        yield _suffix_order(rows, length)
                        rows, held = [], 0
            if rows:
                yield _suffix_order(rows, length)
    return run


def _suffix_order(rows: list, length: int) -> pa.RecordBatch:
    strings, ident, pos = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.lexsort((pos, ident))
    strings, ident, pos = strings[order], ident[order], pos[order]
    # the suffix array of these phrases, to the depth that matters; stable, so corpus order within equals
    order = np.argsort(np.ascontiguousarray(strings).view(f"V{length}").ravel().view(f"S{length}")
                       if not (strings == 0).any() else _ranks(strings), kind="stable")
    strings, ident, pos = strings[order], ident[order], pos[order]
    same = np.zeros(len(pos), bool)
    same[1:] = (strings[1:] == strings[:-1]).all(axis=1)
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(pos))))
    known = same & ((ident != ident[first]) | (pos != pos[first]))
    flat = np.ascontiguousarray(strings).ravel()
    heads = np.arange(len(pos)) * length
    key = Fingerprints(byte_values(False)[flat])(heads, heads + length)
    spread = signed(mix(pos.view(U) + ident.view(U) * U(0x9E3779B97F4A7C15)))
    return place_batch(np.where(known, spread, signed(key)), ident, np.where(known, pos | np.int64(KNOWN), pos))


def _ranks(strings: np.ndarray) -> np.ndarray:
    """Ranks of byte strings that hold zero bytes (a fixed-width string type would drop them at the end)."""
    return np.unique(strings, axis=0, return_inverse=True)[1].ravel()


def _carrying(docs: DataFrame, carry: bool, text: str = "text") -> DataFrame:
    """``(id, tie, row)``: the row as a struct, of all columns or of the text alone.

    The text is only read inside tasks, from the struct, so that all joins below shuffle the same
    projection of the documents and Spark does it once."""
    return packed(docs if carry else docs.select("doc_id", text)).withColumn("row", F.col("row") if carry else F.struct(f"row.{text}"))


def _text(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return bytes_and_offsets(batch.column("row").field("text"))


def _ordered(occurrences: DataFrame) -> DataFrame:
    return (occurrences.repartition(partitions(occurrences), "key").sortWithinPartitions("key", "phrase", "id", "pos")
            .mapInArrow(_order_of_parse, "id long, pos long, kind int"))


def _at_texts(rows: DataFrame, found: DataFrame, pos) -> DataFrame:
    """The places found in each document beside its row."""
    places = found.groupBy("id", tie_from().alias("tie")).agg(F.collect_list(pos).alias("places"))
    return rows.join(places, ["id", "tie"])


def _ranges(rows: DataFrame, length: int, reach: int) -> DataFrame:
    texts = rows.select("id", "tie", F.col("row.text").alias("text"))
    found = cut(_ordered(texts.mapInArrow(_parse(length, reach), _OCCURRENCES_DDL)))
    finer = _ordered(_at_texts(rows, found.where(F.col("kind") == _COMPARE), F.col("pos"))
                     .mapInArrow(_divide(length, reach, min(GROUP, reach)), _OCCURRENCES_DDL))
    # repeats and phrases still to compare go on together, so that the finer parse is read once
    marked = F.when(F.col("kind") == _REPEAT, F.col("pos").bitwiseOR(F.lit(KNOWN))).otherwise(F.col("pos"))
    strings = _at_texts(rows, finer, marked).mapInArrow(_spell_out(length), PLACES_DDL)
    later = found.where(F.col("kind") == _REPEAT).select("id", "pos").unionByName(later_places(strings))
    start = F.shiftright("pos", CODE_BITS).bitwiseAND((1 << START_BITS) - 1)
    stop = start + F.col("pos").bitwiseAND((1 << CODE_BITS) - 1) + length
    return later.select("id", tie_from().alias("tie"), start.alias("start"), stop.alias("stop"))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, reach: int = REACH) -> DataFrame:
    """``(id, tie, start, stop)``: ranges of bytes that repeat; ranges of a document may overlap."""
    return _ranges(_carrying(docs, False), length, reach)


def union_of(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of ranges (ranges that touch are one run)."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(stops[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return s[new], e[last]


def _remove(batches):
    for b in batches:
        data, off = _text(b)
        lists = b.column("ranges")
        values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
        ends = ends - ends[0]
        kept, texts, counts = [], [], []
        for r in range(b.num_rows):
            text = data[off[r]:off[r + 1]]
            own = values[ends[r]:ends[r + 1]]
            if len(own):
                s, e = union_of(own >> np.int64(START_BITS), own & np.int64((1 << START_BITS) - 1))
                edge = np.zeros(len(text) + 1, np.int8)
                edge[s] += 1
                edge[e] -= 1
                left = text[np.cumsum(edge[:-1]) == 0].tobytes()
            else:
                s, left = own, text.tobytes()
            kept.append(left)
            texts.append(left.decode("utf-8", "ignore"))  # without the halves of characters that were cut
            counts.append((len(text), len(text) - len(left), len(s)))
        yield pa.RecordBatch.from_arrays(
            [b.column("row"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
             pa.array(kept, pa.binary()), pa.array(texts, pa.string())],
            names=["row", "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, reach: int = REACH, carry: bool = True) -> DataFrame:
    """Every row with its repeated bytes removed.

    ``row`` (struct of all columns as they were; with ``carry=False`` of doc_id's key and text),
    ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), ``kept`` (the remaining bytes) and
    ``kept_text`` (these as text, without the halves of characters that were cut)."""
    rows = _carrying(docs, carry)
    ranges = (_ranges(rows, length, reach)
              .groupBy("id", "tie").agg(F.collect_list(F.shiftleft("start", START_BITS).bitwiseOR(F.col("stop"))).alias("ranges")))
    joined = rows.join(ranges, ["id", "tie"], "left").select(
        "row" if carry else F.struct("id", "row.text").alias("row"),
        F.coalesce("ranges", F.array().cast("array<long>")).alias("ranges"))
    schema = T.StructType([T.StructField("row", joined.schema["row"].dataType),
                           *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
                           T.StructField("kept", T.BinaryType()), T.StructField("kept_text", T.StringType())])
    return joined.mapInArrow(_remove, schema)


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`remove_repeats` for every row of ``documents``."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), carry=False)
    return out.select(original_id("row.id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated bytes removed from ``text`` (and ``n_chars`` to match).

    Rows that lose nothing stay as they were; a document that loses everything stays with an empty text."""
    out, lost = remove_repeats(docs), F.col("n_removed") > 0
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return out.select(*[F.when(lost, new[c]).otherwise(F.col(f"row.`{c}`")).alias(c) if c in new else F.col(f"row.`{c}`").alias(c)
                        for c in docs.columns])
