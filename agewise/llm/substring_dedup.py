"""Substring de-duplication by sliding sentence spans.

Runs of consecutive sentences of a document are fingerprinted (words, lower-case A-Z, whatever the
white space between them); all runs meet corpus-wide; the sentences covered by a run that is not the
first of its kind (least doc_id, then least position) are removed.

A sentence ends with a word that ends in a stop (``.!?`` and those of other scripts in ``_STOPS_3``,
before at most two closing quotes or brackets), at a line feed, or with the text.  Long sentences would
hide a repeated passage that starts and ends inside them, so parts count as sentences of their own: one
also ends with a word that ends in ``,``, ``;`` or ``:``, and with every word whose fingerprint is
divisible by ``PART`` (a property of the word alone, so copies are divided alike).  Each sentence starts
the shortest run of at least ``span`` sentences and ``min_words`` words, and each one ends the shortest
such run, so that of a repeated passage no sentence at either end is left out.  A text that is too short
for any run is one run as a whole: exact copies leave nothing.

Rows are streamed through partitions sorted by fingerprint (:mod:`agewise.llm.repeats`): a passage
that a third of the corpus shares is never gathered, and the runs that a map task already knows to be
repeats are dealt out evenly.  Defined results: a null text is empty; a text without words stays; repeated rows of a document agree; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import bytes_and_offsets, keyed, original_id, slices
from agewise.llm.hashing import PIECE, Fingerprints, U, signed, word_hashes
from agewise.llm.repeats import PLACES_DDL, START_BITS, CODE_BITS, code_of, later_places, mark_repeats, pack, place_batch, start_of, tie_from

SPAN = 3
#: A run has so many words at least, and so at most as many sentences (6 bits hold their number).
MIN_WORDS = 25
PART = 16
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?,;:"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]}"]] = True


def _codes(characters: str) -> np.ndarray:
    """The UTF-8 bytes of each character, as a number."""
    return np.array([int.from_bytes(c.encode(), "big") for c in characters], np.int64)


# stops and closing quotes outside ASCII, by the length of their UTF-8 form
_STOPS_3, _STOPS_2 = _codes("。！？…，；：।॥"), _codes("؟،؛۔")
_CLOSE_3, _CLOSE_2 = _codes("”’」』）›"), _codes("»")


def _last(data: np.ndarray, start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` bytes of each range as a number (-1 where it is shorter)."""
    code = np.zeros(len(end), np.int64)
    for i in range(n, 0, -1):
        code = code << 8 | data[np.maximum(end - i, 0)]
    return np.where(end - start >= n, code, -1)


def at_stop(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether a word ends a sentence (or a part of one) by its last characters."""
    for _ in range(2):
        close = np.where(_CLOSE[data[end - 1]], 1, 0)
        close = np.where(np.isin(_last(data, start, end, 3), _CLOSE_3), 3, close)
        close = np.where(np.isin(_last(data, start, end, 2), _CLOSE_2), 2, close)
        end = np.where(end - start > close, end - close, end)
    return (_STOPS[data[end - 1]] | np.isin(_last(data, start, end, 3), _STOPS_3) | np.isin(_last(data, start, end, 2), _STOPS_2))


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Of rows of text: word fingerprints, word starts, first word of each sentence (and the end), row of each."""
    h, start, end, row = word_hashes(data, offsets)
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, start, np.zeros(1, np.int64), z
    lines = np.concatenate(([0], np.cumsum(data == 10, dtype=np.int32)))
    last = at_stop(data, start, end) | (h % U(PART) == 0)
    last[:-1] |= (row[1:] != row[:-1]) | (lines[start[1:]] > lines[end[:-1]])
    last[-1] = True
    first = np.concatenate(([0], np.flatnonzero(last) + 1))
    return h, start, first, row[first[:-1]]


def runs_of(first: np.ndarray, row: np.ndarray, span: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and end of every run: from each sentence, to each sentence, and whole texts without any."""
    n = len(row)
    if not n:
        return row, row
    u = np.arange(n)
    v = np.maximum(u + span, np.searchsorted(first, first[:-1] + min_words))
    fits = (v <= n) & (row[np.minimum(v, n) - 1] == row)
    end = u + 1
    begin = np.minimum(end - span, np.searchsorted(first, first[end] - min_words, side="right") - 1)
    from_end = (begin >= 0) & (row[np.maximum(begin, 0)] == row)
    at = np.maximum(begin, 0)
    from_end &= ~(fits[at] & (v[at] == end))  # not those found already
    whole = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    whole_end = np.append(whole[1:], n)
    short = np.add.reduceat(fits, whole) == 0
    return (np.concatenate((u[fits], begin[from_end], whole[short])),
            np.concatenate((v[fits], end[from_end], whole_end[short])))


def _runs(span: int, min_words: int):
    def run(batches):
        for b in batches:
            data, off = bytes_and_offsets(b.column("text"))
            ids, ties = (b.column(c).to_numpy(zero_copy_only=False) for c in ("id", "tie"))
            for a, z in slices(off, PIECE):
                h, _, first, row = sentences(data[off[a]:off[z]], off[a:z + 1] - off[a])
                u, v = runs_of(first, row, span, min_words)
                if not len(u):
                    continue
                key = Fingerprints(h)(first[u], first[v])
                number = u - np.searchsorted(row, row[u])  # of the sentence in its document
                at = row[u] + a
                yield place_batch(*mark_repeats(signed(key), ids[at], pack(ties[at], number, v - u)))
    return run


def repeated_runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, tie, run)``: every run that repeats an earlier one, packed (first sentence and how many)."""
    if not span <= min_words < 64:
        raise ValueError("span <= min_words < 64 is needed")
    later = later_places(keyed(docs).mapInArrow(_runs(span, min_words), PLACES_DDL))
    return later.select("id", tie_from().alias("tie"), F.col("pos").bitwiseAND((1 << (START_BITS + CODE_BITS)) - 1).alias("run"))


def _remove():
    names = ["id", "tie", "n_sentences", "n_removed", "n_words_removed", "text"]

    def run(batches):
        for b in batches:
            data, off = bytes_and_offsets(b.column("text"))
            lists = b.column("runs")
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            for a, z in slices(off, PIECE):
                counts, texts = [], []
                part = data[off[a]:off[z]]
                h, start, first, row = sentences(part, off[a:z + 1] - off[a])
                bounds = np.searchsorted(row, np.arange(z - a + 1))
                for r in range(a, z):
                    s, e = bounds[r - a], bounds[r - a + 1]
                    own, text = values[ends[r]:ends[r + 1]], data[off[r]:off[r + 1]]
                    if not len(own):
                        counts.append((e - s, 0, 0))
                        texts.append(text.tobytes().decode())
                        continue
                    edge = np.zeros(e - s + 1, np.int64)
                    np.add.at(edge, start_of(own), 1)
                    np.add.at(edge, start_of(own) + code_of(own), -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    # a sentence's bytes reach to the next sentence's first word
                    begin = start[first[s:e]] + off[a] - off[r]
                    begin[0] = 0
                    keep = np.repeat(~gone, np.diff(np.append(begin, len(text))))
                    counts.append((e - s, int(gone.sum()), int(np.diff(first[s:e + 1])[gone].sum())))
                    texts.append(text[keep].tobytes().decode())
                own = b.slice(a, z - a)
                yield pa.RecordBatch.from_arrays(
                    [own.column("id"), own.column("tie"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)),
                     pa.array(texts, pa.string())], names=names)
    return run


def remove_repeated_sentences(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, tie, n_sentences, n_removed, n_words_removed, text)``: every row, its text without the repeats."""
    runs = repeated_runs(docs, span, min_words).groupBy("id", "tie").agg(F.collect_list("run").alias("runs"))
    return (keyed(docs).join(runs, ["id", "tie"], "left")
            .withColumn("runs", F.coalesce("runs", F.array().cast("array<long>")))
            .mapInArrow(_remove(), "id long, tie long, n_sentences long, n_removed long, n_words_removed long, text string"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its repeated sentences removed."""
    out = remove_repeated_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(original_id().alias("doc_id"), "n_sentences", "n_removed", "n_words_removed", "text")
