"""First occurrences over a whole corpus: which of many fingerprinted places repeat an earlier one.

Places are rows ``(key, id, pos)`` with ``pos`` = ``tie`` and start in one long (:func:`pack`).  They
are dealt out by key and sorted by ``(key, id, pos)``; a task reads them as a stream and passes on
every place but the first of its key, so it holds no group, however many places share a key.  What a
map task already knows to be a repeat (:func:`mark_repeats`) is dealt out evenly, so one
key brings a reducer about one row of each Arrow batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.frames import partitions
from agewise.llm.hashing import U, mix, signed

#: pos = tie << 37 | start << 6 | length code; the sign bit marks a place known to be a repeat.
START_BITS, CODE_BITS = 31, 6
KNOWN = -(1 << 63)
PLACES = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("pos", pa.int64())])
PLACES_DDL = "key long, id long, pos long"


def pack(tie: np.ndarray, start: np.ndarray, code: np.ndarray | int = 0) -> np.ndarray:
    return (tie.astype(np.int64) << (START_BITS + CODE_BITS)) | (start.astype(np.int64) << CODE_BITS) | code


def start_of(pos: np.ndarray) -> np.ndarray:
    return (pos >> CODE_BITS) & ((1 << START_BITS) - 1)


def code_of(pos: np.ndarray) -> np.ndarray:
    return pos & ((1 << CODE_BITS) - 1)


def tie_from(pos: str = "pos"):
    """``tie`` of a packed place, as a column."""
    return F.shiftright(F.col(pos).bitwiseAND((1 << 63) - 1), START_BITS + CODE_BITS)


def repeats_in(key: np.ndarray, ident: np.ndarray, pos: np.ndarray, open_run: tuple | None = None):
    """Of places sorted by (key, id, pos): which repeat an earlier place of their key, and the first
    place ``(key, id, pos)`` of the last key's run.  ``open_run`` is that of the batch before.  A place
    listed twice (its row is in the table twice) does not repeat itself."""
    if not len(key):
        return np.zeros(0, bool), open_run
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    first_id, first_pos = ident[first], pos[first]
    if open_run is not None and open_run[0] == key[0]:
        first_id[first == 0], first_pos[first == 0] = open_run[1], open_run[2]
    return (ident != first_id) | (pos != first_pos), (key[-1], first_id[-1], first_pos[-1])


def mark_repeats(key: np.ndarray, ident: np.ndarray, pos: np.ndarray):
    """Sorted places of one batch; each that repeats another is marked as known, and its key is
    replaced by one that spreads evenly."""
    order = np.lexsort((pos, ident, key))
    key, ident, pos = key[order], ident[order], pos[order]
    known, _ = repeats_in(key, ident, pos)
    spread = signed(mix(pos.view(U) + ident.view(U) * U(0x9E3779B97F4A7C15)))
    return np.where(known, spread, key), ident, np.where(known, pos | np.int64(KNOWN), pos)


def place_batch(key: np.ndarray, ident: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, ident, pos)], schema=PLACES)


def _later(batches):
    open_run = None
    for b in batches:
        key, ident, pos = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        known = pos < 0
        a, i, p = key[~known], ident[~known], pos[~known]
        again, open_run = repeats_in(a, i, p, open_run)
        i, p = np.concatenate([i[again], ident[known]]), np.concatenate([p[again], pos[known] & ~np.int64(KNOWN)])
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(p)], names=["id", "pos"])


def later_places(places: DataFrame) -> DataFrame:
    """``(id, pos)`` of every place but the first one of its key."""
    n = partitions(places)
    return (places.repartition(n, "key").sortWithinPartitions("key", "id", "pos")
            .mapInArrow(_later, "id long, pos long"))
