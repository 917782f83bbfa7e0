"""Document keys, row packing and lineage cuts shared by the operators of this subpackage.

A document is told apart by ``(doc_id, tie)``: ``tie`` is 0 to 2**26-1, a CRC of its text, so rows
that repeat a ``doc_id`` with the same text are one document (each of its rows gets the same result)
and rows that repeat it with another text are two documents, ordered by ``tie``.  A null ``doc_id``
counts as the smallest id.  A null text counts as empty.
"""

from __future__ import annotations

import gc
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.session import materialize

NULL_ID = -(1 << 63)
TIE_BITS = 26
_PAUSE_S = 0.3


def id_column(name: str = "doc_id"):
    """The id as a non-null long (null: the smallest long)."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def tie_column(text: str = "text"):
    """The CRC of the text that tells apart rows with the same id (0 for a null text)."""
    return F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")).bitwiseAND((1 << TIE_BITS) - 1), F.lit(0)).cast("long")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, tie, text)`` of every row; no other column is read, so none can clash."""
    return docs.select(id_column(doc_id).alias("id"), tie_column(text).alias("tie"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))


def original_id(col: str = "id"):
    return F.when(F.col(col) != NULL_ID, F.col(col))


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Whole rows as one struct beside their key; whatever the columns are called, they stay apart."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       id_column(doc_id).alias("id"), tie_column(text).alias("tie"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("row.*")


def keep_documents(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``(id, tie)`` is in ``kept``, with their columns as they were."""
    return unpacked(packed(docs).join(kept.select("id", "tie").distinct(), ["id", "tie"], "left_semi"))


def one_row_each(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """As :func:`keep_documents`, but one row a document: the least by its other columns (as JSON).

    Repeated rows meet in the map tasks already, so a document that fills the table is not gathered."""
    others = F.to_json(F.struct(*[F.col("row").getField(c) for c in docs.columns if c != "text"]))
    once = packed(docs).groupBy("id", "tie").agg(F.min_by("row", F.struct(F.col("row.text").isNull(), others)).alias("row"))
    return unpacked(once.join(kept.select("id", "tie").distinct(), ["id", "tie"], "left_semi"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: a reliable checkpoint in the shared folder of ``spark.checkpoint.dir``.

    The shuffle files behind it are of no use any more; Spark deletes them once the driver's JVM finds
    that nothing holds the plan, so the plan is let go here and garbage is collected.  Handles that
    Python drops reach the JVM a little later, hence two rounds with a pause.  Callers should not keep
    ``df`` either."""
    spark = df.sparkSession
    out = materialize(df)
    del df
    for _ in range(2):
        gc.collect()
        time.sleep(_PAUSE_S)
        spark.sparkContext._jvm.System.gc()
    return out


def partitions(df: DataFrame) -> int:
    """The session's shuffle partition count, for explicit ``repartition`` calls."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bytes_and_offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's UTF-8 bytes, all in one array, and its ``n + 1`` offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)
    off = off[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return (raw[off[0]:off[-1]], off - off[0]) if len(column) else (raw[:0], np.zeros(1, np.int64))


def slices(offsets: np.ndarray, most: int):
    """Row ranges ``(a, b)`` of at most ``most`` bytes of text each (a longer row comes alone)."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)
