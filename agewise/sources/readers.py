"""Sources (S1-S3, S9): panel files, feature tables and JSON requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_COLUMNS = ("Unnamed: 0", "_c0", "")
TEXT_REQUEST = "map<string,map<string,string>>"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _drop_index(df: DataFrame) -> DataFrame:
    drop = [c for c in df.columns if c in INDEX_COLUMNS]
    return df.drop(*drop) if drop else df


def load_panel(spark: SparkSession, path: str, fmt: str | None = None,
               schema: str | None = None, ordinal: str | None = None) -> DataFrame:
    """Read a panel (CSV with a header row, or Parquet), dropping an unnamed
    index column.  CSV columns stay strings unless a schema is given; the
    clean-up coerces the numeric ones, so a bad cell never fails the read.
    ``ordinal`` names a column to stamp with the read order (:func:`file_order`)."""
    fmt = fmt or ("parquet" if path.rstrip("/").endswith(".parquet") else "csv")
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        df = reader.option("header", True).option("mode", "PERMISSIVE").csv(path)
    else:
        df = reader.format(fmt).load(path)
    if ordinal:
        df = df.withColumn(ordinal, file_order(fmt))
    return _drop_index(df)


def file_order(fmt: str) -> Column:
    """A row's place in its source, in an order that sorts: file (by path), block of the file, place in the block.

    Only the scan knows it, so it is stamped there.  Parquet counts rows within the file; in text files a block's
    rows are read one after the other by one task, in whose counter they follow one another."""
    place = F.col("_metadata.row_index") if fmt == "parquet" else F.monotonically_increasing_id()
    block = F.lit(0).cast("long") if fmt == "parquet" else F.col("_metadata.file_block_start")
    return F.struct(F.col("_metadata.file_path").alias("file"), block.alias("block"), place.alias("place"))


def load_panel_external(spark: SparkSession, path: str | None = None,
                        conf_key: str = "agewise.panel.path", **kw) -> DataFrame:
    """The panel from a configurable location - an explicit path, else the
    session setting ``conf_key`` (any file system URI Spark can read)."""
    path = path or spark.conf.get(conf_key, None)  # read, never set
    if not path:
        raise ValueError(f"no panel location: pass a path or set {conf_key}")
    return load_panel(spark, path, **kw)


def load_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """S3: a stored feature + label table (Parquet)."""
    return spark.read.parquet(path)


NO_REQUEST, MALFORMED, EMPTY, NOT_A_NUMBER = "no request", "not a JSON object of objects", "no values", "not a number"


def parse_requests(df: DataFrame, json_col: str = "request") -> DataFrame:
    """JSON request text to a typed two-level map in column ``_req``, and in ``_reason`` why it can't be used.

    Every row stays: the reason is null for a usable request, and ``_req`` is null for the others.  Values are
    read as text first, since a number that can't be read would otherwise be a missing one (a null stays one)."""
    text = F.col(json_col)
    df = df.withColumn("_text", F.from_json(text, TEXT_REQUEST))
    values = F.flatten(F.transform(F.map_values("_text"), lambda m: F.map_values(F.coalesce(m, F.create_map().cast("map<string,string>")))))
    bad = F.exists(values, lambda v: ~v.rlike(NUMBER))
    reason = (F.when(text.isNull() | (F.trim(text) == ""), NO_REQUEST).when(F.col("_text").isNull(), MALFORMED)
              .when(F.exists(F.map_values("_text"), lambda m: m.isNull()), MALFORMED)
              .when(bad, NOT_A_NUMBER).when(F.size(values) == 0, EMPTY))
    df = df.withColumn("_reason", reason)
    numbers = F.transform_values("_text", lambda _, m: F.transform_values(m, lambda _, v: v.cast("double")))
    return df.withColumn("_req", F.when(F.col("_reason").isNull(), numbers)).drop("_text")


def split_requests(df: DataFrame, json_col: str = "request") -> tuple[DataFrame, DataFrame]:
    """Usable requests, and the rejected ones with their ``reason``: together every row, also of a stream."""
    parsed = parse_requests(df, json_col)
    good = parsed.filter(F.col("_reason").isNull()).drop("_req", "_reason")
    return good, parsed.filter(F.col("_reason").isNotNull()).withColumnRenamed("_reason", "reason").drop("_req")


def request_values(df: DataFrame, json_col: str = "request", keep=("entity",)) -> DataFrame:
    """S9 in long form: one row per (request, age key, stat, value) of the usable requests; the others are in the
    second table of :func:`split_requests`."""
    parsed = parse_requests(df, json_col)
    outer = parsed.select(*keep, F.explode("_req").alias("age_key", "_stats"))
    return outer.select(*keep, "age_key", F.explode("_stats").alias("stat", "value"))
