"""Running totals along an order inside groups, without one task per group.

A plain ``sum() over (partition by g order by x)`` moves every row of ``g`` to one task.  Here rows are dealt
by ranges of (group, order value), so a group of any size is spread and equal order values share a range.
Each range's sums make a small table (a row for each group in each partition), whose running sums are the
offsets; a row's total is the running sum within its range plus the offset.  The plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sums(df: DataFrame, group_cols: list[str], order_col: str, value_cols: list[str],
                 descending: bool = True, partitions: int | None = None, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<v>``: sum of ``v`` over rows of the group whose order value is
    at or before this row's (descending: greater or equal)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    # written once, since a second evaluation could draw the ranges elsewhere
    dealt = materialize(df.repartitionByRange(n, *group_cols, order).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy(*group_cols).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group_cols, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    offsets = sums.select(*[F.col(c).alias(f"_g_{c}") for c in group_cols], F.col("_range").alias("_r"),
                          *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in value_cols])
    same = F.col("_range") == F.col("_r")
    for c in group_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    within = Window.partitionBy(*group_cols, "_range").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({f"_w_{v}": F.sum(v).over(within) for v in value_cols}).join(offsets, same)
    return out.select(*df.columns, *[(F.col(f"_w_{v}") + F.col(f"_o_{v}")).alias(f"{prefix}{v}") for v in value_cols])
