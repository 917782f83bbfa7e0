"""Descriptive reports over the clean panel and the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..spec import PanelSpec


def panel_summary(clean: DataFrame, spec: PanelSpec, approx_distinct: bool = False) -> DataFrame:
    """Rows, distinct entities, period and age range, mean weight and the
    share (percent) of rows where each stat is present - one aggregation."""
    n = F.count(F.lit(1))
    ent = F.approx_count_distinct(spec.entity) if approx_distinct else F.countDistinct(spec.entity)
    aggs = [n.alias("total_records"), ent.alias("unique_entities"),
            F.min(spec.period).alias("period_min"), F.max(spec.period).alias("period_max"),
            F.min(spec.age).alias("age_min"), F.max(spec.age).alias("age_max"),
            F.avg(spec.weight).alias("avg_weight")]
    aggs += [(F.try_divide(F.count(s), n) * 100).alias(f"pct_{s}") for s in spec.stats]
    return clean.agg(*aggs)


def group_means(table: DataFrame, group: str, cols: list[str], digits: int | None = None) -> DataFrame:
    """Mean of ``cols`` per group, optionally rounded half-to-even."""
    out = []
    for c in cols:
        m = F.avg(c)
        out.append((F.bround(m, digits) if digits is not None else m).alias(c))
    return table.groupBy(group).agg(*out)


def _long(table: DataFrame, cols: list[str], ids=()) -> DataFrame:
    return table.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), cols, "feature", "value")


def feature_stats(table: DataFrame, cols: list[str]) -> DataFrame:
    """D3: mean, sample std, min, max per feature."""
    return _long(table, cols).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))


def missingness(table: DataFrame, cols: list[str]) -> DataFrame:
    """Percent of rows where each feature is missing."""
    return _long(table, cols).groupBy("feature").agg(
        (F.avg(F.col("value").isNull().cast("int")) * 100).alias("pct_missing"))


def feature_outcome_corr(table: DataFrame, cols: list[str], label: str) -> DataFrame:
    """Pearson correlation of every feature with the label."""
    return _long(table, cols, ids=(label,)).groupBy("feature").agg(
        F.corr("value", F.col(label).cast("double")).alias("r"))


def trajectory(clean: DataFrame, spec: PanelSpec, ages, stats) -> DataFrame:
    """Chosen stats at chosen ages, long form (entity, age, stat, value)."""
    rows = clean.filter(F.col(spec.age).isin(list(ages)))
    return _long(rows.select(spec.entity, spec.age, *stats), list(stats), ids=(spec.entity, spec.age)).select(
        spec.entity, spec.age, F.col("feature").alias("stat"), "value")


def trajectory_wide(clean: DataFrame, spec: PanelSpec, ages, stats) -> DataFrame:
    """D6, wide form: one row per (entity, stat), one column per chosen age
    (``age_<a>``); the age list is given, so the pivot needs no extra pass."""
    rows = clean.filter(F.col(spec.age).isin(list(ages)))
    longf = _long(rows.select(spec.entity, spec.age, spec.period, *stats), list(stats),
                  ids=(spec.entity, spec.age, spec.period))
    # two seasons at one age: the latest one, as the feature row does
    return (longf.groupBy(spec.entity, F.col("feature").alias("stat")).pivot(spec.age, list(ages))
                 .agg(F.max_by("value", spec.period))
                 .select(spec.entity, "stat", *[F.col(str(a)).alias(f"age_{a}") for a in ages]))


def case_table(scored: DataFrame, entity: str, names: list[str], cols: list[str]) -> DataFrame:
    """The named entities with the chosen columns (a small literal list,
    applied as a semi join the planner can broadcast)."""
    wanted = scored.sparkSession.createDataFrame([(n,) for n in names], f"{entity} string")
    return scored.join(F.broadcast(wanted), entity, "left_semi").select(entity, *cols)


def top_n(table: DataFrame, order_col: str, n: int, tie: str) -> DataFrame:
    """The ``n`` largest rows (planned as TakeOrderedAndProject)."""
    return table.orderBy(F.round(order_col, 10).desc(), F.col(tie)).limit(n)
