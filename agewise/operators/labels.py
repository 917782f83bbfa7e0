"""Outcome labels (L1-L3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lookup
from ..spec import TIER_DESCRIPTIONS, TIER_LABELS, CohortPreset, TierRule


def outcome_aggs(preset: CohortPreset) -> list[Column]:
    """Aggregates over the rows at or above the outcome age (for groupBy(entity))."""
    spec = preset.panel
    if preset.label == "tier":
        r = preset.tier_rule
        late = F.col(spec.age) >= r.outcome_age
        return [F.count(F.when(late, 1)).alias("_n_out"),
                F.avg(F.when(late, F.col(r.rate_stat))).alias("_rate"),
                F.avg(F.when(late, F.col(r.impact_stat))).alias("_impact"),
                F.avg(F.when(late, F.col(spec.weight))).alias("_wavg")]
    late = F.col(spec.age) >= preset.outcome_age
    return [F.max(late.cast("int")).alias("_reached")]


def outcome_tier(n: Column, rate: Column, impact: Column, weight: Column, rule: TierRule) -> Column:
    """L1: tier from the late-row count and averages (missing averages replaced)."""
    rate = F.coalesce(rate, F.lit(rule.missing_rate))
    impact = F.coalesce(impact, F.lit(rule.missing_impact))
    weight = F.coalesce(weight, F.lit(rule.missing_weight))
    top = ((n >= rule.top_min_rows) & ((rate >= rule.top_rate) | (impact >= rule.top_impact))
           & (weight >= rule.top_weight))
    mid = ((n >= rule.mid_min_rows) & ((rate >= rule.mid_rate) | (impact >= rule.mid_impact))
           & (weight >= rule.mid_weight))
    return (F.when(n < rule.mid_min_rows, 0).when(top, 2).when(mid, 1).otherwise(0)).cast("int")


def label_column(preset: CohortPreset) -> Column:
    """The label over the columns produced by :func:`outcome_aggs`."""
    if preset.label == "tier":
        return outcome_tier(F.col("_n_out"), F.col("_rate"), F.col("_impact"),
                            F.col("_wavg"), preset.tier_rule)
    return F.coalesce(F.col("_reached"), F.lit(0)).cast("int")  # L2


def outcome_labels(clean: DataFrame, preset: CohortPreset) -> DataFrame:
    """L1 / L2 for every entity of the clean panel: (entity, label)."""
    spec = preset.panel
    return (clean.groupBy(spec.entity).agg(*outcome_aggs(preset))
                 .select(spec.entity, label_column(preset).alias(preset.label_col)))


def tier_label(code: Column) -> Column:
    """L3: tier code to its short label."""
    return lookup(TIER_LABELS, code, "Unknown")


def tier_description(code: Column) -> Column:
    """L3: tier code to its description, "Unknown" otherwise."""
    return lookup(TIER_DESCRIPTIONS, code, "Unknown")


def tier_names(df: DataFrame, code_col: str) -> DataFrame:
    return df.withColumns({f"{code_col}_label": tier_label(F.col(code_col)),
                           f"{code_col}_description": tier_description(F.col(code_col))})


def with_observability(table: DataFrame, clean: DataFrame, preset: CohortPreset,
                       baseline_period: str = "baseline_period") -> DataFrame:
    """Flag ``observable``: whether the outcome age could have been reached
    inside the panel (baseline period + years to the outcome age <= last
    period seen).  The label itself is left as it is; recent cohorts are
    right-censored, and this flag lets a user filter or weight them."""
    spec = preset.panel
    last = clean.agg(F.max(spec.period)).first()[0]  # one number
    outcome = preset.tier_rule.outcome_age if preset.label == "tier" else preset.outcome_age
    span = outcome - preset.baseline_age
    return table.withColumn("observable", (F.col(baseline_period) + F.lit(span)) <= F.lit(last))
