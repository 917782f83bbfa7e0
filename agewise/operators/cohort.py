"""Cohort selection (K1-K3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spec import CohortPreset


def eligibility_condition(preset: CohortPreset) -> Column:
    """Row-level test: baseline age, weight limit and cohort period window."""
    spec = preset.panel
    lo, hi = preset.cohort_periods
    cond = (F.col(spec.age) == preset.baseline_age) & F.col(spec.period).between(lo, hi)
    if not preset.distinct_entities:
        cond = cond & (F.col(spec.weight) >= preset.min_weight)
    return cond


def eligible_cohort(clean: DataFrame, preset: CohortPreset) -> DataFrame:
    """K1 / K2: distinct (entity, period) pairs, or distinct entities when the
    preset asks for one row per entity."""
    spec = preset.panel
    keys = [spec.entity] if preset.distinct_entities else [spec.entity, spec.period]
    return clean.filter(eligibility_condition(preset)).select(*keys).distinct()


def cohort_restrict(clean: DataFrame, eligible: DataFrame, preset: CohortPreset) -> DataFrame:
    """K3: all rows of eligible entities (semi join; the planner, with AQE,
    broadcasts the eligible side only when its measured size allows)."""
    spec = preset.panel
    return clean.join(eligible.select(spec.entity).distinct(), on=spec.entity, how="left_semi")


def first_rows(table: DataFrame, entity: str, order=()) -> DataFrame:
    """One row per entity: the first by ``order``, then by all its columns.

    An entity with two eligible periods is in the cohort twice (with equal features); explanations, rankings and
    records are per entity and take its first row.  An aggregate with a map-side combine; a null entity is one."""
    row = F.struct(*[F.col(f"`{c}`") for c in table.columns])
    plain = [c for c in table.columns if c not in order and not table.schema[c].dataType.simpleString().startswith("map")]
    key = F.struct(*[F.col(f"`{c}`") for c in (*order, *plain)])
    return table.groupBy(entity).agg(F.min_by(row, key).alias("_first")).select("_first.*")
