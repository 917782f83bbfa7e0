"""Feature extraction as one grouped conditional aggregation.

The whole feature row of an entity - the season at the baseline age, the
seasons at the delta ages, career context, trends, the label and the cohort
eligibility - comes out of a single ``groupBy(entity).agg(...)``.  "The season
at age a" is ``max_by(struct(...), when(age = a, period))`` (latest period on
ties) or ``min_by`` (earliest).  Each aggregate is combined map-side, so an
entity with very many rows is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as FX
from ..functions.columns import position_code
from ..spec import CohortPreset, clean_stat_name
from .cohort import eligibility_condition
from .labels import label_column, outcome_aggs


@dataclass(frozen=True)
class Feature:
    name: str
    category: str  # baseline | delta | context | trend
    stat: str | None
    age: int | None
    # Builds the Column over the profile columns; lazy so that the feature list
    # (names, order, families) is available without a running session.
    build: Callable[[], Column]

    @property
    def expr(self) -> Column:
        return self.build()


def _name(fmt: str, stat: str, age: int) -> str:
    return fmt.format(stat=clean_stat_name(stat), raw=stat, age=age)


def season_at_age(preset: CohortPreset, age: int, pick: str | None = None) -> Column:
    """F1 / F2: struct of the row at ``age`` (latest or earliest period), null if none."""
    spec = preset.panel
    fields = list(dict.fromkeys([spec.period, *spec.stats] + ([spec.position] if spec.position else [])))
    row = F.struct(*[F.col(c) for c in fields])
    at_age = F.when(F.col(spec.age) == age, F.col(spec.period))
    fn = F.max_by if (pick or preset.pick) == "latest" else F.min_by
    return fn(row, at_age)


def _trend_age(preset: CohortPreset) -> int:
    return preset.trend_age or preset.delta_ages[-1]


def profile_aggs(preset: CohortPreset, with_label: bool = True) -> list[Column]:
    spec = preset.panel
    base = preset.baseline_age
    age = F.col(spec.age)
    aggs = [season_at_age(preset, base).alias("_b")]
    aggs += [season_at_age(preset, a).alias(f"_d{a}") for a in preset.delta_ages]
    if preset.with_context:
        aggs.append(F.count(F.when(age <= base, 1)).alias("_n_upto"))
        if preset.career_high:
            aggs.append(F.max(F.when(age < base, F.col(preset.career_high[0]))).alias("_hi"))
        if preset.career_mean:
            aggs.append(F.avg(F.when(age < base, F.col(preset.career_mean[0]))).alias("_mean"))
    if with_label:
        aggs += outcome_aggs(preset)
    aggs.append(F.count(F.when(eligibility_condition(preset), 1)).alias("_n_elig"))
    return aggs


def entity_profile(clean: DataFrame, preset: CohortPreset, with_label: bool = True) -> DataFrame:
    """One row per entity with the aggregated columns the features read."""
    return clean.groupBy(preset.panel.entity).agg(*profile_aggs(preset, with_label))


def _field(struct: str, stat: str) -> Callable[[], Column]:
    return lambda: F.col(struct).getField(stat)


def _change(age: int, stat: str, span: int = 1) -> Callable[[], Column]:
    def build() -> Column:
        diff = F.col(f"_d{age}").getField(stat) - F.col("_b").getField(stat)
        return diff if span == 1 else diff / span
    return build


def features(preset: CohortPreset) -> list[Feature]:
    """F16: the ordered feature list; ``expr`` reads the profile columns."""
    spec = preset.panel
    base = preset.baseline_age
    out: list[Feature] = []
    for s in spec.stats:
        out.append(Feature(_name(preset.baseline_fmt, s, base), "baseline", s, base, _field("_b", s)))
    for a in preset.delta_ages:
        for s in spec.stats:
            out.append(Feature(_name(preset.delta_fmt, s, a), "delta", s, a, _change(a, s)))
    if preset.with_context:
        out.append(Feature(preset.seasons_name.format(age=base), "context", None, base,
                           lambda: F.col("_n_upto").cast("int")))
        if preset.career_high:
            out.append(Feature(preset.career_high[1], "context", preset.career_high[0], base,
                               lambda: F.col("_hi")))
        if preset.career_mean:
            out.append(Feature(preset.career_mean[1], "context", preset.career_mean[0], base,
                               lambda: F.col("_mean")))
        if spec.position:
            out.append(Feature("position_code", "context", None, base,
                               lambda: position_code(F.col("_b").getField(spec.position),
                                                     preset.position_rules, preset.position_default)))
    if preset.trend_stats or preset.velocity:
        t = _trend_age(preset)
        for s in preset.trend_stats:
            out.append(Feature(preset.trend_fmt.format(stat=clean_stat_name(s)), "trend", s, t,
                               _change(t, s)))
        for s, name in preset.velocity:
            out.append(Feature(name, "trend", s, t, _change(t, s, t - base)))
    return out


def feature_names(preset: CohortPreset) -> list[str]:
    return [f.name for f in features(preset)]


def feature_schema(spark, preset: CohortPreset) -> DataFrame:
    """F16 as a small table: position (1-based), feature, category, stat, age."""
    rows = [(i + 1, f.name, f.category, f.stat, f.age) for i, f in enumerate(features(preset))]
    return spark.createDataFrame(rows, "position int, feature string, category string, stat string, age int")


def select_features(profile: DataFrame, preset: CohortPreset, categories=None,
                    with_label: bool = True) -> DataFrame:
    fs = [f for f in features(preset) if categories is None or f.category in categories]
    cols = [f.expr.alias(f.name) for f in fs] + [F.col(preset.panel.entity)]
    if with_label:
        cols.append(label_column(preset).alias(preset.label_col))
    return profile.select(*cols)


def cohort_profile(clean: DataFrame, preset: CohortPreset, with_label: bool = True) -> DataFrame:
    """Profiles of eligible entities; under a per-pair cohort an entity with two
    eligible periods appears twice, as in the original loop over pairs."""
    prof = entity_profile(clean, preset, with_label).filter(F.col("_n_elig") > 0)
    if not preset.distinct_entities:
        prof = prof.withColumn("_rep", F.explode(F.sequence(F.lit(1), F.col("_n_elig").cast("int"))))
    return prof


def training_dataset(clean: DataFrame, preset: CohortPreset, categories=None) -> DataFrame:
    """Features of the cohort + entity + label, in feature order."""
    return select_features(cohort_profile(clean, preset), preset, categories)


# --------------------------------------------------------------------------
# What-if rows and request rows
# --------------------------------------------------------------------------

# What-if constants of the original form (agewise.fixed).
SCENARIO_SHARES = FX.SCENARIO_SHARES
SCENARIO_CAREER_MEAN_FACTOR = FX.SCENARIO_CAREER_MEAN_FACTOR
SCENARIO_POSITION = FX.SCENARIO_POSITION


def scenario_features(scenarios: DataFrame, preset: CohortPreset, changed_stats,
                      ranges: dict | None = None, id_col: str = "scenario") -> DataFrame:
    """what-if input (``base_<stat>``, ``change_<stat>``, ``seasons``,
    ``career_high``) to a full feature row; ``valid`` tells whether every
    input is inside ``ranges`` (stat -> (lo, hi)) when ranges are given."""
    spec = preset.panel
    base_age = preset.baseline_age
    bcol = {s: F.col(f"base_{s}") for s in spec.stats}
    ccol = {s: (F.col(f"change_{s}") if s in changed_stats else F.lit(0.0)) for s in spec.stats}
    exprs = {}
    for f in features(preset):
        if f.category == "baseline":
            exprs[f.name] = bcol[f.stat]
        elif f.category == "delta":
            times, by = SCENARIO_SHARES[preset.delta_ages.index(f.age)]
            exprs[f.name] = ccol[f.stat] * times / by if f.stat in changed_stats else F.lit(0.0)
        elif f.category == "context":
            if f.name == "position_code":
                exprs[f.name] = F.lit(SCENARIO_POSITION)
            elif preset.career_high and f.name == preset.career_high[1]:
                exprs[f.name] = F.col("career_high")
            elif preset.career_mean and f.name == preset.career_mean[1]:
                exprs[f.name] = bcol[preset.career_mean[0]] * SCENARIO_CAREER_MEAN_FACTOR
            else:
                exprs[f.name] = F.col("seasons").cast("int")
        else:  # trend
            span = _trend_age(preset) - base_age
            total = ccol[f.stat]
            exprs[f.name] = total / span if f.name in dict((n, s) for s, n in preset.velocity) else total
    cols = [F.col(id_col)] + [e.alias(n) for n, e in exprs.items()]
    if ranges:
        ok = F.lit(True)
        for name, (lo, hi) in ranges.items():
            ok = ok & exprs[name].between(lo, hi)
        cols.append(ok.alias("valid"))
    return scenarios.select(*cols)


def request_features(requests: DataFrame, preset: CohortPreset, json_col: str = "request",
                     keep=("entity",)) -> DataFrame:
    """JSON request ``{"age_28": {stat: value}, ...}`` to the baseline and
    delta features of the preset; a missing age or stat gives null.  Requests that can't be used give no
    row here; they are in the second table of ``readers.split_requests``."""
    from ..sources.readers import parse_requests

    parsed = parse_requests(requests, json_col).filter(F.col("_reason").isNull())
    base = F.try_element_at(F.col("_req"), F.lit(f"age_{preset.baseline_age}"))
    cols = [F.col(k) for k in keep]
    for s in preset.panel.stats:
        cols.append(F.try_element_at(base, F.lit(s)).alias(_name(preset.baseline_fmt, s, preset.baseline_age)))
    for a in preset.delta_ages:
        at = F.try_element_at(F.col("_req"), F.lit(f"age_{a}"))
        for s in preset.panel.stats:
            cols.append((F.try_element_at(at, F.lit(s)) - F.try_element_at(base, F.lit(s)))
                        .alias(_name(preset.delta_fmt, s, a)))
    return parsed.select(*cols)
