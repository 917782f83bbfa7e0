"""Importances and explanations of scores.

Everything is per row or per entity: contributions come from the long form
(entity, feature, value) joined to per-feature statistics and importances -
tables bounded by the number of features and broadcast as such.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed as FX
from ..functions.columns import confidence_band, fixed, risk_band, signal_direction, signed_fixed
from ..functions.text import render
from ..spec import TIER_LABELS
from .cohort import first_rows


# Mathematically equal values (a feature and its rescaled copy) can differ in
# the last bits; ordering keys are rounded to this many decimals so that such
# ties fall back to the feature name instead of to floating point noise.
ORDER_DIGITS = 10


def importance_table(imp: DataFrame) -> DataFrame:
    """M9: (feature, importance) sorted by importance, with percent and running
    percent.  One row per feature, so the ordering window is feature-sized."""
    key = [F.round("importance", ORDER_DIGITS).desc(), F.col("feature")]
    w = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (imp.select("feature", "importance")
               .withColumn("importance_pct", F.col("importance") * 100)
               .withColumn("cumulative_pct", F.sum("importance_pct").over(w))
               .withColumn("rank", F.row_number().over(Window.orderBy(*key))))


def importance_by_category(imp: DataFrame, schema: DataFrame) -> DataFrame:
    """Total importance (and percent) per feature family."""
    return (imp.join(F.broadcast(schema.select("feature", "category")), "feature")
               .groupBy("category").agg(F.sum("importance").alias("importance"),
                                        (F.sum("importance") * 100).alias("importance_pct")))


def correlation_importance(table: DataFrame, cols: list[str], label: str) -> DataFrame:
    """A data-derived importance: |Pearson r with the label|, normalised to sum 1
    (features without a defined r get 0)."""
    longf = table.select(F.col(label).cast("double").alias("_y"),
                         *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["_y"], cols, "feature", "value")
    r = longf.groupBy("feature").agg(F.abs(F.corr("value", "_y")).alias("a"))
    r = r.withColumn("a", F.coalesce(F.col("a"), F.lit(0.0)))
    total = F.sum("a").over(Window.partitionBy(F.lit(1)))  # one row per feature
    return r.select("feature", F.coalesce(F.try_divide(F.col("a"), total), F.lit(0.0)).alias("importance"))


def feature_reference_stats(table: DataFrame, cols: list[str]) -> DataFrame:
    """Mean and sample std of every feature over its non-missing values; a
    zero or undefined std is replaced by 1 (used to z-score contributions)."""
    longf = table.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature", "value")
    s = longf.groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    sd = F.col("sd")
    return s.select("feature", "mean",
                    F.when(sd.isNull() | F.isnan(sd) | (sd <= 0), F.lit(1.0)).otherwise(sd).alias("std"))


def contributions(rows: DataFrame, ref: DataFrame, imp: DataFrame, cols: list[str], entity: str) -> DataFrame:
    """Importance x z-score x 100 for every non-missing feature of an entity's first row."""
    longf = first_rows(rows.select(entity, *cols), entity).select(entity, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [entity], cols, "feature", "value").filter(F.col("value").isNotNull())
    j = longf.join(F.broadcast(ref), "feature").join(F.broadcast(imp.select("feature", "importance")),
                                                     "feature", "left")
    z = (F.col("value") - F.col("mean")) / F.col("std")
    return j.select(entity, "feature", "value", "mean", z.alias("z"),
                    (F.coalesce(F.col("importance"), F.lit(0.0)) * z * 100).alias("contribution"))


def top_factors(contrib: DataFrame, entity: str, n: int = 5) -> DataFrame:
    """Per entity the ``n`` largest positive and negative contributions by
    absolute size (zero is neither).  Partitions hold one entity's features."""
    c = F.col("contribution")
    signed = contrib.filter(c != 0).withColumn("sign", F.when(c > 0, "positive").otherwise("negative"))
    w = Window.partitionBy(entity, "sign").orderBy(F.round(F.abs(c), ORDER_DIGITS).desc(), F.col("feature"))
    return signed.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def describe_factor(category: Column, feature: Column, stat: Column, age: Column, value: Column,
                    mean: Column, z: Column, base_age: int, high_name: str, mean_name: str,
                    seasons_name: str) -> Column:
    """The templated sentence of one contribution (templates, words and
    limits in agewise.fixed)."""
    mag = None
    for limit, word in FX.MAGNITUDES:
        mag = F.when(F.abs(z) > limit, word) if mag is None else mag.when(F.abs(z) > limit, word)
    parts = {
        "stat": stat, "base": F.lit(str(base_age)), "age": age.cast("string"), "feature": feature,
        "magnitude": mag.otherwise(FX.MAGNITUDE_ELSE),
        "direction": F.when(z > 0, FX.ABOVE).otherwise(FX.BELOW),
        "change": F.when(value > 0, FX.INCREASED).otherwise(FX.DECREASED),
        "value1": fixed(value, 1), "value2": fixed(value, 2), "value3": fixed(value, 3),
        "abs2": fixed(F.abs(value), 2), "abs3": fixed(F.abs(value), 3), "mean2": fixed(mean, 2),
        "int": value.cast("bigint").cast("string"), "signed1": signed_fixed(value, 1),
    }
    T = FX.TEMPLATES

    def r(key):
        return render(T[key], **parts)
    return (F.when(category == "baseline", r("baseline"))
            .when(category == "delta", r("delta"))
            .when(feature.startswith("total_"), r("total"))
            .when(category == "trend", r("velocity"))
            .when(feature == seasons_name, r("seasons"))
            .when(feature == high_name, r("high"))
            .when(feature == mean_name, r("mean"))
            .otherwise(r("other")))


def with_confidence(scored: DataFrame, prob_cols: list[str]) -> DataFrame:
    """HIGH / MEDIUM / LOW from the largest class probability."""
    return scored.withColumn("confidence", confidence_band(*[F.col(c) for c in prob_cols]))


def with_risk(scored: DataFrame, prob_col: str) -> DataFrame:
    """Risk words from the probability of reaching the outcome."""
    return scored.withColumn("risk_level", risk_band(F.col(prob_col)))


def with_signals(table: DataFrame, delta_cols: dict) -> DataFrame:
    """Direction words for a few first-year changes, as a map stat -> word."""
    kv = []
    for stat, col in delta_cols.items():
        kv += [F.lit(stat), signal_direction(F.col(col))]
    return table.withColumn("signals", F.create_map(*kv))


def interpretation(label_word: Column, entity: Column, pct: Column, strength: Column, concern: Column,
                   comp_names: Column, comp_labels: Column) -> Column:
    """Opening by predicted class, strongest positive and negative factor,
    and the first comparables (sentences in agewise.fixed)."""
    opening = None
    for code in (2, 1):
        t = render(FX.OPENINGS[code], entity=entity, pct=pct)
        cond = label_word == TIER_LABELS[code]
        opening = F.when(cond, t) if opening is None else opening.when(cond, t)
    opening = opening.otherwise(render(FX.OPENINGS[0], entity=entity, pct=pct))
    s = F.when(strength.isNotNull(), render(FX.STRENGTH, text=strength)).otherwise(F.lit(""))
    c = F.when(concern.isNotNull(), render(FX.CONCERN, text=concern)).otherwise(F.lit(""))
    n = FX.COMPARABLES_IN_SENTENCE
    names, labels = F.slice(comp_names, 1, n), F.slice(comp_labels, 1, n)
    comp = F.when(F.size(names) > 0, render(FX.SIMILAR, names=F.array_join(names, ", "),
                                            labels=F.array_join(labels, ", "))).otherwise(F.lit(""))
    return F.concat(opening, s, c, comp)
