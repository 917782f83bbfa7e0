"""A whole cohort study in one call: the chain a user of the original runs
as separate scripts (clean -> cohort + features + labels -> split, CV and
tuning -> test evaluation -> batch scores with explanations -> reports)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed as FX
from ..operators import explain as X
from ..operators.clean import clean_panel
from ..operators.features import feature_names, feature_schema, training_dataset
from ..operators.split import stratified_split
from ..session import materialize
from ..spec import CohortPreset
from . import describe as D
from . import evaluation as E
from . import scoring as SC
from .training import BINARY_FOREST, ForestConfig, forest_pipeline, importances


def run_study(raw: DataFrame, preset: CohortPreset, forest: ForestConfig | None = None, n_iter: int = 30,
              folds: int = 5, seed: int = 42, neighbors: int = 5, explain: DataFrame | None = None) -> dict:
    """``explain``: entities (one column named like the entity) whose nearest
    comparables are wanted; by default every cohort entity.  Exact search is
    queries x candidates work, so at large scale pass the entities of interest
    (the candidates are always the whole cohort).  A preset with a reached-age
    label takes the binary study, which neither tunes nor cross-validates."""
    if preset.label != "tier":
        return binary_study(raw, preset, forest or BINARY_FOREST, seed, neighbors, explain)
    spark = raw.sparkSession
    entity, label = preset.panel.entity, preset.label_col
    k = 3
    feats = feature_names(preset)
    clean = materialize(clean_panel(raw, preset))          # re-read by several reports
    table = materialize(training_dataset(clean, preset))   # re-read by every ML step
    run = SC.training_run(table, feats, label, entity, k, forest or ForestConfig(), n_iter, folds, seed)
    model = run["model"]
    scored = SC.score(model, table, entity, k, keep=(label,))
    probs = SC.prob_cols(k)
    out = {
        "clean": clean, "table": table, "summary": run["summary"], "search": run["search"],
        "importances": X.importance_table(importances(model, feats)),
        "importance_by_category": X.importance_by_category(importances(model, feats), feature_schema(spark, preset)),
        "ranking": SC.ranking_table(scored, entity, label, k),
        "test_report": E.classification_report(run["scored_test"], label, "pred", k),
        "test_confusion": E.confusion(run["scored_test"], label, "pred", k),
        "test_auc": E.auc_ovr(run["scored_test"], label, probs),
        "panel_summary": D.panel_summary(clean, preset.panel),
        "feature_corr": D.feature_outcome_corr(table, feats, label),
        "missingness": D.missingness(table, feats),
        "comparables": SC.comparables(
            model, table if explain is None else table.join(explain.select(entity).distinct(), entity, "left_semi"),
            table, entity, label, neighbors),
    }
    baseline = [f for f in feats if f.startswith(f"age{preset.baseline_age}_")]
    out["tier_means"] = D.group_means(table, label, baseline, 2)
    out["hit_rate"] = SC.hit_rate(out["ranking"])
    out["model"] = model
    out["model_path"] = run["path"]
    return out


def binary_study(raw: DataFrame, preset: CohortPreset, forest: ForestConfig = BINARY_FOREST, seed: int = FX.SEED,
                 neighbors: int = 5, explain: DataFrame | None = None) -> dict:
    """The study of the binary outcome: split, one forest (medians imputed, no scaling), test report,
    importances, and every row scored with the probability of the outcome.  Outcomes are 0 and 1;
    the three tiers' names don't apply."""
    entity, label = preset.panel.entity, preset.label_col
    feats = feature_names(preset)
    clean = materialize(clean_panel(raw, preset))
    table = materialize(training_dataset(clean, preset))
    split = materialize(stratified_split(table, label, entity, FX.TEST_FRACTION, seed))
    model = forest_pipeline(feats, label, forest).fit(split.filter("split = 'train'"))
    test = SC.score(model, split.filter("split = 'test'"), entity, 2, keep=(label,))
    scores = SC.score(model, table, entity, 2)
    comps = SC.comparables(model, table if explain is None else table.join(explain.select(entity).distinct(), entity, "left_semi"),
                           table, entity, label, neighbors)
    return {
        "clean": clean, "table": table, "model": model, "scored_test": test,
        "test_accuracy": E.accuracy(test, label, "pred"),
        "test_report": E.classification_report(test, label, "pred", 2),
        "test_confusion": E.confusion(test, label, "pred", 2),
        "importances": X.importance_table(importances(model, feats)),
        "scores": scores.select(entity, F.col("p1").alias("probability"), (F.col("p1") >= 0.5).alias("prediction")),
        "comparables": comps.withColumnRenamed("neighbor_tier", "neighbor_outcome").drop("neighbor_label"),
        "missingness": D.missingness(table, feats),
    }
