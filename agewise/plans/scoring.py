"""Batch scoring and explained predictions (X1, X6-X11, X14) and the training
and evaluation runs (M11, E11, E12).

Everything works on whole tables: one ``transform`` scores every entity, the
explanations are joins on the entity key, and a single entity is a filter on
the result.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import confidence_band, exact_round, nearest_even, risk_band, signal_direction
from ..operators import explain as X
from ..operators.cohort import first_rows
from ..operators.knn import exact_knn, similarity
from ..operators.labels import tier_label
from ..operators.split import stratified_folds, stratified_split
from .. import fixed as FX
from ..spec import TIER_LABELS
from . import evaluation as E
from .training import ForestConfig, config_dict, cv_scores, importances, model_path, prepared_folds, random_search, save_model


def prob_cols(k: int) -> list[str]:
    return [f"p{i}" for i in range(k)]


def score(model: PipelineModel, table: DataFrame, entity: str, k: int, keep=()) -> DataFrame:
    """Predicted class and class probabilities for every row (features are
    matched by name; a missing feature column is added as null)."""
    need = model.stages[0].getInputCols()
    t = table
    for c in need:
        if c not in t.columns:
            t = t.withColumn(c, F.lit(None).cast("double"))
    ready = PipelineModel(model.stages[:-1]).transform(t)
    out = model.stages[-1].transform(ready.select(entity, *keep, "_features"))  # all that a forest reads and the result keeps
    p = vector_to_array("probability")
    return out.select(entity, *keep, F.col("prediction").cast("int").alias("pred"),
                      *[p[i].alias(f"p{i}") for i in range(k)])


def round3(c):
    """Probability to 3 decimals (scaled, half to even)."""
    return nearest_even(c, 3)


def reject_reason(entity: str, probs: list[str]):
    """Why a scored row can't be ranked: null where it can."""
    bad = F.lit(False)
    for p in probs:
        bad = bad | F.col(p).isNull() | F.isnan(p)
    return F.when(F.col(entity).isNull(), "no entity").when(bad, "no probabilities")


def ranking_table(scored: DataFrame, entity: str, label: str, k: int) -> DataFrame:
    """Every entity once (its first row) with prediction, rounded probabilities, confidence band
    (from the unrounded ones), actual label and correctness, best first.  Rows that can't be ranked are in
    :func:`ranking_rejects`."""
    probs = prob_cols(k)
    kept = first_rows(scored.filter(reject_reason(entity, probs).isNull()), entity)
    out = kept.select(
        entity, F.col("pred").alias("predicted_tier"), tier_label(F.col("pred")).alias("predicted_label"),
        *[round3(F.col(p)).alias(f"prob_{i}") for i, p in enumerate(probs)],
        confidence_band(*[F.col(p) for p in probs]).alias("confidence"),
        F.col(label).cast("int").alias("actual_tier"), tier_label(F.col(label)).alias("actual_label"),
        (F.col("pred") == F.col(label)).alias("correct"))
    return out.orderBy(F.col(f"prob_{k - 1}").desc(), F.col(entity))


def ranking_rejects(scored: DataFrame, entity: str, k: int) -> DataFrame:
    """X9's second output: the scored rows that can't be ranked, with the reason."""
    return scored.withColumn("reason", reject_reason(entity, prob_cols(k))).filter(F.col("reason").isNotNull())


def hit_rate(ranking: DataFrame) -> DataFrame:
    """Correct / total."""
    return ranking.agg(F.avg(F.col("correct").cast("int")).alias("hit_rate"),
                       F.count(F.lit(1)).alias("n"))


def feature_vectors(model: PipelineModel, table: DataFrame, entity: str, keep=()) -> DataFrame:
    """Imputed (and scaled) feature array of every row, as the forest sees it."""
    pre = PipelineModel(stages=[s for s in model.stages[:-1] if s.__class__.__name__ != "VectorAssembler"
                                and s.__class__.__name__ != "BalancedWeightsModel"])
    out = pre.transform(table)
    last = pre.stages[-1]
    cols = last.getOutputCols()
    return out.select(entity, *keep, F.array(*[F.col(c) for c in cols]).alias("vec"))


def comparables(model: PipelineModel, queries: DataFrame, reference: DataFrame, entity: str, label: str,
                k: int = 5, exclude_self: bool = False) -> DataFrame:
    """X6 over the model's feature space: the ``k`` nearest reference rows of
    every query with similarity and outcome."""
    qv = feature_vectors(model, queries, entity)
    rv = feature_vectors(model, reference, entity, keep=(label,))
    nn = exact_knn(qv, rv.select(entity, "vec"), entity, "vec", k, exclude_self)
    labels = rv.select(F.col(entity).alias("neighbor_id"), F.col(label).cast("int").alias("neighbor_tier")).dropDuplicates(["neighbor_id"])
    return (nn.join(labels, "neighbor_id")
              .select(F.col("query_id").alias(entity), "rank", F.col("neighbor_id").alias("neighbor"), "distance",
                      similarity(F.col("distance")).alias("similarity"), "neighbor_tier",
                      tier_label(F.col("neighbor_tier")).alias("neighbor_label")))


def prediction_records(scored: DataFrame, factors: DataFrame, comps: DataFrame, entity: str, k: int,
                       descr: DataFrame) -> DataFrame:
    """X7 + X8: one nested record per entity - probabilities, confidence, top
    factors, comparables and the interpretation sentence."""
    probs = prob_cols(k)
    scored = first_rows(scored, entity)
    f = factors.join(descr, [entity, "feature"])
    fa = f.groupBy(entity).agg(
        F.sort_array(F.collect_list(F.when(F.col("sign") == "positive", F.struct("rank", "description", "contribution")))).alias("pos"),
        F.sort_array(F.collect_list(F.when(F.col("sign") == "negative", F.struct("rank", "description", "contribution")))).alias("neg"))
    ca = comps.groupBy(entity).agg(F.sort_array(F.collect_list(
        F.struct("rank", "neighbor", "similarity", "neighbor_tier", "neighbor_label"))).alias("comps"))
    s = scored.join(fa, entity, "left").join(ca, entity, "left")
    rounded = [round3(F.col(p)) for p in probs]
    pct = F.concat(F.rint(F.greatest(*rounded) * 100).cast("long").cast("string"), F.lit("%"))
    text = X.interpretation(tier_label(F.col("pred")), F.col(entity).cast("string"), pct,
                            F.get("pos", F.lit(0))["description"], F.get("neg", F.lit(0))["description"],
                            F.transform(F.coalesce("comps", F.array()), lambda c: c["neighbor"].cast("string")),
                            F.transform(F.coalesce("comps", F.array()), lambda c: c["neighbor_label"]))
    return s.select(
        entity, F.col("pred").alias("predicted_tier"), tier_label(F.col("pred")).alias("predicted_label"),
        # keys as in the original record: "<LABEL> (<code>)"
        F.create_map(*[x for i, r in enumerate(rounded)
                       for x in (F.lit(f"{TIER_LABELS.get(i, str(i))} ({i})"), r)]).alias("probabilities"),
        confidence_band(*[F.col(p) for p in probs]).alias("confidence"),
        F.transform(F.coalesce("pos", F.array()), lambda x: F.struct(x["description"], x["contribution"])).alias("top_positive"),
        F.transform(F.coalesce("neg", F.array()), lambda x: F.struct(x["description"], x["contribution"])).alias("top_negative"),
        F.coalesce("comps", F.array()).alias("comparables"), text.alias("interpretation"))


GM_ADVICE = FX.GM_ADVICE  # the original binary response's constant advice


def longevity_response(scored_p: DataFrame, entity: str, prob: str, signal_cols: dict,
                       comps: DataFrame | None = None) -> DataFrame:
    """Decision, probability (2 dp), risk, signals, advice and comparables
    as one JSON document per request."""
    sig = F.create_map(*[x for s, c in signal_cols.items() for x in (F.lit(s), signal_direction(F.col(c)))])
    base = scored_p
    if comps is not None:
        ca = comps.groupBy(entity).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbor"))).alias("_c"))
        base = base.join(ca, entity, "left")
        names = F.transform(F.coalesce("_c", F.array()), lambda c: c["neighbor"].cast("string"))
    else:
        names = F.array().cast("array<string>")
    doc = F.struct((F.col(prob) >= 0.5).alias("Prediction"),
                   exact_round(F.col(prob), 2).alias("Probability"),
                   risk_band(F.col(prob)).alias("Risk_Level"), sig.alias("Key_Adaptability_Signals"),
                   F.lit(GM_ADVICE).alias("GM_Advice"), names.alias("Comparables"))
    return base.select(entity, F.to_json(doc).alias("response"))


def training_run(table: DataFrame, features: list[str], label: str, entity: str, k: int,
                 cfg: ForestConfig, n_iter: int = FX.SEARCH_DRAWS, folds: int = FX.FOLDS, seed: int = FX.SEED,
                 save: bool = True, grid: dict | None = None, parallelism: int = 4) -> dict:
    """Split -> baseline CV -> random search -> evaluate on the test
    split -> importances -> store.  Returns the pieces, including a one-row
    summary DataFrame.  Folds are prepared once, for the baseline and the search."""
    spark = table.sparkSession
    split = stratified_split(table, label, entity, FX.TEST_FRACTION, seed).persist()
    train = stratified_folds(split.filter(F.col("split") == "train"), label, entity, folds, seed).persist()
    test = split.filter(F.col("split") == "test")
    ready = prepared_folds(train, features, label, "fold", cfg, folds)
    base_cv = cv_scores(train, features, label, "fold", cfg, folds, parallelism, ready).collect()  # k + 2 rows
    search, best_cfg, model = random_search(train, features, label, "fold", cfg, n_iter, seed, folds, parallelism, grid, ready)
    scored = score(model, test, entity, k, keep=(label,))  # the search's best, refitted on all training rows
    per = E.per_class_metrics(scored, label, "pred", k).collect()  # k rows
    f1s = E.f1_averages(scored, label, "pred", k).first()
    acc = E.accuracy(scored, label, "pred").first()[0]
    imp = importances(model, features)
    n_train, n_test = train.count(), test.count()
    cv = {r["fold"]: r["f1_weighted"] for r in base_cv}
    best_row = search.filter("best").first()
    summary = {
        "n_train": n_train, "n_test": n_test,
        "cv_scores": [cv[i] for i in range(folds)], "cv_mean": cv[-1], "cv_std": cv[-2],
        "best_params": {kk: v for kk, v in config_dict(best_cfg).items() if kk in ("n_trees", "max_depth", "min_leaf", "max_features")},
        "best_score": best_row["mean_f1"], "accuracy": acc, "f1_weighted": f1s["f1_weighted"],
        "f1_macro": f1s["f1_macro"],
        "per_class": {str(r["class"]): {"precision": r["precision"], "recall": r["recall"], "f1": r["f1"]} for r in per},
    }
    path = None
    if save:
        path = model_path(spark, "forest")
        save_model(model, path, features, summary)
    best = {name: None if v is None else str(v) for name, v in summary["best_params"].items()}
    row = spark.createDataFrame([(n_train, n_test, summary["cv_mean"], summary["cv_std"], summary["best_score"],
                                  best, acc, f1s["f1_weighted"], f1s["f1_macro"])],
                                "n_train long, n_test long, cv_mean double, cv_std double, best_score double, "
                                "best_params map<string,string>, accuracy double, f1_weighted double, f1_macro double")
    split.unpersist()
    train.unpersist()
    return {"summary": row, "model": model, "scored_test": scored, "importances": imp, "search": search,
            "cv": base_cv, "path": path, "facts": summary}


def evaluation_run(model: PipelineModel, table: DataFrame, label: str, entity: str, k: int,
                   seed: int = 42) -> dict:
    """Score the test split with a stored model and produce every table."""
    test = stratified_split(table, label, entity, 0.2, seed).filter(F.col("split") == "test")
    s = score(model, test, entity, k, keep=(label,))
    probs = prob_cols(k)
    return {
        "accuracy": E.accuracy(s, label, "pred"),
        "per_class": E.per_class_metrics(s, label, "pred", k),
        "f1": E.f1_averages(s, label, "pred", k),
        "confusion": E.confusion(s, label, "pred", k),
        "report": E.classification_report(s, label, "pred", k),
        "roc": E.roc_points(s, label, probs),
        "auc": E.auc_ovr(s, label, probs),
        "correct": E.correct_examples(s, label, "pred", entity),
        "misclassified": E.misclassified(s, label, "pred", entity),
    }
