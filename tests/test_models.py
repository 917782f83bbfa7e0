"""Forests at full size: properties that a wrong result breaks; folds, search and the model store."""

import os

import pytest
from pyspark.sql import functions as F

import agewise.plans.training as TR
from agewise import fixed as FX
from agewise.operators import prep
from agewise.plans import catalog
from agewise.plans import closed_form as CF
from agewise.plans.catalog import BN_FEATURES, T3_FEATURES
from agewise.spec import TIER_LABELS


def probabilities(rows, k, pred="pred"):
    for r in rows:
        p = [r[f"p{i}"] for i in range(k)]
        assert abs(sum(p) - 1) < 1e-9 and min(p) >= 0 and p[r[pred]] == max(p)
    assert len({tuple(round(r[f"p{i}"], 12) for i in range(k)) for r in rows}) > len(rows) // 4  # not one leaf for all


def check_forest_train(rows, sizes):
    probabilities(rows, 3)
    assert len(rows) == sizes["test"]


def check_score(rows, sizes):
    probabilities(rows, 3)
    assert len(rows) == sizes["cohort"] and sum(r.pred == r.adaptability_tier for r in rows) > 0.6 * len(rows)


def check_forest_train_binary(rows, sizes):
    by = {r["row"]: r for r in rows}
    assert set(by) == {"0", "1", "accuracy", "macro avg", "weighted avg"} and 0 <= by["accuracy"].f1 <= 1
    assert by["0"].support + by["1"].support == by["accuracy"].support == sizes["binary_test"]


def check_cv_scores(rows, sizes):
    by = {r.fold: r.f1_weighted for r in rows}
    own = [by[i] for i in range(FX.FOLDS)]
    assert set(by) == {*range(FX.FOLDS), -1, -2} and all(0 <= x <= 1 for x in own)
    assert abs(by[-1] - sum(own) / len(own)) < 1e-12
    assert abs(by[-2] - (sum((x - by[-1]) ** 2 for x in own) / len(own)) ** 0.5) < 1e-12


def check_random_search(rows, sizes):
    assert len(rows) == FX.SEARCH_DRAWS == len({(r.n_trees, r.max_depth, r.min_leaf, r.max_features) for r in rows})
    for r in rows:
        assert r.n_trees in FX.TUNING_GRID["n_trees"] and r.max_depth in FX.TUNING_GRID["max_depth"]
        assert r.min_leaf in FX.TUNING_GRID["min_leaf"] and r.max_features in FX.TUNING_GRID["max_features"]
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].mean_f1 == max(r.mean_f1 for r in rows) and len({r.mean_f1 for r in rows}) > 1


def check_importances(rows, sizes):
    assert {r.feature for r in rows} == set(T3_FEATURES) and abs(sum(r.importance for r in rows) - 1) < 1e-9
    assert min(r.importance for r in rows) >= 0 and sum(r.importance > 0 for r in rows) > 20
    last = max(rows, key=lambda r: r["rank"])
    assert abs(last.cumulative_pct - 100) < 1e-6


def check_training_run(rows, sizes):
    r = rows[0]
    assert len(rows) == 1 and r.n_test == sizes["test"] and r.n_train + r.n_test == sizes["cohort"]
    assert r.best_score > 0.5 and int(r.best_params["n_trees"]) in FX.TUNING_GRID["n_trees"] and set(r.best_params) == set(FX.TUNING_GRID)


def check_run_summary(rows, sizes):
    facts = {r.fact: r.value for r in rows}
    assert facts["n_test"] == sizes["test"] and all(f"cv_fold_{i}" in facts for i in range(FX.FOLDS)) and 0 < facts["accuracy"] <= 1
    assert all(f"class_{c}_{m}" in facts for c in range(3) for m in ("precision", "recall", "f1"))


def check_evaluation_run(rows, sizes):
    by = {r["row"]: r for r in rows}
    assert sum(by[str(c)].support for c in range(3)) == by["accuracy"].support == sizes["test"]


def check_ranking_table(rows, sizes):
    assert len(rows) == len({r.name for r in rows}) == sizes["entities"]
    assert [r.prob_2 for r in rows] == sorted((r.prob_2 for r in rows), reverse=True)
    assert all(r.correct == (r.predicted_tier == r.actual_tier) and r.predicted_label == TIER_LABELS[r.predicted_tier] for r in rows)


def check_hit_rate(rows, sizes):
    assert len(rows) == 1 and rows[0].n == sizes["entities"] and 0.6 < rows[0].hit_rate <= 1


def check_prediction_record(rows, sizes):
    assert len(rows) == len({r.name for r in rows}) == sizes["entities"]
    for r in rows:
        assert abs(sum(r.probabilities.values()) - 1) < 0.002 and r.name in r.interpretation
        assert len(r.comparables) == FX.COMPARABLES and len({c.neighbor for c in r.comparables}) == FX.COMPARABLES
        assert len(r.top_positive) <= FX.TOP_FACTORS and all(c.contribution > 0 for c in r.top_positive)
        assert all(c.contribution < 0 for c in r.top_negative)
        assert [c.contribution for c in r.top_positive] == sorted((c.contribution for c in r.top_positive), reverse=True)


def check_interpretation(rows, sizes):
    assert len(rows) == sizes["entities"] and all("Similar to players like" in r.interpretation for r in rows)


def check_score_binary(rows, sizes):
    assert len(rows) == sizes["binary"] and all(r.prediction == (r.probability >= 0.5) and 0 <= r.probability <= 1 for r in rows)
    assert len({r.probability for r in rows}) > len(rows) // 2


def check_longevity_response(rows, sizes):
    import json
    assert len(rows) == sizes["requests"]
    for r in rows:
        doc = json.loads(r.response)
        assert doc["Prediction"] == (doc["Probability"] >= 0.5) or doc["Probability"] == 0.5
        assert len(doc["Comparables"]) == 2 and doc["Risk_Level"] in {"Low", "Medium", "High"} and len(doc["Key_Adaptability_Signals"]) == 3


ROWS_ONLY = sorted(set(catalog.QUERIES) - set(catalog.ORACLE))


@pytest.fixture(scope="module")
def sizes(spark, small_dir):
    count = lambda key, where="true": catalog.QUERIES[key](spark, small_dir).where(where).count()
    from agewise.plans.catalog_ml import _bn_split
    from agewise.sources import fixtures as fx
    t = catalog.train_t3(spark, small_dir)
    return {"cohort": t.count(), "entities": t.select("name").distinct().count(), "test": count("stratified_split", "split = 'test'"),
            "binary": catalog.train_bn(spark, small_dir).count(), "binary_test": _bn_split(spark, small_dir).where("split = 'test'").count(),
            "requests": fx.requests(spark, small_dir).count()}


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_full_size_query(spark, small_dir, sizes, key):
    """Every query without a SQL twin has a property check here; a new one without fails."""
    globals()[f"check_{key}"](catalog.QUERIES[key](spark, small_dir).collect(), sizes)


def test_registered_forests_have_the_original_sizes(spark, small_dir):
    from agewise.plans import catalog_ml as ML
    forest, (binary, _) = ML._fit(spark, small_dir), ML._binary_model(spark, small_dir)
    assert forest.stages[-1].getNumTrees == 500 and binary.stages[-1].getNumTrees == 400
    assert forest.stages[-1].getOrDefault("maxDepth") == 12 and binary.stages[-1].getOrDefault("maxDepth") == 30
    assert binary.stages[0].getInputCols() == BN_FEATURES


def test_preprocessing_does_not_depend_on_the_draws(spark, small_dir, monkeypatch):
    from agewise.plans.catalog_stump import FEATURES, LABEL, _folds
    folds = _folds(spark, small_dir)
    fits = []
    plain = prep.MedianImputer._fit
    monkeypatch.setattr(prep.MedianImputer, "_fit", lambda self, df: (fits.append(1), plain(self, df))[1])
    for draws in (1, 4):
        fits.clear()
        TR.random_search(folds, FEATURES, LABEL, "fold", CF.STUMP, draws, grid=CF.STUMP_GRID)
        assert len(fits) == FX.FOLDS + 1, draws


def test_half_written_versions_are_not_read(spark, small_dir):
    from agewise.plans.catalog_stump import FEATURES, _model
    model, path = _model(spark, small_dir), TR.model_path(spark, "test")
    with pytest.raises(FileNotFoundError):
        TR.load_model(path)
    first = TR.save_model(model, path, FEATURES, {"n": 1})
    later = "29990101T000000000000-half"
    model.write().save(os.path.join(path, "versions", later))  # its manifest was never written
    assert TR.model_versions(path) == [first] and TR.load_model(path)[1]["n"] == 1
    spark.createDataFrame([("{}",)], "m string").write.text(os.path.join(path, "manifests", later))
    fs, success = TR._hadoop(spark, os.path.join(path, "manifests", later, "_SUCCESS"))
    fs.delete(success, True)  # or was broken off
    assert TR.model_versions(path) == [first]
    names = [TR.save_model(model, path, FEATURES, {"n": n}) for n in (2, 3)]
    assert TR.model_versions(path) == names and TR.load_model(path)[1]["n"] == 3  # the two newest stay
    assert TR.load_model(path, names[0])[1]["feature_columns"] == FEATURES and first not in TR._children(spark, os.path.join(path, "versions"))
    with pytest.raises(FileNotFoundError):
        TR.load_model(path, first)


def test_forest_learns_a_planted_signal(spark):
    rows = [(f"e{i}", float(i % 7), float((i * 37) % 11), int((i * 37) % 11 > 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, a double, b double, label int")
    model = TR.forest_pipeline(["a", "b"], "label", TR.ForestConfig(n_trees=20)).fit(df)
    assert TR.evaluator("label").evaluate(model.transform(df)) > 0.95
    top = TR.importances(model, ["a", "b"]).orderBy(F.desc("importance")).first()
    assert top.feature == "b"
