"""Forests whose trees are a table: the same trees as Spark's where chance plays no part, whole or in parts."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from agewise.plans import grown_forest as GF
from agewise.plans import scoring as SC
from agewise.plans import training as TR

FEATURES = list("abcd")


def _rows(spark, n=1500):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 20, size=(n, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 4, n) > 18).astype(int) + (x[:, 2] > 15)
    rows = [(f"e{i}", *(None if (i + j) % 41 == 0 else float(v) for j, v in enumerate(r)), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "name string, a double, b double, c double, d double, y int").coalesce(3)


def _shares(model, df):
    return {r.name: (r.p, r.prediction) for r in model.transform(df).select("name", vector_to_array("probability").alias("p"), "prediction").collect()}


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(TR, "PART_BYTES", 0)
    monkeypatch.setattr(TR, "GROWN_BYTES", 0)
    monkeypatch.setattr(TR, "PARTS", 1)
    monkeypatch.setattr(GF, "BLOCK_ROWS", 200)
    monkeypatch.setattr(GF, "SCORE_ROWS", 400)


@pytest.mark.parametrize("rows_a_part", [(1 << 17, 60), (40,)])
def test_one_tree_without_chance_is_sparks_tree(spark, small_parts, monkeypatch, rows_a_part):
    df = _rows(spark)
    cfg = TR.ForestConfig(n_trees=1, max_depth=5, min_leaf=15, max_features="all", bootstrap=False) if len(rows_a_part) == 2 else \
        TR.ForestConfig(n_trees=1, max_depth=7, min_leaf=8, max_features="all", bootstrap=False, balanced=False, scale=False)
    with monkeypatch.context() as m:
        m.setattr(TR, "PART_BYTES", 1 << 40)
        plain = TR.forest_pipeline(FEATURES, "y", cfg).fit(df)
    for part_rows in rows_a_part:
        monkeypatch.setattr(GF, "PART_ROWS", part_rows)
        grown = TR.forest_pipeline(FEATURES, "y", cfg).fit(df)
        assert isinstance(TR.forest_stage(grown), GF.GrownForest)
        want, got = _shares(plain, df), _shares(grown, df)
        assert want.keys() == got.keys() and len(got) == 1500
        assert max(abs(a - b) for n in want for a, b in zip(want[n][0], got[n][0], strict=True)) < 1e-9
        assert all(want[n][1] == got[n][1] for n in want)
        imp = [{r.feature: r.importance for r in TR.importances(m, FEATURES).collect()} for m in (plain, grown)]
        assert all(abs(imp[0][f] - imp[1][f]) < 1e-9 for f in FEATURES)


@pytest.mark.parametrize("part_rows", [1 << 17, 300])
def test_a_grown_forest_learns_and_is_stored(spark, small_parts, monkeypatch, tmp_path, part_rows):
    df = _rows(spark)
    cfg = TR.ForestConfig(n_trees=60, max_depth=None, min_leaf=1)
    monkeypatch.setattr(GF, "PART_ROWS", part_rows)
    grown = TR.forest_pipeline(FEATURES, "y", cfg).fit(df)
    trees = TR.forest_stage(grown).trees
    assert trees.select("tree").distinct().count() == 60 == TR.forest_stage(grown).getNumTrees
    assert trees.count() == 60 if part_rows > 1500 else trees.count() > 120
    monkeypatch.setattr(TR, "PART_BYTES", 1 << 40)
    plain = TR.forest_pipeline(FEATURES, "y", cfg).fit(df)
    a, b = ({r.name: (r.p0, r.p1, r.p2) for r in SC.score(m, df, "name", 3).collect()} for m in (plain, grown))
    assert len(b) == 1500 and max(abs(sum(p) - 1) for p in b.values()) < 1e-9
    assert np.mean([abs(x - y) for n in a for x, y in zip(a[n], b[n], strict=True)]) < 0.03
    assert abs(np.mean([np.argmax(a[r.name]) == r.y for r in df.collect()]) - np.mean([np.argmax(b[r.name]) == r.y for r in df.collect()])) < 0.03
    imp = {r.feature: r.importance for r in TR.importances(grown, FEATURES).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["d"] < min(imp["a"], imp["b"])
    TR.save_model(grown, str(tmp_path / "m"), FEATURES, {})
    again = TR.load_model(str(tmp_path / "m"))[0]
    assert _shares(again, df) == _shares(grown, df)


def test_cross_validation_grows_forests(spark, small_parts, monkeypatch):
    df = _rows(spark).withColumn("fold", (F.monotonically_increasing_id() % 2).cast("int"))
    cfg = TR.ForestConfig(n_trees=30, max_depth=6, min_leaf=5)
    monkeypatch.setattr(TR, "fit_parts", None)  # not these
    grown = [r.f1_weighted for r in TR.cv_scores(df, FEATURES, "y", "fold", cfg, 2).collect()]
    monkeypatch.setattr(TR, "PART_BYTES", 1 << 40)
    monkeypatch.setattr(TR, "GROWN_BYTES", 1 << 40)
    plain = [r.f1_weighted for r in TR.cv_scores(df, FEATURES, "y", "fold", cfg, 2).collect()]
    assert len(grown) == 4 and all(abs(a - b) < 0.05 for a, b in zip(plain[:3], grown[:3], strict=True))


def test_split_points_see_every_row(spark):
    n = 40_000
    df = spark.range(n).select(F.array((F.col("id") == n - 1).cast("double"), F.col("id").cast("double"),
                                       F.when(F.col("id") % 2 == 0, float("nan")).otherwise(F.col("id") % 5)).alias("x")).repartition(5)
    from pyspark.ml.functions import array_to_vector
    few, many, holes = GF.split_points(df.select(array_to_vector("x").alias("_features")), 32)
    assert few == [0.5] and holes == [0.5, 1.5, 2.5, 3.5]
    assert len(many) == 31 and max(abs(p - n * (i + 1) / 32) for i, p in enumerate(many)) < 10


@pytest.mark.parametrize("slices", [(1 << 13, 1 << 11), (64, 100), (64, 20)])
def test_growth_in_slices_is_growth_at_once(monkeypatch, slices):
    """What a task holds is bounded by slices of a level's rows; the tree is the one that the whole level gives."""
    rng = np.random.default_rng(3)
    x, weights = rng.integers(0, 12, size=(900, 9)).astype(np.uint8), np.array([1.0, 0.7, 2.0])
    y, count = ((x[:, 0] + x[:, 1] + rng.integers(0, 9, 900)) // 12).clip(0, 2).astype(np.uint8), rng.poisson(1.0, 900)
    for cfg in (TR.ForestConfig(max_depth=None, min_leaf=1), TR.ForestConfig(max_depth=5, min_leaf=7, max_features="log2")):
        monkeypatch.setattr(GF, "SLICE_ROWS", 1 << 20)
        monkeypatch.setattr(GF, "LARGE_NODE", 1 << 20)
        whole = GF.grow(x, y, count, 0, cfg, 12, weights, np.random.default_rng(1))
        held, plain = [], GF._best_of_rows
        monkeypatch.setattr(GF, "SLICE_ROWS", slices[0])
        monkeypatch.setattr(GF, "LARGE_NODE", slices[1])
        with monkeypatch.context() as m:
            m.setattr(GF, "_best_of_rows", lambda b, *a: (held.append(b.shape[1]), plain(b, *a))[1])
            assert GF.grow(x, y, count, 0, cfg, 12, weights, np.random.default_rng(1)) == whole
        assert max(held) <= max(slices) and len(whole["bin"]) > 20


def test_a_search_scores_what_fits_one_by_one_would(spark, monkeypatch):
    """Trees that draws share are grown once: every draw's score is that of its own forest, fitted and kept whole."""
    monkeypatch.setattr(TR, "GROWN_BYTES", 0)
    monkeypatch.setattr(TR, "PART_BYTES", 0)
    monkeypatch.setattr(GF, "BLOCK_ROWS", 200)
    monkeypatch.setattr(GF, "VOTE_ROWS", 128)
    df = _rows(spark).withColumn("fold", (F.monotonically_increasing_id() % 3).cast("int"))
    base = TR.ForestConfig(n_trees=30)
    configs = [TR.replace(base, n_trees=n, max_depth=d, min_leaf=leaf, max_features=f)
               for n, d, leaf, f in ((30, 4, 5, "sqrt"), (41, None, 5, "sqrt"), (26, 7, 5, "sqrt"), (35, 6, 9, "all"), (35, 40, 9, "all"))]
    folds = TR.prepared_folds(df, FEATURES, "y", "fold", base, 3)
    together = TR._fold_scores(folds, "y", configs, 2)
    monkeypatch.setattr(TR, "cross_votes", None)  # not this
    monkeypatch.setattr(TR, "WHOLE_ROWS", 0)
    alone = TR._fold_scores(folds, "y", configs, 2)
    assert len(together) == 5 and all(abs(a - b) < 1e-12 for x, y in zip(together, alone, strict=True) for a, b in zip(x, y, strict=True))
    assert len({x for scores in together for x in scores}) > 8


def test_weighted_f1_is_sparks(spark):
    rows = [(float(a), float(b)) for a, b, n in ((0, 0, 5), (0, 1, 2), (1, 1, 4), (1, 0, 3), (2, 0, 2), (0, 3, 1)) for _ in range(n)]
    want = TR.evaluator("y").evaluate(spark.createDataFrame(rows, "y double, prediction double"))
    assert abs(TR.weighted_f1({(0, 0): 5, (0, 1): 2, (1, 1): 4, (1, 0): 3, (2, 0): 2, (0, 3): 1}) - want) < 1e-12
