"""What keeps queries in bounds on large tables: forests in parts, one cohort a call, files of bounded share."""

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from agewise.plans import catalog, catalog_ml
from agewise.plans import training as TR


def _rows(spark, n=240):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, size=(n, 4)).astype(float)
    y = (x[:, 0] + x[:, 1] > 18).astype(int) + (x[:, 2] > 16)
    return spark.createDataFrame([(*map(float, r), int(c)) for r, c in zip(x, y, strict=True)], "a double, b double, c double, d double, y int").coalesce(2)


CFG = TR.ForestConfig(n_trees=50, max_depth=4, min_leaf=2)


def test_a_forest_in_parts_is_one_forest(spark, monkeypatch, tmp_path):
    df = _rows(spark)
    whole = TR.forest_pipeline(list("abcd"), "y", CFG).fit(df)
    assert len(TR.forest_parts(TR.forest_stage(whole))) == 1  # a small table: one fit
    monkeypatch.setattr(TR, "PART_BYTES", 0)
    model = TR.forest_pipeline(list("abcd"), "y", CFG).fit(df)
    parts = TR.forest_parts(TR.forest_stage(model))
    assert [len(parts), sum(p.getNumTrees for p in parts)] == [TR.PARTS, 50]
    assert len({p.getOrDefault("seed") for p in parts}) == TR.PARTS
    out = model.transform(df)
    assert {"rawPrediction", "probability", "prediction"} <= set(out.columns) and not [c for c in out.columns if c.startswith("_votes")]
    pre = PipelineModel(model.stages[:-1]).transform(df).select("_features").collect()
    raw = np.array([sum(p.predictRaw(r[0]).toArray() for p in parts) for r in pre])
    got = out.select(vector_to_array("probability"), "prediction").collect()
    assert np.allclose([r[0] for r in got], raw / 50) and [int(r[1]) for r in got] == raw.argmax(axis=1).tolist()
    imp = {r.feature: r.importance for r in TR.importances(model, list("abcd")).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and imp["d"] < min(imp["a"], imp["b"], imp["c"])
    right = out.filter("prediction = y").count()
    assert abs(right - whole.transform(df).filter("prediction = y").count()) < 24
    TR.save_model(model, str(tmp_path / "m"), list("abcd"), {})
    again = TR.load_model(str(tmp_path / "m"))[0].transform(df).select(vector_to_array("probability"), "prediction").collect()
    assert again == got


def test_cross_validation_fits_in_parts(spark, monkeypatch):
    df = _rows(spark).withColumn("fold", (F.monotonically_increasing_id() % 2).cast("int"))
    one = [r.f1_weighted for r in TR.cv_scores(df, list("abcd"), "y", "fold", CFG, 2).collect()]
    monkeypatch.setattr(TR, "PART_BYTES", 0)
    parts = [r.f1_weighted for r in TR.cv_scores(df, list("abcd"), "y", "fold", CFG, 2).collect()]
    assert len(parts) == 4 and abs(parts[2] - one[2]) < 0.1


def test_a_call_makes_the_cohort_once(spark, monkeypatch):
    made = []
    for module in (catalog, catalog_ml):
        if hasattr(module, "train_t3"):
            monkeypatch.setattr(module, "train_t3", lambda s, d, f=catalog.train_t3: made.append(d) or f(s, d))
    q = catalog.QUERIES["top_factors"]
    q(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
    q(spark, "/root/testdata/sf0.001")  # nothing is kept between calls
    assert len(made) == 2


def test_ranges_of_a_hash_have_bounded_shares(spark):
    h = spark.range(40_000).select(F.md5(F.col("id").cast("string")).alias("h"))
    rows = h.withColumn("part", catalog_ml.hash_range(F.col("h"), 50)).groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi")).orderBy("part").collect()
    assert [r.part for r in rows] == list(range(50))
    assert all(a.hi < b.lo for a, b in zip(rows, rows[1:]))
    assert max(r.n for r in rows) < 2.4 * 40_000 / 50 and max(r.n for r in rows) > 2 * min(r.n for r in rows)
