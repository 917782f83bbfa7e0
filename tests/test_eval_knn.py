"""Metrics, running sums and nearest neighbours against brute force."""

import itertools

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from agewise.functions.prefix import running_sums
from agewise.operators.knn import exact_knn
from agewise.plans import evaluation as E


def test_running_sums_equal_a_window(spark):
    """Several groups over many ranges, one of them hot, with a score that most of its rows have, and null keys."""
    rng = np.random.default_rng(1)
    rows = [(["a", "b", None][int(g)], float(s), int(p)) for g, s, p in zip(rng.choice(3, 600, p=[.8, .15, .05]), rng.random(600).round(2), rng.integers(0, 2, 600))]
    rows += [("a", 0.5, 1)] * 300
    df = spark.createDataFrame(rows, "g string, score double, pos int")
    from pyspark.sql import Window
    for down in (True, False):
        order = F.col("score").desc() if down else F.col("score")
        w = Window.partitionBy("g").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        want = sorted(map(tuple, df.withColumn("cum_pos", F.sum("pos").over(w)).collect()), key=str)
        for n in (1, 7, 40):
            got = running_sums(df, ["g"], "score", ["pos"], down, partitions=n)
            assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == ["g", "score", "pos", "cum_pos"]
    empty = running_sums(df.where("1 = 0"), ["g"], "score", ["pos"])
    assert empty.count() == 0


def test_auc_matches_pair_counting(spark):
    rng = np.random.default_rng(9)
    n = 300
    y = rng.integers(0, 3, n)
    p = rng.dirichlet([1, 1, 1], n).round(2)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, p)], "label int, p0 double, p1 double, p2 double")
    got = {r["class"]: r.auc for r in E.auc_ovr(df, "label", ["p0", "p1", "p2"]).collect()}
    for c in range(3):
        pos, neg = p[y == c, c], p[y != c, c]
        ref = np.mean([(a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)])
        assert abs(got[c] - ref) < 1e-12


def test_per_class_metrics_by_hand(spark):
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 1)]
    df = spark.createDataFrame(rows, "label int, pred int")
    m = {r["class"]: r for r in E.per_class_metrics(df, "label", "pred", 3).collect()}
    assert (m[0].precision, m[0].recall) == (2 / 3, 2 / 3)
    assert (m[1].precision, m[1].recall, m[1].f1) == (1 / 3, 1 / 2, 2 / 5)
    assert (m[2].precision, m[2].recall, m[2].f1, m[2].support) == (0.0, 0.0, 0.0, 1)
    conf = {r["class"]: (r.pred_0, r.pred_1, r.pred_2) for r in E.confusion(df, "label", "pred", 3).collect()}
    assert conf == {0: (2, 1, 0), 1: (1, 1, 0), 2: (0, 1, 0)}


def test_exact_knn_blocks_match_brute_force(spark):
    rng = np.random.default_rng(11)
    X = rng.normal(size=(400, 8)).round(1)
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<double>")
    got = exact_knn(df, df.repartition(5), "id", "vec", 4, exclude_self=True, max_block_bytes=8000)
    res = {(r.query_id, r["rank"]): r.neighbor_id for r in got.collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for q in range(400):
        order = sorted((round(D[q, c], 10), c) for c in range(400) if c != q)[:4]
        assert [res[(q, k + 1)] for k in range(4)] == [c for _, c in order]


def test_approx_knn_is_a_subset_with_high_recall(spark):
    from agewise.operators.knn import approx_knn
    rng = np.random.default_rng(2)
    X = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<double>")
    exact = {(r.query_id, r.neighbor_id) for r in exact_knn(df, df, "id", "vec", 3).collect()}
    approx = approx_knn(df, df, "id", "vec", 3, radius=3.0, bucket_length=4.0, tables=6).collect()
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    assert all(abs(r.distance - D[r.query_id, r.neighbor_id]) < 1e-9 for r in approx)
    found = {(r.query_id, r.neighbor_id) for r in approx}
    assert len(found & exact) / len(exact) > 0.8


def test_auc_invariant_to_monotone_maps(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 2, 400)
    s = rng.random(400).round(3)
    df = spark.createDataFrame([(int(a), float(b), float(1 - b)) for a, b in zip(y, s)], "label int, p0 double, p1 double")
    base = {r["class"]: r.auc for r in E.auc_ovr(df, "label", ["p0", "p1"]).collect()}
    mapped = df.select("label", F.exp(F.col("p0") * 3).alias("p0"), (F.col("p1") ** 3).alias("p1"))
    again = {r["class"]: r.auc for r in E.auc_ovr(mapped, "label", ["p0", "p1"]).collect()}
    assert all(abs(base[c] - again[c]) < 1e-12 for c in base)


def test_forest_probabilities_sum_to_one(spark, small_dir):
    from agewise.operators.features import feature_names
    from agewise.plans.catalog import train_t3
    from agewise.plans.scoring import score
    from agewise.plans.training import ForestConfig, forest_pipeline
    from agewise.spec import FIXTURE_TIER3
    t = train_t3(spark, small_dir)
    m = forest_pipeline(feature_names(FIXTURE_TIER3), FIXTURE_TIER3.label_col, ForestConfig(n_trees=8)).fit(t)
    s = score(m, t, "name", 3)
    bad = s.filter(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > 1e-9).count()
    assert bad == 0 and s.count() == t.count()


def test_exact_knn_without_queries_is_empty(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0])], "id long, vec array<double>")
    out = exact_knn(df.filter("id > 5"), df, "id", "vec", 3)
    assert out.count() == 0 and out.columns == ["query_id", "neighbor_id", "distance", "rank"]


def test_metrics_on_degenerate_inputs_do_not_fail(spark):
    empty = spark.createDataFrame([], "label int, pred int, p0 double, p1 double")
    assert E.f1_averages(empty, "label", "pred", 2).first().f1_weighted is None
    one_class = spark.createDataFrame([(1, 1, 0.2, 0.8), (1, 1, 0.4, 0.6)], "label int, pred int, p0 double, p1 double")
    auc = {r["class"]: r.auc for r in E.auc_ovr(one_class, "label", ["p0", "p1"]).collect()}
    assert auc == {1: None}  # no negatives: undefined, not an error
    roc = E.roc_points(one_class, "label", ["p0", "p1"]).collect()
    assert all(r.fpr is None and r.tpr is not None for r in roc)
    from agewise.functions.columns import fixed
    big = spark.createDataFrame([(1e45,), (-2.675,), (0.125,), (-0.001,)], "x double").select(
        fixed(F.col("x"), 2).alias("s")).collect()
    # 2.675 * 100 is 267.5 in floating point: half up gives 2.68 (see fixed())
    assert [r.s for r in big[1:]] == ["-2.68", "0.13", "-0.00"] and big[0].s.startswith("1000000000000000")
    assert len(big[0].s.split(".")[0]) == 46
