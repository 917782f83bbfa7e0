"""Physical-plan properties that matter at scale, and the one-call study."""

from agewise.operators.clean import clean_panel
from agewise.operators.features import training_dataset
from agewise.sources import fixtures as fx
from agewise.spec import FIXTURE_TIER3


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_feature_chain_combines_before_every_shuffle(spark, small_dir):
    t = training_dataset(clean_panel(fx.panel(spark, small_dir, "panel_raw"), FIXTURE_TIER3), FIXTURE_TIER3)
    plan = _plan(t)
    # every exchange on the way to the feature row is fed by a partial aggregate
    assert plan.count("Exchange hashpartitioning") >= 2
    assert "partial_min_by" in plan and "partial_max_by" in plan
    assert "Window" not in plan  # no window over a whole entity or (entity, period)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan  # no Python UDF


def test_window_dedupe_same_rows_and_group_limit(spark, small_dir):
    def build():
        return training_dataset(clean_panel(fx.panel(spark, small_dir, "panel_raw"), FIXTURE_TIER3), FIXTURE_TIER3)
    key = ["name", "age30_mp", "delta_mp_31", "adaptability_tier"]
    a = sorted(map(tuple, build().select(*key).collect()), key=str)
    spark.conf.set("agewise.dedupe", "window")
    try:
        t = build()
        plan = _plan(t)
        assert "WindowGroupLimit" in plan and ", Partial" in plan
        b = sorted(map(tuple, t.select(*key).collect()), key=str)
    finally:
        spark.conf.unset("agewise.dedupe")
    assert a == b


def test_scan_prunes_columns(spark, small_dir):
    t = training_dataset(clean_panel(fx.panel(spark, small_dir, "panel_raw"), FIXTURE_TIER3), FIXTURE_TIER3)
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "l_shipdate" not in plan and "c_acctbal" not in plan


def test_run_study_small(spark, small_dir):
    from agewise.plans.study import run_study
    from agewise.plans.training import ForestConfig
    out = run_study(fx.panel(spark, small_dir, "panel_raw"), FIXTURE_TIER3, ForestConfig(n_trees=10), n_iter=1,
                    folds=3)
    s = out["summary"].first()
    assert s.n_train > s.n_test > 0 and 0 <= s.accuracy <= 1
    assert out["ranking"].count() == out["table"].count()
    assert out["importances"].count() == 42
    assert abs(sum(r.importance for r in out["importances"].collect()) - 1.0) < 1e-9
    assert out["comparables"].groupBy("name").count().filter("count != 5").count() == 0
    few = out["table"].select("name").limit(3)  # a sample of entities to explain, the candidates stay whole
    out2 = run_study(fx.panel(spark, small_dir, "panel_raw"), FIXTURE_TIER3, ForestConfig(n_trees=5), n_iter=1,
                     folds=3, explain=few)
    assert out2["comparables"].select("name").distinct().count() == 3


def test_run_study_binary(spark, small_dir):
    from agewise.plans.study import run_study
    from agewise.plans.training import ForestConfig
    from agewise.spec import FIXTURE_BINARY
    raw = fx.panel(spark, small_dir, "panel_raw")
    few = training_dataset(clean_panel(raw, FIXTURE_BINARY), FIXTURE_BINARY).select("name").limit(3)
    out = run_study(raw, FIXTURE_BINARY, ForestConfig(n_trees=10, scale=False), explain=few)
    n, n_test = out["table"].count(), out["scored_test"].count()
    assert 0 < n_test < n and 0 <= out["test_accuracy"].first()[0] <= 1
    scores = out["scores"].collect()
    assert len(scores) == n and all(r.prediction == (r.probability >= 0.5) and 0 <= r.probability <= 1 for r in scores)
    assert [r.row for r in out["test_report"].collect()] == ["0", "1", "accuracy", "macro avg", "weighted avg"]
    assert abs(sum(r.importance for r in out["importances"].collect()) - 1.0) < 1e-9
    comps = out["comparables"].collect()
    assert len(comps) == 15 and {r.neighbor_outcome for r in comps} <= {0, 1}


def test_scale_settings_size_partitions():
    from agewise.session import scale_settings
    small = scale_settings(10 << 20)
    assert small["spark.sql.shuffle.partitions"] == "200"  # floor
    big = scale_settings(100 << 40)
    assert big["spark.sql.shuffle.partitions"] == "200000"  # cap
    mid = scale_settings(1 << 40)
    assert int(mid["spark.sql.shuffle.partitions"]) == (1 << 40) // (128 << 20)
    assert mid["spark.sql.files.maxPartitionBytes"] == str(128 << 20)
