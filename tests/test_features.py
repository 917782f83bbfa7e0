"""Feature row, labels and their edge cases on hand-made panels."""

from pyspark.sql import functions as F

from agewise.operators import features as FE
from agewise.operators.labels import outcome_tier
from agewise.spec import FIXTURE_TIER3, FIXTURE_BINARY, TierRule

COLS = "name string, period int, age int, pos string, seg string, mp double, usg double, ast double, " \
       "par double, ts double, per double, bpm double, ws48 double, g bigint"


def panel(spark, rows):
    full = [(n, p, a, pos, "TOT", mp, usg, 1.0, 0.1, 0.9, 10.0, bpm, 0.05, 1) for n, p, a, pos, mp, usg, bpm in rows]
    return spark.createDataFrame(full, COLS)


def test_latest_vs_earliest_at_one_age(spark):
    df = panel(spark, [("a", 1, 30, "C", 100.0, 1.0, 0.0), ("a", 2, 30, "C", 200.0, 2.0, 0.0)])
    latest = df.groupBy("name").agg(FE.season_at_age(FIXTURE_TIER3, 30, "latest").alias("r")).first().r
    earliest = df.groupBy("name").agg(FE.season_at_age(FIXTURE_TIER3, 30, "earliest").alias("r")).first().r
    assert (latest.period, earliest.period) == (2, 1)


def test_position_rules_first_hit(spark):
    from agewise.functions.columns import position_code
    from agewise.spec import REFERENCE_POSITION_RULES
    df = spark.createDataFrame([("PF-C",), ("SG-PG",), ("",), (None,), ("SF",)], "p string")
    got = [r[0] for r in df.select(position_code(F.col("p"), REFERENCE_POSITION_RULES, 3)).collect()]
    assert got == [5, 2, 3, None, 3]


def test_feature_row_and_trend_identities(spark, small_dir):
    from agewise.plans.catalog import train_t3
    t = train_t3(spark, small_dir)
    names = FE.feature_names(FIXTURE_TIER3)
    assert len(names) == 42 and t.columns == names + ["name", "adaptability_tier"]
    bad = t.filter(~F.col("total_par_change").eqNullSafe(F.col("delta_par_33"))
                   | ~F.col("adaptation_velocity_usg").eqNullSafe(F.col("delta_usg_33") / 3)).count()
    assert bad == 0


def test_missing_stat_column_gives_null_features(spark):
    from agewise.operators.clean import clean_panel
    df = panel(spark, [("a", 0, 30, "AUTO", 100.0, 1.0, 0.0), ("a", 1, 31, "AUTO", 100.0, 2.0, 0.0)]).drop("per")
    out = FE.training_dataset(clean_panel(df, FIXTURE_TIER3), FIXTURE_TIER3).first()
    assert out.age30_per is None and out.delta_usg_31 == 1.0 and out.position_code == 5


def test_tier_thresholds_both_sides(spark):
    r = TierRule(rate_stat="x", impact_stat="y")
    cases = [  # n, rate, impact, weight -> tier
        (1, 0.5, 9.0, 5000.0, 0), (2, 0.05, None, 600.0, 1), (2, 0.0499, -0.01, 600.0, 0),
        (2, None, 0.0, 599.9, 0), (3, 0.1, None, 1200.0, 2), (3, 0.0999, 1.5, 1200.0, 2),
        (3, 0.0999, 1.49, 1200.0, 1), (3, 0.2, 2.0, None, 0)]
    df = spark.createDataFrame([c[:4] for c in cases], "n int, r double, i double, w double")
    got = [x[0] for x in df.select(outcome_tier(F.col("n"), F.col("r"), F.col("i"), F.col("w"), r)).collect()]
    assert got == [c[4] for c in cases]


def test_duplicate_eligible_pairs_repeat_rows(spark):
    from agewise.operators.clean import clean_panel
    rows = [("a", 0, 30, "AUTO", 100.0, 1.0, 0.0), ("a", 1, 30, "AUTO", 120.0, 1.5, 0.0),
            ("b", 0, 29, "AUTO", 100.0, 1.0, 0.0), ("b", 1, 30, "AUTO", 100.0, 1.0, 0.0)]
    clean = clean_panel(panel(spark, rows), FIXTURE_TIER3)
    t = FE.training_dataset(clean, FIXTURE_TIER3)
    assert sorted(r.name for r in t.collect()) == ["a", "a", "b"]
    assert t.filter("name = 'a'").select("age30_mp").distinct().first()[0] == 120.0  # latest season
    bn = FE.training_dataset(clean_panel(panel(spark, rows), FIXTURE_BINARY.with_(baseline_age=30)),
                             FIXTURE_BINARY.with_(baseline_age=30))
    assert sorted(r.name for r in bn.collect()) == ["a", "b"]


def test_trajectory_wide_takes_latest_season_at_an_age(spark):
    from agewise.plans.describe import trajectory_wide
    df = panel(spark, [("a", 1, 30, "C", 100.0, 1.0, 0.0), ("a", 2, 30, "C", 200.0, 2.0, 0.0),
                       ("a", 3, 31, "C", 300.0, 3.0, 0.0)])
    r = {x.stat: x for x in trajectory_wide(df, FIXTURE_TIER3.panel, (30, 31, 32), ["usg"]).collect()}
    assert (r["usg"].age_30, r["usg"].age_31, r["usg"].age_32) == (2.0, 3.0, None)


def test_preset_validation():
    import pytest
    with pytest.raises(ValueError):
        FIXTURE_TIER3.with_(tier_rule=None)
    with pytest.raises(ValueError):
        FIXTURE_TIER3.with_(pick="middle")


def test_panel_summary_approximate_distinct(spark, small_dir):
    from agewise.plans.catalog import clean_t3
    from agewise.plans.describe import panel_summary
    c = clean_t3(spark, small_dir)
    exact = panel_summary(c, FIXTURE_TIER3.panel).first().unique_entities
    approx = panel_summary(c, FIXTURE_TIER3.panel, approx_distinct=True).first().unique_entities
    assert abs(approx - exact) <= max(2, 0.05 * exact)
