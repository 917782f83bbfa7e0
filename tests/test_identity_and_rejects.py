"""Entities that are eligible twice; requests and rows that can't be used; read order of several files."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from agewise.operators import clean as C
from agewise.operators import explain as X
from agewise.operators.features import request_features
from agewise.plans import scoring as SC
from agewise.plans.catalog import T3_FEATURES, mixed_requests, train_t3
from agewise.sources import readers as R
from agewise.spec import BINARY, FIXTURE_BINARY, FIXTURE_TIER3


@pytest.fixture(scope="module")
def twice(spark, small_dir):
    """The cohort, every fifth customer eligible twice, as two periods at the baseline age make it."""
    t = train_t3(spark, small_dir)
    n = F.when(F.abs(F.hash("name")) % 5 == 0, 2).otherwise(1)
    out = t.withColumn("_rep", F.explode(F.sequence(F.lit(1), n))).drop("_rep").cache()
    assert out.count() > t.count() == out.select("name").distinct().count()
    return out


def scored(table):
    w = F.col("age30_mp")
    total = 1 + w / 150 + w / 200
    p = [F.lit(1.0) / total, w / 150 / total, w / 200 / total]
    return table.select("name", F.col("adaptability_tier").alias("label"), F.when(w > 150, 1).otherwise(0).alias("pred"),
                        *[x.alias(f"p{i}") for i, x in enumerate(p)])


def test_rankings_and_factors_have_one_row_each(spark, twice):
    once = twice.dropDuplicates()
    a, b = (SC.ranking_table(scored(t), "name", "label", 3) for t in (twice, once))
    assert a.collect() == b.collect() and a.count() == once.count()
    assert SC.hit_rate(a).collect() == SC.hit_rate(b).collect()
    ref = X.feature_reference_stats(once, T3_FEATURES)
    imp = X.correlation_importance(once, T3_FEATURES, FIXTURE_TIER3.label_col)
    a, b = (X.top_factors(X.contributions(t, ref, imp, T3_FEATURES, "name"), "name", 5) for t in (twice, once))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.groupBy("name", "sign", "feature").count().filter("count > 1").isEmpty()


def test_records_and_comparables_have_one_row_each(spark, twice):
    from agewise.plans.training import forest_pipeline
    from agewise.plans import closed_form as CF
    t = CF.stepped(twice, CF.TIER3_STEPS).cache()
    names = CF.names(CF.TIER3_STEPS)
    model = forest_pipeline(names, FIXTURE_TIER3.label_col, CF.STUMP).fit(t.dropDuplicates())
    comps = SC.comparables(model, t, t, "name", FIXTURE_TIER3.label_col, 5, exclude_self=True)
    n = t.select("name").distinct().count()
    assert comps.count() == 5 * n and comps.groupBy("name", "neighbor").count().filter("count > 1").isEmpty()
    assert comps.filter("name = neighbor").isEmpty()
    contrib = X.contributions(t, X.feature_reference_stats(t, names), X.correlation_importance(t, names, FIXTURE_TIER3.label_col), names, "name")
    descr = contrib.select("name", "feature", F.col("feature").alias("description"))
    rec = SC.prediction_records(SC.score(model, t, "name", 3), X.top_factors(contrib, "name"), comps, "name", 3, descr).collect()
    assert len(rec) == n and all(len(r.comparables) == 5 for r in rec)


def test_rejected_scores_have_a_reason(spark, twice):
    s = scored(twice).select("name", "label", "pred", "p0", "p1", "p2")
    bad = spark.createDataFrame([(None, 1, 1, .2, .3, .5), ("x", 1, 0, None, .3, .5), ("y", 1, 0, float("nan"), .3, .5)], s.schema)
    both = s.unionByName(bad)
    assert SC.ranking_table(both, "name", "label", 3).collect() == SC.ranking_table(s, "name", "label", 3).collect()
    assert sorted((r.name or "", r.reason) for r in SC.ranking_rejects(both, "name", 3).collect()) == [
        ("", "no entity"), ("x", "no probabilities"), ("y", "no probabilities")]


REQUESTS = {1: None, 2: " ", 3: "{", 4: "[1]", 5: '{"age_28": 3}', 6: '{"age_28": {"mp": "many"}}', 7: '{"age_28": {"mp": "1d"}}', 8: "{}",
            9: '{"age_28": {}}', 10: '{"age_28": {"mp": 5, "par": null}}', 11: '{"age_28": {"mp": "6.5"}}', 12: "null", 13: '{"age_28": null}'}


def test_good_and_rejected_requests_are_all(spark, small_dir):
    df = spark.createDataFrame(list(REQUESTS.items()), "entity long, request string")
    good, rejected = R.split_requests(df)
    assert {r.entity for r in good.collect()} == {10, 11} and good.columns == df.columns
    assert {r.entity: r.reason for r in rejected.collect()} == {
        1: R.NO_REQUEST, 2: R.NO_REQUEST, 3: R.MALFORMED, 4: R.MALFORMED, 5: R.MALFORMED, 6: R.NOT_A_NUMBER, 7: R.NOT_A_NUMBER, 8: R.EMPTY,
        9: R.EMPTY, 12: R.MALFORMED, 13: R.MALFORMED}
    rows = {r.entity: r.mp_age28 for r in request_features(df, FIXTURE_BINARY).collect()}
    assert rows == {10: 5.0, 11: 6.5}
    mixed = mixed_requests(spark, small_dir)
    good, rejected = R.split_requests(mixed)
    assert good.count() + rejected.count() == mixed.count() and rejected.count() > 0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_read_order_of_files_of_unlike_size(spark, fmt):
    base = tempfile.mkdtemp(prefix="agewise-order-")
    n = 0
    for i, size in enumerate((3, 4000, 1, 900)):
        part = spark.range(n, n + size).select(F.col("id").cast("string").alias("n"), F.lit("x" * 40).alias("pad")).coalesce(1)
        part.write.options(header=True).format(fmt).save(os.path.join(base, f"part={i}"))
        n += size
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # blocks within a file, files within a task
    try:
        df = R.load_panel(spark, base, fmt, ordinal="_ordinal")
        assert df.rdd.getNumPartitions() >= 4
        got = df.repartition(7, "pad", "n").orderBy("_ordinal").select(F.col("n").cast("long")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.n for r in got] == list(range(n))


def test_no_read_order_is_invented(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], "Player string, Year int, Tm string")
    assert "_ordinal" in C.ensure_columns(df.filter("Year > 0"), BINARY.panel).columns
    for moved in (df.repartition(2), df.distinct(), df.groupBy("Player").count(), df.orderBy("Tm"), df.join(df.select("Tm"), "Tm")):
        with pytest.raises(ValueError, match="read order"):
            C.with_ordinal(moved)
        assert C.with_ordinal(moved.withColumn("_ordinal", F.lit(1))).columns.count("_ordinal") == 1
