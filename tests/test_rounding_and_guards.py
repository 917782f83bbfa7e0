"""Rounding of printed numbers, panels without segments, the ROC start point, checkpoint folders."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from agewise import session
from agewise.functions.columns import clean_name, exact_round, nearest_even
from agewise.operators.clean import dedupe_total_else_first, dedupe_total_else_max
from agewise.operators.knn import similarity
from agewise.plans.evaluation import roc_points
from agewise.spec import FIXTURE_TIER3


def test_halves_go_to_even(spark):
    df = spark.createDataFrame([(0.0625, 0.125, 0.015, 7.0)], "a double, b double, c double, d double")
    r = df.select(nearest_even(F.col("a"), 3), nearest_even(F.col("b"), 2), exact_round(F.col("c"), 2), similarity(F.col("d"))).first()
    assert tuple(r) == (0.062, 0.12, 0.01, 0.12)


def test_rounding_of_all_vote_shares(spark):
    """k / 400 as a forest of 400 pure trees gives, and values next to ties."""
    values = [k / 400 for k in range(401)] + [np.nextafter(0.125, 0), np.nextafter(0.125, 1), 0.285, 0.295, 1.005, 0.5, 1e-9]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", nearest_even(F.col("v"), 3).alias("n"), exact_round(F.col("v"), 2).alias("e")).collect():
        assert r.n == float(np.rint(r.v * 1000) / 1000) and r.e == round(r.v, 2)


def test_names_lose_non_breaking_spaces(spark):
    df = spark.createDataFrame([(" Ann Lee* \t",)], "name string")
    assert df.select(clean_name(F.col("name"))).first()[0] == "Ann Lee"


@pytest.mark.parametrize("dedupe", [dedupe_total_else_max, dedupe_total_else_first])
def test_panel_without_segments_is_left_alone(spark, dedupe):
    spec = dataclasses.replace(FIXTURE_TIER3.spec, segment="absent") if hasattr(FIXTURE_TIER3, "spec") else None
    if spec is None:
        spec = next(v for v in vars(FIXTURE_TIER3).values() if hasattr(v, "segment"))
        spec = dataclasses.replace(spec, segment="absent")
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, 3.0)], f"{spec.entity} string, {spec.period} int, {spec.weight} double")
    assert dedupe(df, spec).collect() == df.collect()


def test_roc_starts_at_the_origin(spark):
    df = spark.createDataFrame([(0, 0.9, 0.1), (1, 0.2, 0.8), (1, 0.4, 0.6), (0, 0.6, 0.4)], "label int, p0 double, p1 double")
    rows = roc_points(df, "label", ["p0", "p1"]).collect()
    for c in (0, 1):
        points = sorted((-r.threshold, r.fpr, r.tpr) for r in rows if r["class"] == c)
        assert points[0] == (float("-inf"), 0.0, 0.0) and points[-1][1:] == (1.0, 1.0)


def test_checkpoint_folder_must_be_named_off_local_masters():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {"spark.checkpoint.dir": None}

    class Session:
        sparkContext = Context()
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())
