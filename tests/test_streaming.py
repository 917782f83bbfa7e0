"""Stateless operators accept streaming DataFrames; a fitted model scores a stream."""

import os
import tempfile

from pyspark.sql import functions as F

from agewise.functions.columns import risk_band
from agewise.operators import clean as C
from agewise.operators.features import request_features
from agewise.sources import fixtures as fx
from agewise.spec import FIXTURE_BINARY, FIXTURE_TIER3
from agewise.streaming.requests import request_signals, request_stream, run_to_table


def test_clean_up_steps_on_a_stream(spark, small_dir):
    base = tempfile.mkdtemp(prefix="agewise-stream-")
    src = os.path.join(base, "in")
    raw = fx.panel(spark, small_dir, "panel_raw")
    raw.write.parquet(src)
    spec = FIXTURE_TIER3.panel
    s = spark.readStream.schema(raw.schema).parquet(src)
    s = C.filter_min_weight(C.filter_period_range(C.coerce_numeric(C.clean_names(s, "name"), spec.numeric),
                                                  spec, 0, 12), spec, 60)
    run_to_table(s, os.path.join(base, "out"), os.path.join(base, "ck"))
    got = spark.read.parquet(os.path.join(base, "out"))
    want = C.filter_min_weight(C.filter_period_range(C.coerce_numeric(C.clean_names(raw, "name"), spec.numeric),
                                                     spec, 0, 12), spec, 60)
    assert got.count() == want.count() > 0
    assert got.filter(F.col("name").contains("*")).count() == 0


def test_model_scores_a_request_stream(spark, small_dir):
    from agewise.plans.catalog import train_bn
    from agewise.plans.training import ForestConfig, forest_pipeline
    from agewise.operators.features import feature_names
    model = forest_pipeline(feature_names(FIXTURE_BINARY), FIXTURE_BINARY.label_col,
                            ForestConfig(n_trees=5, max_depth=5, min_leaf=1, scale=False)).fit(train_bn(spark, small_dir))
    base = tempfile.mkdtemp(prefix="agewise-stream-")
    src = os.path.join(base, "in")
    fx.requests(spark, small_dir).write.json(src)
    feats = request_signals(request_stream(spark, src), FIXTURE_BINARY, ("par", "ast", "usg"))
    scored = model.transform(feats).select("entity", "signal_par", F.col("probability"))
    from pyspark.ml.functions import vector_to_array
    scored = scored.select("entity", "signal_par", vector_to_array("probability")[1].alias("p")).withColumn(
        "risk", risk_band(F.col("p")))
    run_to_table(scored, os.path.join(base, "out"), os.path.join(base, "ck"))
    out = spark.read.parquet(os.path.join(base, "out"))
    assert out.count() == fx.requests(spark, small_dir).count()
    assert out.filter(F.col("risk").isNull() | F.col("p").isNull()).count() == 0
    # the same rows through the batch path give the same probabilities
    batch = model.transform(request_features(fx.requests(spark, small_dir), FIXTURE_BINARY))
    assert batch.count() == out.count()
