"""Registered queries, part 3: comparables, forests, scoring, sinks and
sources (X1, X6-X11, X14, M5-M9, M11, E11, E12, S1-S8).

Forest-based results depend on Spark's tree induction, so they get the
rows-only check; everything that round-trips through storage or is a
deterministic function of the data has a SQL twin.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import explain as X
from ..operators import features as FE
from ..operators.knn import exact_knn, similarity
from ..operators.prep import MedianImputer, PopulationScaler
from ..operators.split import stratified_folds
from .. import fixed as FXV
from ..session import checkpoint_dir, materialize
from ..sources import fixtures as fx
from ..sources import readers as R
from ..spec import FIXTURE_BINARY as BN
from ..spec import FIXTURE_TIER3 as T3
from . import oracle as O
from . import scoring as SC
from . import training as TR
from .catalog import T3_FEATURES, BN_FEATURES, cohort_bn, cohort_t3, query, train_t3
from .catalog_eval import (IMP_CTE, CONTRIB_CTE, PROBS, _describe, describe_parts, LABEL, _median_sql, contributions, esql, importance, isql, scored,
                           split_t3, train_rows)

K = 3
# The original's forests and search, whole (500 and 400 trees, 30 draws); their twins are in catalog_stump.
PARALLEL_FITS = 8
_KEPT: dict = {}


def once(spark, d, what: str, make):
    """A fitted model or run of the session, made once for all queries that explain or score with it."""
    key = (spark.sparkContext.applicationId, str(d), what)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def scratch(spark, name: str) -> str:
    """A new folder under the shared checkpoint directory."""
    return os.path.join(checkpoint_dir(spark), "tables", f"{name}-{uuid.uuid4().hex[:12]}")


# ------------------------------------------------------------ comparables --
def _emb(spark, d):
    e = fx.read_table(spark, d, "embeddings")
    return e.select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")


def _knn_embeddings(spark, d):
    v = _emb(spark, d)
    nn = exact_knn(v, v, "vec_id", "vec", 5, exclude_self=True)
    lab = v.select(F.col("vec_id").alias("neighbor_id"), F.col("label").alias("neighbor_label"))
    return nn.join(lab, "neighbor_id").select(
        "query_id", "rank", "neighbor_id", F.round("distance", 6).alias("distance"),
        similarity(F.col("distance")).alias("similarity"), "neighbor_label")


_DIST = "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))"
query("comparables_embeddings", (
    "SELECT query_id, rank, neighbor_id, round(distance, 6) AS distance, "
    "round_even((1 / (1 + distance)) * 100, 0) / 100 AS similarity, neighbor_label FROM ("
    f"SELECT q.vec_id AS query_id, c.vec_id AS neighbor_id, c.label AS neighbor_label, {_DIST} AS distance, "
    f"CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_DIST}, 10), c.vec_id) AS INT) AS rank "
    "FROM embeddings q JOIN embeddings c ON q.vec_id <> c.vec_id) x WHERE rank <= 5"))(_knn_embeddings)

_IMP = [f"_i{i}" for i in range(len(T3_FEATURES))]
_STD = [f"_s{i}" for i in range(len(T3_FEATURES))]


def _panel_vectors(spark, d):
    sp = split_t3(spark, d)  # every cohort row, checkpointed, with its split
    tr = sp.filter(F.col("split") == "train")
    imp = MedianImputer(inputCols=T3_FEATURES, outputCols=_IMP).fit(tr)
    sc = PopulationScaler(inputCols=_IMP, outputCols=_STD).fit(imp.transform(tr))
    t = sc.transform(imp.transform(sp))
    return t.select("name", F.array(*_STD).alias("vec"), F.col(LABEL).alias("tier"))


def _comparables(spark, d):
    v = _panel_vectors(spark, d)
    nn = exact_knn(v, v, "name", "vec", 5)
    lab = v.select(F.col("name").alias("neighbor_id"), "tier").dropDuplicates(["neighbor_id"])
    return nn.join(lab, "neighbor_id").select(
        F.col("query_id").alias("name"), "rank", F.col("neighbor_id").alias("neighbor"),
        F.round("distance", 6).alias("distance"), similarity(F.col("distance")).alias("similarity"),
        F.col("tier").alias("neighbor_tier"))


def _vec_sql() -> str:
    med = "SELECT feature, (max(" + _median_sql().split("\nSELECT feature, (max(")[1]
    body = esql("SELECT 1").rsplit("\nSELECT 1", 1)[0]

    def imputed(src):
        return ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median FROM md WHERE feature = '{c}')) AS {c}"
                         for c in T3_FEATURES)
    scaled = ", ".join(f"({c} - (SELECT mean FROM st WHERE feature = '{c}')) / (SELECT scale FROM st WHERE "
                       f"feature = '{c}')" for c in T3_FEATURES)
    return (body + f",\nmd AS ({med}),\nimtr AS (SELECT {imputed('tr')} FROM tr),\n"
            f"st AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1.0 ELSE "
            f"stddev_pop(value) END AS scale FROM (UNPIVOT imtr ON {', '.join(T3_FEATURES)} INTO NAME feature "
            f"VALUE value) u GROUP BY feature),\n"
            f"ima AS (SELECT name, {LABEL}, {imputed('t3_train')} FROM t3_train),\n"
            f"vec AS (SELECT name, {LABEL} AS tier, list_value({scaled}) AS v FROM ima)")


_PD = "list_distance(q.v, c.v)"
COMPARABLES_SQL = _vec_sql() + (
    "\nSELECT name, rank, neighbor, round(distance, 6) AS distance, "
    "round_even((1 / (1 + distance)) * 100, 0) / 100 AS similarity, neighbor_tier FROM ("
    f"SELECT q.name, c.name AS neighbor, c.tier AS neighbor_tier, {_PD} AS distance, "
    f"CAST(row_number() OVER (PARTITION BY q.name ORDER BY round({_PD}, 10), c.name) AS INT) AS rank "
    "FROM vec q JOIN vec c ON true) x WHERE rank <= 5")
query("comparables", COMPARABLES_SQL)(_comparables)

# --------------------------------------------------------------- forests --
def _fit(spark, d):
    return once(spark, d, "forest", lambda: TR.forest_pipeline(T3_FEATURES, LABEL, TR.ForestConfig()).fit(train_rows(spark, d)))


def _test_scores(spark, d):
    """Scores of the rows that the forest has not seen."""
    return SC.score(_fit(spark, d), split_t3(spark, d).filter("split = 'test'"), "name", K, keep=(LABEL,))


query("forest_train")(_test_scores)


def _folds(spark, d):
    return stratified_folds(train_rows(spark, d), LABEL, "name", 5, 42)


def _run(spark, d):
    return once(spark, d, "run", lambda: SC.training_run(cohort_t3(spark, d), T3_FEATURES, LABEL, "name", K, TR.ForestConfig(),
                                                         parallelism=PARALLEL_FITS))


query("cv_scores")(lambda spark, d: TR.cv_scores(_folds(spark, d), T3_FEATURES, LABEL, "fold", TR.ForestConfig(), parallelism=PARALLEL_FITS))
# the search of the training run: same rows, folds, draws and seed
query("random_search")(lambda spark, d: _run(spark, d)["search"])


def _bn_split(spark, d):
    from ..operators.split import stratified_split
    return stratified_split(cohort_bn(spark, d), BN.label_col, "name", 0.2, 42)


def _binary_model(spark, d):
    def make():
        sp = materialize(_bn_split(spark, d))
        return TR.forest_pipeline(BN_FEATURES, BN.label_col, TR.BINARY_FOREST).fit(sp.filter("split = 'train'")), sp
    return once(spark, d, "binary", make)


def _forest_binary(spark, d):
    from . import evaluation as E
    model, sp = _binary_model(spark, d)
    s = SC.score(model, sp.filter("split = 'test'"), "name", 2, keep=(BN.label_col,))
    return E.classification_report(s, BN.label_col, "pred", 2)


query("forest_train_binary")(_forest_binary)
query("importances")(lambda spark, d: X.importance_table(TR.importances(_fit(spark, d), T3_FEATURES)))


query("training_run")(lambda spark, d: _run(spark, d)["summary"])


def _run_summary(spark, d):
    from .catalog_stump import run_facts
    return run_facts(spark, _run(spark, d)["facts"])


query("run_summary")(_run_summary)


def _model_store(spark, d):
    model = _fit(spark, d)
    path = TR.model_path(spark, "store")
    TR.save_model(model, path, T3_FEATURES, {"note": "registered query"})
    loaded, meta = TR.load_model(path)
    t = cohort_t3(spark, d)
    a = SC.score(model, t, "name", K).select("name", F.col("pred").alias("a"))
    b = SC.score(loaded, t, "name", K).select("name", F.col("pred").alias("b"))
    return a.join(b, "name").agg(F.count(F.lit(1)).alias("n"),
                                 F.sum((F.col("a") == F.col("b")).cast("int")).alias("n_same"),
                                 F.lit(len(meta["feature_columns"])).alias("n_features"))


# twin: every cohort row scored by both models, all predictions equal, the
# stored metadata lists every feature
query("model_store", O.sql(
    f"SELECT count(*) AS n, count(*) AS n_same, {len(T3_FEATURES)} AS n_features FROM t3_train"))(_model_store)


def _evaluation_run(spark, d):
    # E12 as in the original: the evaluation starts from a stored model
    path = TR.model_path(spark, "evaluation")
    TR.save_model(_fit(spark, d), path, T3_FEATURES, {"note": "registered query"})
    model, _ = TR.load_model(path)
    return SC.evaluation_run(model, cohort_t3(spark, d), LABEL, "name", K)["report"]


query("evaluation_run")(_evaluation_run)
query("score")(lambda spark, d: SC.score(_fit(spark, d), cohort_t3(spark, d), "name", K, keep=(LABEL,)))


def _ranking(spark, d):
    s = SC.score(_fit(spark, d), cohort_t3(spark, d), "name", K, keep=(LABEL,))
    return SC.ranking_table(s, "name", LABEL, K)


query("ranking_table")(_ranking)
query("hit_rate")(lambda spark, d: SC.hit_rate(_ranking(spark, d)))


def _records(spark, d):
    model = _fit(spark, d)
    t = cohort_t3(spark, d)
    s = SC.score(model, t, "name", K)
    imp = TR.importances(model, T3_FEATURES)
    ref = X.feature_reference_stats(t, T3_FEATURES)
    contrib = X.contributions(t, ref, imp, T3_FEATURES, "name")
    factors = X.top_factors(contrib, "name", 5)
    sch = FE.feature_schema(spark, T3)
    c = contrib.join(F.broadcast(sch), "feature")
    descr = c.select("name", "feature", X.describe_factor(
        F.col("category"), F.col("feature"), F.col("stat"), F.col("age"), F.col("value"), F.col("mean"),
        F.col("z"), T3.baseline_age, T3.career_high[1], T3.career_mean[1],
        T3.seasons_name.format(age=T3.baseline_age)).alias("description"))
    comps = SC.comparables(model, t, t, "name", LABEL, 5)
    return SC.prediction_records(s, factors, comps, "name", K, descr)


query("prediction_record")(_records)
query("interpretation")(lambda spark, d: _records(spark, d).select("name", "interpretation"))


def _score_binary(spark, d):
    model, _ = _binary_model(spark, d)
    s = SC.score(model, cohort_bn(spark, d), "name", 2)
    return s.select("name", F.col("p1").alias("probability"), (F.col("p1") >= 0.5).alias("prediction"))


query("score_binary")(_score_binary)


def _longevity(spark, d):
    model, sp = _binary_model(spark, d)
    req = materialize(FE.request_features(fx.requests(spark, d), BN, keep=("name",)))  # scored, and searched with
    s = SC.score(model, req, "name", 2, keep=("par_delta_age29", "ast_delta_age29", "usg_delta_age29"))
    # comparables: nearest entities of the whole table in the model's (imputed) feature space
    comps = SC.comparables(model, req, sp, "name", BN.label_col, k=2)
    return SC.longevity_response(s, "name", "p1", {"3PAr": "par_delta_age29", "AST%": "ast_delta_age29",
                                                   "USG%": "usg_delta_age29"}, comps)


query("longevity_response")(_longevity)

# -------------------------------------------------------- sinks / sources --
RAW_SCHEMA = ("entity bigint, name string, period int, age int, pos string, seg string, mp string, "
              "usg string, ast double, par double, ts double, per double, bpm double, ws48 double, g bigint")
CSV_WRITE = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _write_raw_csv(spark, d) -> str:
    path = scratch(spark, "panel-csv")
    fx.panel(spark, d, "panel_raw").write.options(**CSV_WRITE).mode("overwrite").csv(path)
    return path


RAW_SQL = O.sql(f"SELECT name, {O.COERCED_COLS} FROM panel_raw")
NUMERIC = T3.panel.numeric


def _coerced(df):
    from ..operators.clean import coerce_numeric
    return coerce_numeric(df, NUMERIC).select("name", "entity", "period", "age", "pos", "seg", "mp", "usg",
                                             "ast", "par", "ts", "per", "bpm", "ws48", "g")


query("load_panel", RAW_SQL)(
    lambda spark, d: _coerced(R.load_panel(spark, _write_raw_csv(spark, d), "csv", RAW_SCHEMA)))


def _external(spark, d):
    key, before = "agewise.panel.path", spark.conf.get("agewise.panel.path", None)
    spark.conf.set(key, _write_raw_csv(spark, d))
    try:
        return R.load_panel_external(spark, fmt="csv", schema=RAW_SCHEMA)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def hash_range(h, n: int):
    """The range (0 to n - 1) of a hexadecimal hash: ranges rise with the hash and are of unlike, but comparable, length."""
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / (1 << 32)
    return F.least(F.lit(n - 1), F.floor(F.lit(n) * u * (u + 1) / 2)).cast("int")


def _first_in_files(fmt):
    """P7 by file order: the panel in several files of unlike size, in the order of a hash; read order breaks ties."""
    from dataclasses import replace
    from ..operators.clean import dedupe_total_else_first
    spec = replace(T3.panel, tiebreak=("_ordinal",))

    def run(spark, d):
        path = scratch(spark, f"panel-files-{fmt}")
        rows = fx.panel(spark, d, "panel_raw").withColumn("h", F.md5(F.concat_ws("|", "entity", "period", "seg")))
        # as many ranges of the hash as the session has shuffle partitions: the first twice as long as the mean, the last
        # two thirds of it
        files = max(9, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rows = rows.repartitionById(files, hash_range(F.col("h"), files)).sortWithinPartitions("h").drop("h")
        rows.write.options(**(CSV_WRITE if fmt == "csv" else {})).format(fmt).save(path)
        panel = R.load_panel(spark, path, fmt, RAW_SCHEMA if fmt == "csv" else None, ordinal="_ordinal")
        return dedupe_total_else_first(panel, spec).select("name", "period", "seg")
    return run


_FIRST_SQL = O.sql(
    "SELECT name, period, seg FROM (SELECT *, row_number() OVER (PARTITION BY name, period ORDER BY CASE WHEN seg = 'TOT' THEN 0 ELSE 1 END, "
    "md5(concat_ws('|', entity, period, seg))) AS rn FROM panel_raw WHERE name IS NOT NULL AND period IS NOT NULL) x WHERE rn = 1")
query("dedupe_first_in_csv_files", _FIRST_SQL)(_first_in_files("csv"))
query("dedupe_first_in_parquet_files", _FIRST_SQL)(_first_in_files("parquet"))


query("load_panel_external", RAW_SQL)(lambda spark, d: _coerced(_external(spark, d)))


def _save_features(spark, d):
    path = scratch(spark, "features")
    round6(train_t3(spark, d), [T3.career_mean[1]]).write.mode("overwrite").parquet(path)
    return path


TRAIN_SQL = O.sql(f"SELECT {O.feature_cols(T3_FEATURES)}, name, adaptability_tier FROM t3_train")
query("save_feature_table", TRAIN_SQL)(lambda spark, d: spark.read.parquet(_save_features(spark, d)))
query("load_feature_table", TRAIN_SQL)(lambda spark, d: R.load_feature_table(spark, _save_features(spark, d)))


def _split_io(spark, d):
    path = scratch(spark, "split")
    split_t3(spark, d).select("name", LABEL, "split").write.partitionBy("split").mode("overwrite").parquet(path)
    # reading one split is a partition filter: only that folder is listed
    return spark.read.parquet(path).filter(F.col("split") == "test").select("name", LABEL, "split")


query("save_load_split", esql(f"SELECT name, {LABEL}, split FROM ts WHERE split = 'test'"))(_split_io)


def _predictions_io(spark, d):
    path = scratch(spark, "predictions")
    s = scored(spark, d).select("name", "label", "pred", "p0", "p1", "p2")
    s.write.option("header", True).mode("overwrite").csv(path)
    return spark.read.schema(s.schema).option("header", True).csv(path)


query("save_predictions", esql("SELECT name, label, pred, p0, p1, p2 FROM sc2"))(_predictions_io)


def _importances_io(spark, d):
    path = scratch(spark, "importances")
    round6(X.importance_table(importance(spark, d))).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


query("save_load_importances", isql(
    "SELECT feature, round(importance, 6) AS importance, round(importance * 100, 6) AS importance_pct, "
    "round(sum(importance * 100) OVER (ORDER BY round(importance, 10) DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW), 6) AS cumulative_pct, CAST(row_number() OVER (ORDER BY round(importance, 10) DESC, feature) "
    "AS INT) AS rank FROM imp"))(_importances_io)


# ------------------------------------- ranking / interpretation, stand-in --
def _ranking_scored(spark, d):
    return SC.ranking_table(scored(spark, d), "name", "label", K)


_TL = O.tier_label_sql("{c}")
_R3 = "round_even({p} * 1000, 0) / 1000"
RANKING_SQL = esql(
    "SELECT name, pred AS predicted_tier, " + _TL.format(c="pred") + " AS predicted_label, "
    + ", ".join(f"{_R3.format(p=p)} AS prob_{i}" for i, p in enumerate(PROBS))
    + ", " + O.bands_sql("greatest(p0, p1, p2)", FXV.CONFIDENCE_BANDS, FXV.CONFIDENCE_ELSE)
    + " AS confidence, CAST(label AS INT) AS actual_tier, " + _TL.format(c="label")
    + " AS actual_label, pred = label AS correct FROM sc2")
query("ranking_table_scored", RANKING_SQL)(_ranking_scored)
query("hit_rate_scored", esql(
    "SELECT avg(CASE WHEN pred = label THEN 1 ELSE 0 END) AS hit_rate, count(*) AS n FROM sc2"))(
    lambda spark, d: SC.hit_rate(_ranking_scored(spark, d)))


def _interpretation_scored(spark, d):
    from ..operators.labels import tier_label
    s = scored(spark, d, cohort_t3(spark, d))
    contrib = contributions(spark, d)
    factors = X.top_factors(contrib, "name", 5)
    comps = _comparables(spark, d).withColumn("neighbor_label", tier_label(F.col("neighbor_tier")))
    rec = SC.prediction_records(s, factors, comps, "name", K, _describe(spark, d))
    return rec.select("name", "interpretation")


def _interpretation_sql() -> str:
    expr, sch = describe_parts()
    pct = "(CAST(CAST(round_even(greatest({a}) * 100, 0) AS BIGINT) AS VARCHAR) || '%')".format(
        a=", ".join(_R3.format(p=p) for p in PROBS))
    ctes = [
        IMP_CTE, CONTRIB_CTE,
        f"ds AS (SELECT name, feature, {expr} AS description FROM ct c JOIN (VALUES {sch}) "
        f"s(feature, category, stat, age) USING (feature))",
        "tf AS (SELECT name, feature, sign, rank FROM (SELECT name, feature, CASE WHEN contribution > 0 THEN "
        "'positive' ELSE 'negative' END AS sign, row_number() OVER (PARTITION BY name, contribution > 0 "
        "ORDER BY round(abs(contribution), 10) DESC, feature) AS rank FROM ct WHERE contribution <> 0) x "
        "WHERE rank = 1)",
        "kn AS (SELECT name, neighbor, tier, rank FROM (SELECT q.name, c.name AS neighbor, c.tier, "
        "row_number() OVER (PARTITION BY q.name ORDER BY round(list_distance(q.v, c.v), 10), c.name) AS rank "
        "FROM vec q JOIN vec c ON true) x WHERE rank <= 3)",
        "cm AS (SELECT name, string_agg(neighbor, ', ' ORDER BY rank) AS names, string_agg("
        + _TL.format(c="tier") + ", ', ' ORDER BY rank) AS labels FROM kn GROUP BY name)",
    ]
    from .. import fixed as FX
    from ..functions.text import render_sql
    op = {c: render_sql(FX.OPENINGS[c], entity="s.name", pct=pct) for c in (2, 1, 0)}
    sel = (
        f"SELECT s.name, CASE WHEN s.pred = 2 THEN {op[2]} WHEN s.pred = 1 THEN {op[1]} ELSE {op[0]} END "
        f"|| coalesce({render_sql(FX.STRENGTH, text='pd.description')}, '') "
        f"|| coalesce({render_sql(FX.CONCERN, text='nd.description')}, '') "
        f"|| coalesce({render_sql(FX.SIMILAR, names='cm.names', labels='cm.labels')}, '') "
        "AS interpretation FROM sc2 s "
        "LEFT JOIN (SELECT t.name, d.description FROM tf t JOIN ds d ON d.name = t.name AND d.feature = t.feature "
        "WHERE t.sign = 'positive') pd ON pd.name = s.name "
        "LEFT JOIN (SELECT t.name, d.description FROM tf t JOIN ds d ON d.name = t.name AND d.feature = t.feature "
        "WHERE t.sign = 'negative') nd ON nd.name = s.name LEFT JOIN cm ON cm.name = s.name")
    return _vec_sql() + ",\n" + ",\n".join(ctes) + "\n" + sel


query("interpretation_scored", _interpretation_sql())(_interpretation_scored)
