"""Registered queries, part 4: models with a closed form and their SQL twins.

The same code as the full-size forests runs here on trees that SQL can follow; see :mod:`closed_form`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed as FX
from ..functions.columns import round6
from ..operators import explain as X
from ..operators import features as FE
from ..operators.split import stratified_folds, stratified_split
from ..session import materialize
from ..sources import fixtures as fx
from ..spec import FIXTURE_BINARY as BN
from ..spec import FIXTURE_TIER3 as T3
from . import closed_form as CF
from . import evaluation as E
from . import oracle as O
from . import scoring as SC
from . import training as TR
from .catalog import cohort_bn, cohort_t3, query
from .catalog_eval import LABEL, PCM, PROBS, SEED, _describe, _folds_sql, _split_cte, contributions, esql, split_t3
from .catalog_ml import _comparables, _interpretation_sql, once

K = 3
FEATURES, BN_STEPS = CF.names(CF.TIER3_STEPS), CF.names(CF.BINARY_STEPS)
DRAWS = TR.sample_grid(4, SEED, CF.STUMP_GRID)


# ------------------------------------------------------------ tier model --
def _split(spark, d):
    return CF.stepped(split_t3(spark, d), CF.TIER3_STEPS)


def _train(spark, d):
    return _split(spark, d).filter("split = 'train'")


def _model(spark, d):
    return TR.forest_pipeline(FEATURES, LABEL, CF.STUMP).fit(_train(spark, d))


def _base() -> str:
    return esql("").rstrip()


def _fit_all(leaf: int = CF.STUMP.min_leaf) -> str:
    """The model of the training rows, scored on all rows."""
    rows = f"SELECT 0 AS g, split <> 'train' AS held, name, CAST({LABEL} AS INT) AS label, {CF.stepped_sql(CF.TIER3_STEPS)} FROM ts"
    return _base() + ",\n" + CF.fit_sql(rows, f"SELECT 0 AS g, {leaf} AS leaf", CF.TIER3_STEPS, K)


_P6 = ", ".join(f"round({p}, 6) AS {p}" for p in PROBS)


def tree_row(spark, model, features, k):
    """A one-split tree as a row: the split's feature and threshold, its gain, the shares of both sides (of a leaf: its own)."""
    node = model.stages[-1].trees[0]._call_java("rootNode")
    split = node.getClass().getSimpleName() == "InternalNode"
    share = lambda n: [x / sum(n.impurityStats().stats()) for x in n.impurityStats().stats()]
    sides = [share(x) for x in ((node.leftChild(), node.rightChild()) if split else (node, node))]
    row = [features[node.split().featureIndex()] if split else None, float(node.split().threshold()) if split else None,
           float(node.gain()) if split else None, *sides[0], *sides[1]]
    shape = "feature string, threshold double, gain double, " + ", ".join(f"{s}{c} double" for s in ("left_", "right_") for c in range(k))
    return round6(spark.createDataFrame([row], shape))


def _tree_sql(features, k) -> str:
    total = lambda x: "(" + " + ".join(f"{x}{c}" for c in range(k)) + ")"
    name = "CASE f " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(features)) + " END AS feature"
    sides = ", ".join(f"round(CASE WHEN f IS NULL THEN a{c} / {total('a')} ELSE {s}{c} / {total(s)} END, 6) AS {n}{c}"
                      for s, n in (("l", "left_"), ("r", "right_")) for c in range(k))
    return f"\nSELECT {name}, CASE WHEN f IS NOT NULL THEN round(t, 6) END AS threshold, CASE WHEN f IS NOT NULL THEN round(gain, 6) END AS gain, {sides} FROM q_tree"


query("forest_train_closed", _fit_all() + _tree_sql(FEATURES, K))(lambda spark, d: tree_row(spark, _model(spark, d), FEATURES, K))
query("importances_closed", _fit_all() + "\nSELECT n.feature, CASE WHEN n.i = t.f THEN 1.0 ELSE 0.0 END AS importance FROM q_tree t, (VALUES "
      + ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES)) + ") n(i, feature)")(
    lambda spark, d: TR.importances(_model(spark, d), FEATURES))


def _scored(spark, d, model=None):
    return SC.score(model or _model(spark, d), _split(spark, d), "name", K, keep=(LABEL, "split"))


query("score_closed", _fit_all() + f"\nSELECT name, label AS {LABEL}, pred, {_P6} FROM q_out")(
    lambda spark, d: round6(_scored(spark, d).drop("split").withColumn(LABEL, F.col(LABEL).cast("int")), PROBS))


def _stored(spark, d):
    path = TR.model_path(spark, "closed")
    TR.save_model(_model(spark, d), path, FEATURES, {"note": "first"})
    version = TR.save_model(_model(spark, d), path, FEATURES, {"note": "second"})
    model, meta = TR.load_model(path)
    s = round6(_scored(spark, d, model).drop("split", LABEL), PROBS)
    return s.withColumn("note", F.lit(meta["note"])).withColumn("newest", F.lit(TR.model_versions(path)[-1] == version))


query("model_store_closed", _fit_all() + f"\nSELECT name, pred, {_P6}, 'second' AS note, true AS newest FROM q_out")(_stored)


# ------------------------------------------------------- folds and search --
def _folds(spark, d):
    return materialize(stratified_folds(_train(spark, d), LABEL, "name", FX.FOLDS, SEED))


def _folded(draws) -> str:
    """Fits of every draw on every fold: ``g`` is 5 times the draw plus the fold."""
    fold = _folds_sql()[len(_base()):].strip()
    steps = CF.stepped_sql(CF.TIER3_STEPS)
    rows = (f"SELECT 5 * n.draw + x.range AS g, fo.fold = x.range AS held, t.name, CAST(t.{LABEL} AS INT) AS label, {steps} "
            f"FROM tr t JOIN fo ON fo.name = t.name, range(5) x, (VALUES {', '.join(f'({i})' for i in range(len(draws)))}) n(draw)")
    leaf = " UNION ALL ".join(f"SELECT {5 * i} + range AS g, {x['min_leaf']} AS leaf FROM range(5)" for i, x in enumerate(draws))
    return _base() + f",\nfo AS ({fold}),\n" + CF.fit_sql(rows, leaf, CF.TIER3_STEPS, K) + \
        f",\nq_f1 AS ({CF.f1_sql('SELECT g, label, pred FROM q_out WHERE held', K)})"


_CV = "SELECT CAST(g AS INT) AS fold, f1 FROM q_f1 UNION ALL SELECT -1, avg(f1) FROM q_f1 UNION ALL SELECT -2, stddev_pop(f1) FROM q_f1"
query("cv_scores_closed", _folded([{"min_leaf": CF.STUMP.min_leaf}]) + f"\nSELECT fold, round(f1, 6) AS f1_weighted FROM ({_CV}) z")(
    lambda spark, d: round6(TR.cv_scores(_folds(spark, d), FEATURES, LABEL, "fold", CF.STUMP)))
_SEARCH = ("SELECT CAST(g // 5 AS INT) AS draw, avg(f1) AS m FROM q_f1 GROUP BY 1")
query("random_search_closed", _folded(DRAWS) + "\nSELECT s.draw, l.min_leaf, round(m, 6) AS mean_f1, "
      "row_number() OVER (ORDER BY round(m, 10) DESC, s.draw) = 1 AS best "
      f"FROM ({_SEARCH}) s JOIN (VALUES {', '.join(f'({i}, {x["min_leaf"]})' for i, x in enumerate(DRAWS))}) l(draw, min_leaf) USING (draw)")(
    lambda spark, d: round6(TR.random_search(_folds(spark, d), FEATURES, LABEL, "fold", CF.STUMP, len(DRAWS), SEED, grid=CF.STUMP_GRID)[0]
                            .select("draw", "min_leaf", "mean_f1", "best"), ["mean_f1"]))


def _run(spark, d):
    return once(spark, d, "closed run", lambda: SC.training_run(
        CF.stepped(cohort_t3(spark, d), CF.TIER3_STEPS), FEATURES, LABEL, "name", K, CF.STUMP, len(DRAWS), grid=CF.STUMP_GRID))


def _run_sql() -> str:
    """Facts of the run: the baseline is the fit with ``STUMP``'s leaf, the model the best draw's."""
    draws = [*DRAWS, {"min_leaf": CF.STUMP.min_leaf}]
    rows = f"SELECT n.draw AS g, split <> 'train' AS held, name, CAST({LABEL} AS INT) AS label, {CF.stepped_sql(CF.TIER3_STEPS)} " \
           f"FROM ts, (VALUES {', '.join(f'({i})' for i in range(len(DRAWS)))}) n(draw)"
    leaf = " UNION ALL ".join(f"SELECT {i} AS g, {x['min_leaf']} AS leaf" for i, x in enumerate(DRAWS))
    final = CF.fit_sql(rows, leaf, CF.TIER3_STEPS, K, "z")
    n = len(DRAWS)
    pcm = PCM.replace("FROM ev", "FROM rv")
    return _folded(draws) + ",\n" + final + f""",
base AS (SELECT g - {5 * n} AS fold, f1 FROM q_f1 WHERE g >= {5 * n}),
found AS (SELECT draw, m FROM ({_SEARCH}) s WHERE draw < {n} ORDER BY round(m, 10) DESC, draw LIMIT 1),
rv AS (SELECT o.* FROM z_out o JOIN found ON found.draw = o.g WHERE held),
{pcm}"""


_FACTS = """
SELECT fact, round(CAST(value AS DOUBLE), 6) AS value FROM (
SELECT 'n_train' AS fact, count(*) FILTER (WHERE split = 'train') AS value FROM ts UNION ALL
SELECT 'n_test', count(*) FILTER (WHERE split = 'test') FROM ts UNION ALL
SELECT 'cv_mean', avg(f1) FROM base UNION ALL SELECT 'cv_std', stddev_pop(f1) FROM base UNION ALL
SELECT 'best_score', m FROM found UNION ALL
SELECT 'accuracy', avg(CASE WHEN label = pred THEN 1 ELSE 0 END) FROM rv UNION ALL
SELECT 'f1_weighted', sum(f1 * support) / sum(support) FROM pm UNION ALL
SELECT 'f1_macro', avg(CASE WHEN support + n_pred > 0 THEN f1 END) FROM pm UNION ALL
SELECT 'cv_fold_' || fold, f1 FROM base UNION ALL
SELECT 'class_' || class || '_' || metric, v FROM (UNPIVOT (SELECT class, precision, recall, f1 FROM pm) ON precision, recall, f1 INTO NAME metric VALUE v)) z"""


def run_facts(spark, facts):
    """A run's facts in long form."""
    rows = [(x, float(facts[x])) for x in ("n_train", "n_test", "cv_mean", "cv_std", "best_score", "accuracy", "f1_weighted", "f1_macro")]
    rows += [(f"cv_fold_{i}", s) for i, s in enumerate(facts["cv_scores"])]
    for c, m in facts["per_class"].items():
        rows += [(f"class_{c}_{k}", v) for k, v in m.items()]
    return spark.createDataFrame(rows, "fact string, value double")


query("run_summary_closed", _run_sql() + _FACTS)(lambda spark, d: round6(run_facts(spark, _run(spark, d)["facts"])))
query("training_run_closed", _run_sql() + "\nSELECT (SELECT count(*) FROM ts WHERE split = 'train') AS n_train, "
      "(SELECT count(*) FROM ts WHERE split = 'test') AS n_test, round((SELECT avg(f1) FROM base), 6) AS cv_mean, "
      "round((SELECT stddev_pop(f1) FROM base), 6) AS cv_std, round((SELECT m FROM found), 6) AS best_score, "
      f"(SELECT min_leaf FROM found JOIN (VALUES {', '.join(f'({i}, {chr(39)}{x["min_leaf"]}{chr(39)})' for i, x in enumerate(DRAWS))}) l(draw, min_leaf) USING (draw)) AS best_leaf, "
      "round((SELECT avg(CASE WHEN label = pred THEN 1 ELSE 0 END) FROM rv), 6) AS accuracy")(
    lambda spark, d: round6(_run(spark, d)["summary"].select("n_train", "n_test", "cv_mean", "cv_std", "best_score",
                                                            F.col("best_params")["min_leaf"].alias("best_leaf"), "accuracy"),
                            ["cv_mean", "cv_std", "best_score", "accuracy"]))


def _evaluation(spark, d):
    path = TR.model_path(spark, "closed-evaluation")
    TR.save_model(_model(spark, d), path, FEATURES, {})
    out = SC.evaluation_run(TR.load_model(path)[0], CF.stepped(cohort_t3(spark, d), CF.TIER3_STEPS), LABEL, "name", K)
    auc = out["auc"].select(F.concat(F.lit("auc_"), F.col("class")).alias("row"), F.col("auc").alias("value"))
    per = out["per_class"].select(F.explode(F.array(*[F.struct(F.concat(F.lit(f"{m}_"), F.col("class")).alias("row"), F.col(m).cast("double").alias("value"))
                                                      for m in ("precision", "recall", "f1", "support")])).alias("x")).select("x.*")
    acc = out["accuracy"].select(F.lit("accuracy").alias("row"), F.col("accuracy").alias("value"))
    return round6(per.unionByName(acc).unionByName(auc), ["value"])


_AUC = " UNION ALL ".join(
    f"SELECT 'auc_{c}' AS row, sum(CASE WHEN x.p{c} > y.p{c} THEN 1.0 WHEN x.p{c} = y.p{c} THEN 0.5 ELSE 0 END) / count(*) AS value "
    f"FROM rv x JOIN rv y ON x.label = {c} AND y.label <> {c} HAVING count(*) > 0" for c in range(K))
query("evaluation_run_closed", _fit_all() + ",\nrv AS (SELECT name, label, pred, " + ", ".join(f"round({p}, 10) AS {p}" for p in PROBS)
      + " FROM q_out WHERE held),\n" + PCM.replace("FROM ev", "FROM rv")
      + "\nSELECT row, round(value, 6) AS value FROM (SELECT metric || '_' || class AS row, v AS value FROM (UNPIVOT (SELECT class, precision, recall, f1, "
        "CAST(support AS DOUBLE) AS support FROM pm) ON precision, recall, f1, support INTO NAME metric VALUE v) UNION ALL "
        f"SELECT 'accuracy', avg(CASE WHEN label = pred THEN 1 ELSE 0 END) FROM rv UNION ALL {_AUC}) z")(_evaluation)


# ------------------------------------------------------------ the record --
def _record(spark, d):
    s = _scored(spark, d).drop(LABEL, "split")
    factors = X.top_factors(contributions(spark, d), "name", FX.TOP_FACTORS)
    from ..operators.labels import tier_label
    comps = _comparables(spark, d).withColumn("neighbor_label", tier_label(F.col("neighbor_tier")))
    return SC.prediction_records(s, factors, comps, "name", K, _describe(spark, d))


def _record_sql() -> str:
    text = _interpretation_sql()
    body, last = text.rsplit("\nSELECT s.name, CASE", 1)
    probs = ", ".join(f"round_even(s.{p} * 1000, 0) / 1000 AS prob_{i}" for i, p in enumerate(PROBS))
    rows = f"SELECT 0 AS g, split <> 'train' AS held, name, CAST({LABEL} AS INT) AS label, {CF.stepped_sql(CF.TIER3_STEPS)} FROM ts"
    fit = CF.fit_sql(rows, f"SELECT 0 AS g, {CF.STUMP.min_leaf} AS leaf", CF.TIER3_STEPS, K)
    last = last.replace("FROM sc2 s", "FROM q_out s")
    return (body + ",\n" + fit + f"\nSELECT s.name, s.pred AS predicted_tier, {O.tier_label_sql('s.pred')} AS predicted_label, {probs}, "
            + O.bands_sql("greatest(s.p0, s.p1, s.p2)", FX.CONFIDENCE_BANDS, FX.CONFIDENCE_ELSE) + " AS confidence, cm.names AS comparables, CASE" + last)


query("prediction_record_closed", _record_sql())(lambda spark, d: _record(spark, d).select(
    "name", "predicted_tier", "predicted_label", *[F.map_values("probabilities")[i].alias(f"prob_{i}") for i in range(K)], "confidence",
    F.array_join(F.transform(F.slice("comparables", 1, FX.COMPARABLES_IN_SENTENCE), lambda c: c["neighbor"]), ", ").alias("comparables"), "interpretation"))


# ---------------------------------------------------------- binary model --
def _binary(spark, d):
    t = CF.stepped(cohort_bn(spark, d), CF.BINARY_STEPS)
    sp = materialize(stratified_split(t, BN.label_col, "name", FX.TEST_FRACTION, SEED))
    return TR.forest_pipeline(BN_STEPS, BN.label_col, CF.STUMP_BINARY).fit(sp.filter("split = 'train'")), sp


def _binary_ctes(more: str = "") -> str:
    rows = (f"SELECT 0 AS g, split <> 'train' AS held, name, CAST({BN.label_col} AS INT) AS label, {CF.stepped_sql(CF.BINARY_STEPS)} FROM bs" + more)
    return (O.sql("SELECT 1").replace("\nSELECT 1", "") + ",\n" + _split_cte("bn_train", BN.label_col, "bs") + ",\n"
            + CF.fit_sql(rows, f"SELECT 0 AS g, {CF.STUMP_BINARY.min_leaf} AS leaf", CF.BINARY_STEPS, 2))


query("forest_train_binary_closed", _binary_ctes() + _tree_sql(BN_STEPS, 2))(lambda spark, d: tree_row(spark, _binary(spark, d)[0], BN_STEPS, 2))


def _score_binary(spark, d):
    model, sp = _binary(spark, d)
    s = SC.score(model, sp, "name", 2)
    return s.select("name", F.round("p1", 6).alias("probability"), (F.col("p1") >= 0.5).alias("prediction"))


query("score_binary_closed", _binary_ctes() + "\nSELECT name, round(p1, 6) AS probability, p1 >= 0.5 AS prediction FROM q_out")(_score_binary)


def _longevity(spark, d):
    model, sp = _binary(spark, d)
    req = materialize(CF.stepped(FE.request_features(fx.requests(spark, d), BN, keep=("name",)), CF.BINARY_STEPS))
    s = SC.score(model, req, "name", 2, keep=("par_delta_age29", "ast_delta_age29", "usg_delta_age29"))
    comps = SC.comparables(model, req, sp, "name", BN.label_col, k=2)  # among all entities, test rows too
    out = SC.longevity_response(s, "name", "p1", {"3PAr": "par_delta_age29", "AST%": "ast_delta_age29", "USG%": "usg_delta_age29"}, comps)
    r = F.from_json("response", "Prediction boolean, Probability double, Risk_Level string, GM_Advice string, Comparables array<string>, "
                                "Key_Adaptability_Signals map<string,string>")
    return out.select("name", r.alias("r")).select(
        "name", F.col("r.Prediction").alias("decision"), F.col("r.Probability").alias("probability"), F.col("r.Risk_Level").alias("risk"),
        F.col("r.GM_Advice").alias("advice"), F.array_join("r.Comparables", ", ").alias("comparables"),
        *[F.col("r.Key_Adaptability_Signals")[s].alias(f"signal_{c}") for s, c in (("3PAr", "par"), ("AST%", "ast"), ("USG%", "usg"))])


def _longevity_sql() -> str:
    j = lambda a, s: f"CAST(json_extract(request, '$.age_{a}.{s}') AS DOUBLE)"
    cols = ", ".join([f"{j(28, 'mp')} AS mp_age28", *[f"{j(a, 'mp')} - {j(28, 'mp')} AS mp_delta_age{a}" for a in (29, 31)],
                      *[f"{j(29, s)} - {j(28, s)} AS {s}_delta_age29" for s in ("par", "ast", "usg")]])
    steps = CF.stepped_sql(CF.BINARY_STEPS)
    vec = lambda src: f"SELECT name, list_value({', '.join(f'coalesce({c}, (SELECT med FROM q_med WHERE f = {i}))' for i, c in enumerate(BN_STEPS))}) AS v FROM {src}"
    side = "CASE f " + " ".join(f"WHEN {i} THEN v[{i + 1}]" for i in range(len(BN_STEPS))) + " END"
    p1 = f"CASE WHEN f IS NULL THEN a1 / (a0 + a1) WHEN {side} <= t THEN l1 / (l0 + l1) ELSE r1 / (r0 + r1) END"
    sig = ", ".join(O.signal_sql(f"{s}_delta_age29") + f" AS signal_{s}" for s in ("par", "ast", "usg"))
    return _binary_ctes() + f""",
rq AS (SELECT name, {cols} FROM requests), rs AS (SELECT *, {steps} FROM rq), cs AS (SELECT name, {steps} FROM bs),
rv AS ({vec('rs')}), cv AS ({vec('cs')}),
nn AS (SELECT q.name, c.name AS other, row_number() OVER (PARTITION BY q.name ORDER BY round(list_distance(q.v, c.v), 10), c.name) AS rank FROM rv q, cv c),
nm AS (SELECT name, string_agg(other, ', ' ORDER BY rank) AS comparables FROM nn WHERE rank <= 2 GROUP BY name),
pr AS (SELECT name, {p1} AS p FROM rv, q_tree)
SELECT rs.name, p >= 0.5 AS decision, round(p, 2) AS probability, {O.bands_sql('p', FX.RISK_BANDS, FX.RISK_ELSE)} AS risk, '{FX.GM_ADVICE}' AS advice,
  comparables, {sig} FROM rs JOIN pr USING (name) JOIN nm USING (name)"""


query("longevity_response_closed", _longevity_sql())(_longevity)
