"""Registered queries, part 2: split / preprocessing, evaluation, description,
importances and explanations (M1-M4, M6, M9, M10, E1-E10, E13, D1-D9, X2-X5,
X12, X13).

The scored table is a stand-in for model output: closed-form class
probabilities from the cohort's baseline weight (r0 = 1, r1 = w/150,
r2 = (w/200)^2, p_i = r_i / sum), so the metric operators can be checked
against SQL without depending on forest randomness.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, round6
from .. import fixed as FXV
from ..session import materialize
from ..operators import explain as X
from ..operators import features as FE
from ..operators.prep import BalancedWeights, MedianImputer, PopulationScaler
from ..operators.split import stratified_folds, stratified_split
from ..spec import FIXTURE_BINARY as BN
from ..spec import FIXTURE_TIER3 as T3
from . import describe as D
from . import evaluation as E
from . import oracle as O
from .catalog import T3_FEATURES, clean_t3, cohort_t3, query, shared, train_bn, train_t3

K = 3
LABEL = T3.label_col
PROBS = ["p0", "p1", "p2"]
SEED = 42


# ------------------------------------------------------------ stand-ins --
def scored(spark, d, cohort: DataFrame | None = None) -> DataFrame:
    t = train_t3(spark, d) if cohort is None else cohort
    w = F.col("age30_mp")
    r1, r2 = w / 150, (w / 200) * (w / 200)
    s = (F.lit(1.0) + r1) + r2
    p0, p1, p2 = F.lit(1.0) / s, r1 / s, r2 / s
    pred = F.when((p0 >= p1) & (p0 >= p2), 0).when(p1 >= p2, 1).otherwise(2)
    return t.select("name", F.col(LABEL).alias("label"), p0.alias("p0"), p1.alias("p1"), p2.alias("p2"),
                    pred.cast("int").alias("pred"), "age30_mp")


def scored_split(spark, d) -> DataFrame:
    return materialize(stratified_split(materialize(scored(spark, d)), "label", "name", 0.2, SEED))


def test_rows(spark, d) -> DataFrame:
    return scored_split(spark, d).filter(F.col("split") == "test")


def split_t3(spark, d) -> DataFrame:
    # the cohort table is read by the selection passes and the split by several
    # later jobs (medians, scaling, folds, fits): both are checkpointed, so the
    # panel chain runs once
    return shared(d, "t3 split", lambda: materialize(stratified_split(cohort_t3(spark, d), LABEL, "name", 0.2, SEED)))


def train_rows(spark, d) -> DataFrame:
    return split_t3(spark, d).filter(F.col("split") == "train")


def _hash(key: str, salt: str) -> str:
    return f"CAST(('0x' || substr(md5({key} || '{salt}'), 1, 13)) AS BIGINT)"


def _split_cte(src: str, label: str, name: str) -> str:
    return f"""{name}_h AS (SELECT *, {_hash('name', f':{SEED}')} AS u FROM {src}),
{name}_n AS (SELECT {label} AS c, count(*) AS n_c FROM {name}_h GROUP BY 1),
{name}_t AS (SELECT sum(n_c) AS n, CAST(ceil(CAST(0.2 AS DOUBLE) * sum(n_c)) AS BIGINT) AS n_sel FROM {name}_n),
{name}_q0 AS (SELECT c, n_c, (n_c * n_sel) // n AS base, (n_c * n_sel) % n AS rem, n_sel FROM {name}_n, {name}_t),
{name}_q AS (SELECT c, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, c)
                                  <= n_sel - sum(base) OVER () THEN 1 ELSE 0 END AS q FROM {name}_q0),
{name} AS (SELECT h.* EXCLUDE (u), CASE WHEN row_number() OVER (PARTITION BY h.{label} ORDER BY h.u, h.name)
                       <= q.q THEN 'test' ELSE 'train' END AS split
        FROM {name}_h h JOIN {name}_q q ON q.c = h.{label})"""


SCORED_CTE = """sc AS (
  SELECT name, label, 1 / (1 + r1 + r2) AS p0, r1 / (1 + r1 + r2) AS p1, r2 / (1 + r1 + r2) AS p2, age30_mp
  FROM (SELECT name, adaptability_tier AS label, age30_mp, age30_mp / 150 AS r1,
               (age30_mp / 200) * (age30_mp / 200) AS r2 FROM t3_train) x),
sc2 AS (SELECT *, CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS INT) AS pred
        FROM sc)"""


def esql(select: str) -> str:
    """SQL over the scored stand-in and the exact split (``ss``, test rows ``ev``)."""
    return O.sql("SELECT 1").replace("\nSELECT 1", "") + ",\n" + SCORED_CTE + ",\n" + \
        _split_cte("sc2", "label", "ss") + ",\n" + _split_cte("t3_train", LABEL, "ts") + \
        ",\nev AS (SELECT * FROM ss WHERE split = 'test'),\ntr AS (SELECT * FROM ts WHERE split = 'train')\n" + select


# ------------------------------------------------------- split / prep --
query("stratified_split", esql(f"SELECT name, {LABEL}, split FROM ts"))(
    lambda spark, d: split_t3(spark, d).select("name", LABEL, "split"))


def _folds_sql() -> str:
    j = " + ".join(f"CASE WHEN r >= ({i} * n_c) // 5 THEN 1 ELSE 0 END" for i in range(1, 5))
    return esql(
        f"SELECT name, {LABEL}, CAST({j} AS INT) AS fold FROM ("
        f"SELECT name, {LABEL}, row_number() OVER (PARTITION BY {LABEL} ORDER BY {_hash('name', f':fold:{SEED}')}, name) - 1 AS r, "
        f"count(*) OVER (PARTITION BY {LABEL}) AS n_c FROM tr) x")


query("fold_assignment", _folds_sql())(
    lambda spark, d: stratified_folds(train_rows(spark, d), LABEL, "name", 5, SEED).select("name", LABEL, "fold"))


def _medians(spark, d):
    m = MedianImputer(inputCols=T3_FEATURES).fit(train_rows(spark, d)).medians()
    return spark.createDataFrame([(f, m[f]) for f in T3_FEATURES], "feature string, median double")


def _median_sql() -> str:
    return esql(
        "SELECT feature, (max(CASE WHEN r = (n - 1) // 2 THEN value END) + max(CASE WHEN r = n // 2 THEN value END)) / 2.0 "
        "AS median FROM (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r, "
        "count(*) OVER (PARTITION BY feature) AS n FROM (UNPIVOT (SELECT "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in T3_FEATURES)
        + f" FROM tr) ON {', '.join(T3_FEATURES)} INTO NAME feature VALUE value) u) x GROUP BY feature")


query("impute_median", _median_sql())(_medians)


def _scaler(spark, d):
    tr = train_rows(spark, d)
    imp = MedianImputer(inputCols=T3_FEATURES).fit(tr)
    st = PopulationScaler(inputCols=T3_FEATURES).fit(imp.transform(tr)).stats()
    rows = [(f, st[f][0], 1.0 if not st[f][1] else st[f][1]) for f in T3_FEATURES]
    return round6(spark.createDataFrame(rows, "feature string, mean double, scale double"))


def _scaler_sql() -> str:
    med = _median_sql().split("\nSELECT feature, (max(")[1]
    med = "SELECT feature, (max(" + med
    imputed = ", ".join(f"coalesce(CAST({c} AS DOUBLE), (SELECT median FROM md WHERE feature = '{c}')) AS {c}"
                        for c in T3_FEATURES)
    body = esql("SELECT 1").rsplit("\nSELECT 1", 1)[0]
    return (body + f",\nmd AS ({med}),\nim AS (SELECT {imputed} FROM tr)\n"
            f"SELECT feature, round(avg(value), 6) AS mean, round(CASE WHEN stddev_pop(value) = 0 THEN 1.0 "
            f"ELSE stddev_pop(value) END, 6) AS scale FROM (UNPIVOT im ON {', '.join(T3_FEATURES)} "
            f"INTO NAME feature VALUE value) u GROUP BY feature")


query("standardize", _scaler_sql())(_scaler)


def _weights(spark, d):
    tr = train_rows(spark, d)
    w = BalancedWeights(labelCol=LABEL, weightCol="weight").fit(tr).transform(tr)
    return w.groupBy(F.col(LABEL).cast("int").alias("class")).agg(
        F.count(F.lit(1)).alias("n"), F.first("weight").alias("weight"))


query("balanced_weights", esql(
    f"SELECT CAST({LABEL} AS INT) AS class, count(*) AS n, "
    f"(SELECT count(*) FROM tr) / ((SELECT count(DISTINCT {LABEL}) FROM tr) * count(*)) AS weight "
    f"FROM tr GROUP BY 1"))(_weights)

# ----------------------------------------------------------- evaluation --
query("accuracy", esql("SELECT avg(CASE WHEN label = pred THEN 1 ELSE 0 END) AS accuracy FROM ev"))(
    lambda spark, d: E.accuracy(test_rows(spark, d), "label", "pred"))

PCM = """cls AS (SELECT CAST(range AS INT) AS class FROM range(3)),
cm AS (SELECT label, pred, count(*) AS n FROM ev GROUP BY label, pred),
pcm AS (SELECT c.class, coalesce(t.n, 0) AS tp, coalesce(s.n, 0) AS support, coalesce(p.n, 0) AS n_pred
        FROM cls c LEFT JOIN (SELECT label, n FROM cm WHERE label = pred) t ON t.label = c.class
        LEFT JOIN (SELECT label, sum(n) AS n FROM cm GROUP BY label) s ON s.label = c.class
        LEFT JOIN (SELECT pred, sum(n) AS n FROM cm GROUP BY pred) p ON p.pred = c.class),
pm AS (SELECT class, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS precision,
              CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall,
              CASE WHEN support + n_pred > 0 THEN 2 * tp / (support + n_pred) ELSE 0.0 END AS f1,
              CAST(support AS BIGINT) AS support, CAST(n_pred AS BIGINT) AS n_pred, CAST(tp AS BIGINT) AS tp
       FROM pcm)"""


def psql(select: str) -> str:
    return esql("").rstrip() + ",\n" + PCM + "\n" + select


query("per_class_metrics", psql("SELECT * FROM pm"))(
    lambda spark, d: E.per_class_metrics(test_rows(spark, d), "label", "pred", K))

query("f1_weighted_macro", psql(
    "SELECT round(sum(f1 * support) / sum(support), 6) AS f1_weighted, "
    "round(avg(CASE WHEN support + n_pred > 0 THEN f1 END), 6) AS f1_macro FROM pm"))(
    lambda spark, d: round6(E.f1_averages(test_rows(spark, d), "label", "pred", K)))

query("confusion", psql(
    "SELECT c.class, " + ", ".join(
        f"CAST(coalesce((SELECT n FROM cm WHERE cm.label = c.class AND cm.pred = {j}), 0) AS BIGINT) AS pred_{j}"
        for j in range(K)) + " FROM cls c"))(
    lambda spark, d: E.confusion(test_rows(spark, d), "label", "pred", K))


def _report(spark, d):
    r = E.classification_report(test_rows(spark, d), "label", "pred", K)
    agg = F.col("row").isin("macro avg", "weighted avg")
    return r.select("row", *[F.when(agg, F.round(c, 6)).otherwise(F.col(c)).alias(c)
                             for c in ("precision", "recall", "f1")], "support")


query("classification_report", psql(
    "SELECT CAST(class AS VARCHAR) AS row, precision, recall, f1, support FROM pm UNION ALL "
    "SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM pm UNION ALL "
    "SELECT 'macro avg', round(avg(CASE WHEN support + n_pred > 0 THEN precision END), 6), "
    "round(avg(CASE WHEN support + n_pred > 0 THEN recall END), 6), "
    "round(avg(CASE WHEN support + n_pred > 0 THEN f1 END), 6), CAST(sum(support) AS BIGINT) FROM pm UNION ALL "
    "SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), "
    "round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), "
    "CAST(sum(support) AS BIGINT) FROM pm"))(_report)

ROC_CTE = """lsc AS (SELECT class, score, sum(pos) AS pos, sum(1 - pos) AS neg FROM (
    SELECT 0 AS class, p0 AS score, CASE WHEN label = 0 THEN 1 ELSE 0 END AS pos FROM ev UNION ALL
    SELECT 1, p1, CASE WHEN label = 1 THEN 1 ELSE 0 END FROM ev UNION ALL
    SELECT 2, p2, CASE WHEN label = 2 THEN 1 ELSE 0 END FROM ev) x GROUP BY class, score),
tot AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM lsc GROUP BY class HAVING sum(pos) > 0),
roc AS (SELECT l.class, l.score, l.pos, l.neg, t.P, t.N,
               sum(l.pos) OVER (PARTITION BY l.class ORDER BY l.score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
               sum(l.neg) OVER (PARTITION BY l.class ORDER BY l.score DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg
        FROM lsc l JOIN tot t ON t.class = l.class)"""

query("roc_points", esql("").rstrip() + ",\n" + ROC_CTE + "\nSELECT CAST(class AS INT) AS class, score AS threshold, "
      "cum_neg / N AS fpr, cum_pos / P AS tpr FROM roc UNION ALL "
      "SELECT CAST(class AS INT), CAST('Infinity' AS DOUBLE), 0 / N, 0 / P FROM tot")(
    lambda spark, d: E.roc_points(test_rows(spark, d), "label", PROBS))

query("auc_ovr", esql("").rstrip() + ",\n" + ROC_CTE + "\nSELECT CAST(class AS INT) AS class, "
      "round(sum(neg * (cum_pos - pos + 0.5 * pos)) / (any_value(P) * any_value(N)), 6) AS auc FROM roc GROUP BY class")(
    lambda spark, d: round6(E.auc_ovr(test_rows(spark, d), "label", PROBS)))

query("class_distribution", esql(
    "SELECT s.split, CAST(c.range AS INT) AS class, CAST(coalesce(x.n, 0) AS BIGINT) AS n, "
    "CAST(s.n_split AS BIGINT) AS n_split FROM (SELECT split, count(*) AS n_split FROM ts GROUP BY split) s "
    f"CROSS JOIN range(3) c LEFT JOIN (SELECT split, {LABEL} AS class, count(*) AS n FROM ts GROUP BY 1, 2) x "
    "ON x.split = s.split AND x.class = c.range"))(
    lambda spark, d: E.class_distribution(split_t3(spark, d), LABEL, "split", K))

query("correct_examples", esql(
    "SELECT class, entity, rank FROM (SELECT CAST(label AS INT) AS class, name AS entity, "
    "CAST(row_number() OVER (PARTITION BY label ORDER BY name) AS INT) AS rank FROM ev WHERE label = pred) x "
    "WHERE rank <= 5"))(
    lambda spark, d: E.correct_examples(test_rows(spark, d), "label", "pred", "name", 5))

_LABEL_SQL = O.tier_label_sql("{c}")
query("misclassified", esql(
    "SELECT name AS entity, CAST(label AS INT) AS actual, CAST(pred AS INT) AS predicted, "
    f"{_LABEL_SQL.format(c='label')} AS actual_label, {_LABEL_SQL.format(c='pred')} AS predicted_label "
    "FROM ev WHERE label <> pred"))(
    lambda spark, d: E.misclassified(test_rows(spark, d), "label", "pred", "name"))

query("tier_examples", O.sql(
    f"SELECT class, entity, rank FROM (SELECT CAST({LABEL} AS INT) AS class, name AS entity, "
    f"CAST(row_number() OVER (PARTITION BY {LABEL} ORDER BY name) AS INT) AS rank FROM t3_train) x WHERE rank <= 5"))(
    lambda spark, d: E.first_per_class(train_t3(spark, d), LABEL, "name", 5))

# ----------------------------------------------------------- describe --
S = T3.panel
query("panel_summary", O.sql(
    "SELECT count(*) AS total_records, count(DISTINCT name) AS unique_entities, min(period) AS period_min, "
    "max(period) AS period_max, min(age) AS age_min, max(age) AS age_max, round(avg(mp), 6) AS avg_weight, "
    + ", ".join(f"count({s}) / count(*) * 100 AS pct_{s}" for s in S.stats) + " FROM t3_clean"))(
    lambda spark, d: round6(D.panel_summary(clean_t3(spark, d), S), ["avg_weight"]))

TIER_MEAN_COLS = ["age30_per", "age30_bpm", "age30_ws48", "age30_usg", "age30_mp", "age30_par"]
query("tier_means", O.sql(
    f"SELECT {LABEL}, " + ", ".join(f"round_even(avg({c}), 2) AS {c}" for c in TIER_MEAN_COLS)
    + f" FROM t3_train GROUP BY {LABEL}"))(
    lambda spark, d: D.group_means(train_t3(spark, d), LABEL, TIER_MEAN_COLS, 2))

BASELINE = [f for f in T3_FEATURES if f.startswith("age30_")]


def _unpivot_sql(cols, src="t3_train", ids=()) -> str:
    sel = ", ".join([*ids, *[f"CAST({c} AS DOUBLE) AS {c}" for c in cols]])
    return f"(UNPIVOT (SELECT {sel} FROM {src}) ON {', '.join(cols)} INTO NAME feature VALUE value)"


def _unpivot_nulls_sql(cols, src="t3_train", ids=(), name="feature") -> str:
    sel = ", ".join([*ids, *[f"CAST({c} AS DOUBLE) AS {c}" for c in cols]])
    return (f"(SELECT * FROM (SELECT {sel} FROM {src}) UNPIVOT INCLUDE NULLS "
            f"(value FOR {name} IN ({', '.join(cols)})))")


query("feature_stats", O.sql(
    "SELECT feature, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS min, "
    f"max(value) AS max FROM {_unpivot_sql(BASELINE)} u GROUP BY feature"))(
    lambda spark, d: round6(D.feature_stats(train_t3(spark, d), BASELINE), ["mean", "std"]))

query("missingness", O.sql(
    "SELECT feature, avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) * 100 AS pct_missing "
    f"FROM {_unpivot_nulls_sql(T3_FEATURES)} u GROUP BY feature"))(
    lambda spark, d: D.missingness(train_t3(spark, d), T3_FEATURES))


def _corr(spark, d):
    r = D.feature_outcome_corr(train_t3(spark, d), T3_FEATURES, LABEL)
    return round6(r.withColumn("r", nan_to_null(F.col("r"))))


query("feature_outcome_corr", O.sql(
    "SELECT feature, round(CASE WHEN isnan(r) THEN NULL ELSE r END, 6) AS r FROM ("
    f"SELECT feature, corr(value, CAST({LABEL} AS DOUBLE)) AS r FROM "
    f"{_unpivot_nulls_sql(T3_FEATURES, ids=(LABEL,))} u GROUP BY feature) x"))(_corr)

TRAJ_STATS = ["usg", "par", "bpm"]
query("trajectory", O.sql(
    "SELECT name, age, stat, value FROM " + _unpivot_nulls_sql(
        TRAJ_STATS, "(SELECT * FROM t3_clean WHERE age IN (30, 31, 32, 33))", ("name", "age"), "stat") + " u"))(
    lambda spark, d: D.trajectory(clean_t3(spark, d), S, (30, 31, 32, 33), TRAJ_STATS))

query("trajectory_wide", O.sql(
    "SELECT name, stat, " + ", ".join(f"arg_max_null(value, period) FILTER (WHERE age = {a}) AS age_{a}"
                                      for a in (30, 31, 32, 33))
    + " FROM " + _unpivot_nulls_sql(TRAJ_STATS, "(SELECT * FROM t3_clean WHERE age IN (30, 31, 32, 33))",
                                    ("name", "age", "period"), "stat") + " u GROUP BY name, stat"))(
    lambda spark, d: D.trajectory_wide(clean_t3(spark, d), S, (30, 31, 32, 33), TRAJ_STATS))

CASE_NAMES = ["Customer#000000001", "Customer#000000011", "Customer#000000101", "Customer#000000211",
              "Customer#000001001"]
query("case_table", esql(
    "SELECT name, label, pred, p2, label = pred AS correct FROM sc2 WHERE name IN ("
    + ", ".join(f"'{n}'" for n in CASE_NAMES) + ")"))(
    lambda spark, d: D.case_table(scored(spark, d).withColumn("correct", F.col("label") == F.col("pred")),
                                  "name", CASE_NAMES, ["label", "pred", "p2", "correct"]))

IMP_CTE = (f"ci AS (SELECT feature, abs(corr(value, CAST({LABEL} AS DOUBLE))) AS a FROM "
           f"{_unpivot_nulls_sql(T3_FEATURES, ids=(LABEL,))} u GROUP BY feature),\n"
           "imp AS (SELECT feature, CASE WHEN a IS NULL OR isnan(a) THEN 0.0 ELSE a END / "
           "sum(CASE WHEN a IS NULL OR isnan(a) THEN 0.0 ELSE a END) OVER () AS importance FROM ci)")


def isql(select: str) -> str:
    return O.sql("SELECT 1").rsplit("\nSELECT 1", 1)[0] + ",\n" + IMP_CTE + "\n" + select


def importance(spark, d) -> DataFrame:
    return X.correlation_importance(cohort_t3(spark, d), T3_FEATURES, LABEL)


query("top_features", isql("SELECT feature, round(importance, 6) AS importance FROM imp "
                           "ORDER BY round(importance, 10) DESC, feature LIMIT 10"))(
    lambda spark, d: round6(D.top_n(importance(spark, d), "importance", 10, "feature")))

query("tier_change_means", O.sql(
    f"SELECT {LABEL}, round(avg(total_par_change), 6) AS total_par_change FROM t3_train GROUP BY {LABEL}"))(
    lambda spark, d: round6(D.group_means(train_t3(spark, d), LABEL, ["total_par_change"])))

# ------------------------------------------------ importance / explain --
query("importance_table", isql(
    "SELECT feature, round(importance, 6) AS importance, round(importance * 100, 6) AS importance_pct, "
    "round(sum(importance * 100) OVER (ORDER BY round(importance, 10) DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND CURRENT ROW), 6) AS cumulative_pct, CAST(row_number() OVER (ORDER BY round(importance, 10) DESC, feature) "
    "AS INT) AS rank FROM imp"))(
    lambda spark, d: round6(X.importance_table(importance(spark, d))))

_CATS = ", ".join(f"('{f.name}', '{f.category}')" for f in FE.features(T3))
query("importance_by_category", isql(
    f"SELECT s.category, round(sum(i.importance), 6) AS importance, round(sum(i.importance) * 100, 6) AS importance_pct "
    f"FROM imp i JOIN (VALUES {_CATS}) s(feature, category) ON s.feature = i.feature GROUP BY s.category"))(
    lambda spark, d: round6(X.importance_by_category(importance(spark, d), FE.feature_schema(spark, T3))))

query("confidence_band", esql(
    f"SELECT name, {O.bands_sql('greatest(p0, p1, p2)', FXV.CONFIDENCE_BANDS, FXV.CONFIDENCE_ELSE)} AS confidence "
    "FROM sc2"))(
    lambda spark, d: X.with_confidence(scored(spark, d), PROBS).select("name", "confidence"))


def contributions(spark, d) -> DataFrame:
    t = cohort_t3(spark, d)
    ref = X.feature_reference_stats(t, T3_FEATURES)
    return X.contributions(t, ref, importance(spark, d), T3_FEATURES, "name")


CONTRIB_CTE = (f"rs AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_samp(value) IS NULL OR "
               f"isnan(stddev_samp(value)) OR stddev_samp(value) <= 0 THEN 1.0 ELSE stddev_samp(value) END AS std "
               f"FROM {_unpivot_sql(T3_FEATURES)} u GROUP BY feature),\n"
               f"ct AS (SELECT u.name, u.feature, u.value, r.mean, (u.value - r.mean) / r.std AS z, "
               f"coalesce(i.importance, 0.0) * ((u.value - r.mean) / r.std) * 100 AS contribution "
               f"FROM {_unpivot_sql(T3_FEATURES, ids=('name',))} u JOIN rs r ON r.feature = u.feature "
               f"LEFT JOIN imp i ON i.feature = u.feature)")


def csql(select: str) -> str:
    return isql("").rstrip() + ",\n" + CONTRIB_CTE + "\n" + select


def _contrib_query(spark, d):
    c = contributions(spark, d)
    # the one averaged feature depends on summation order: rounded like z
    value = F.when(F.col("feature") == T3.career_mean[1], F.round("value", 6)).otherwise(F.col("value"))
    return round6(c.select("name", "feature", value.alias("value"), "z", "contribution"), ["z", "contribution"])


query("contributions", csql(
    f"SELECT name, feature, CASE WHEN feature = '{T3.career_mean[1]}' THEN round(value, 6) ELSE value END AS value, "
    "round(z, 6) AS z, round(contribution, 6) AS contribution FROM ct"))(_contrib_query)

query("top_factors", csql(
    "SELECT name, sign, rank, feature, round(contribution, 6) AS contribution FROM (SELECT name, feature, "
    "contribution, CASE WHEN contribution > 0 THEN 'positive' ELSE 'negative' END AS sign, CAST(row_number() OVER "
    "(PARTITION BY name, contribution > 0 ORDER BY round(abs(contribution), 10) DESC, feature) AS INT) AS rank FROM ct "
    "WHERE contribution <> 0) x WHERE rank <= 5"))(
    lambda spark, d: round6(X.top_factors(contributions(spark, d), "name", 5)
                            .select("name", "sign", "rank", "feature", "contribution"), ["contribution"]))


def _schema_df(spark):
    return FE.feature_schema(spark, T3)


def _describe(spark, d):
    c = contributions(spark, d).join(F.broadcast(_schema_df(spark)), "feature")
    text = X.describe_factor(F.col("category"), F.col("feature"), F.col("stat"), F.col("age"), F.col("value"),
                             F.col("mean"), F.col("z"), T3.baseline_age, T3.career_high[1], T3.career_mean[1],
                             T3.seasons_name.format(age=T3.baseline_age))
    return c.select("name", "feature", text.alias("description"))


def _fx(x: str, d: int) -> str:
    sc = f"CAST({10 ** d} AS DOUBLE)"
    r = f"(CASE WHEN abs({x}) * {sc} < 9.0e15 THEN floor(abs({x}) * {sc} + 0.5) / {sc} ELSE abs({x}) END)"
    return f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST(CAST({r} AS DECIMAL(38, {d})) AS VARCHAR))"


def describe_parts() -> tuple[str, str]:
    """(sentence expression over ct + schema, schema VALUES list) for SQL twins,
    rendered from the same templates as the Spark operator."""
    from .. import fixed as FX
    from ..functions.text import render_sql
    sch = ", ".join(f"('{f.name}', '{f.category}', '{f.stat or ''}', {f.age})" for f in FE.features(T3))
    mag = "CASE " + " ".join(f"WHEN abs(z) > {lim} THEN '{w}'" for lim, w in FX.MAGNITUDES) + \
        f" ELSE '{FX.MAGNITUDE_ELSE}' END"
    b = T3.baseline_age
    parts = {
        "stat": "stat", "base": f"'{b}'", "age": "CAST(age AS VARCHAR)", "feature": "feature", "magnitude": mag,
        "direction": f"CASE WHEN z > 0 THEN '{FX.ABOVE}' ELSE '{FX.BELOW}' END",
        "change": f"CASE WHEN value > 0 THEN '{FX.INCREASED}' ELSE '{FX.DECREASED}' END",
        "value1": _fx("value", 1), "value2": _fx("value", 2), "value3": _fx("value", 3),
        "abs2": _fx("abs(value)", 2), "abs3": _fx("abs(value)", 3), "mean2": _fx("mean", 2),
        "int": "CAST(CAST(value AS BIGINT) AS VARCHAR)",
        "signed1": "(CASE WHEN value < 0 THEN '-' ELSE '+' END || " + _fx("abs(value)", 1) + ")",
    }

    def r(key):
        return render_sql(FX.TEMPLATES[key], **parts)
    expr = (f"CASE WHEN category = 'baseline' THEN {r('baseline')} WHEN category = 'delta' THEN {r('delta')} "
            f"WHEN starts_with(feature, 'total_') THEN {r('total')} WHEN category = 'trend' THEN {r('velocity')} "
            f"WHEN feature = 'seasons_at_{b}' THEN {r('seasons')} "
            f"WHEN feature = '{T3.career_high[1]}' THEN {r('high')} "
            f"WHEN feature = '{T3.career_mean[1]}' THEN {r('mean')} ELSE {r('other')} END")
    return expr, sch


def _describe_sql() -> str:
    expr, sch = describe_parts()
    return csql(f"SELECT name, feature, {expr} AS description FROM ct c JOIN (VALUES {sch}) "
                f"s(feature, category, stat, age) USING (feature)")


query("describe_factor", _describe_sql())(_describe)


def _bn_scored(spark, d):
    t = train_bn(spark, d)
    p = F.col("mp_age28") / (F.col("mp_age28") + 150)
    return t.select("name", p.alias("probability"), (p >= 0.5).alias("prediction"),
                    "par_delta_age29", "ast_delta_age29", "usg_delta_age29")


query("risk_band", O.sql(
    "SELECT name, mp_age28 / (mp_age28 + 150) AS probability, mp_age28 / (mp_age28 + 150) >= 0.5 AS prediction, "
    f"{O.bands_sql('mp_age28 / (mp_age28 + 150)', FXV.RISK_BANDS, FXV.RISK_ELSE)} AS risk_level FROM bn_train"))(
    lambda spark, d: X.with_risk(_bn_scored(spark, d), "probability").select(
        "name", "probability", "prediction", "risk_level"))

_SIG = O.signal_sql("{c}")
query("signal_direction", O.sql(
    "SELECT name, " + ", ".join(f"{_SIG.format(c=f'{s}_delta_age29')} AS signal_{s}" for s in ("par", "ast", "usg"))
    + " FROM bn_train"))(
    lambda spark, d: X.with_signals(_bn_scored(spark, d), {s: f"{s}_delta_age29" for s in ("par", "ast", "usg")})
    .select("name", *[F.col("signals")[s].alias(f"signal_{s}") for s in ("par", "ast", "usg")]))


# ------------------------------------------------- right-censoring flag --
def _observable(spark, d):
    from ..operators.labels import outcome_labels, with_observability
    from .catalog import clean_bn
    from ..operators import features as FE2
    c = clean_bn(spark, d)
    prof = FE2.entity_profile(c, BN).filter(F.col("_n_elig") > 0).select(
        "name", F.col("_b").getField("period").alias("baseline_period"))
    lab = outcome_labels(c, BN)
    return with_observability(prof.join(lab, "name"), c, BN)


query("outcome_observable", O.sql(
    f"SELECT b.name, b.period AS baseline_period, o.{BN.label_col}, "
    f"b.period + {BN.outcome_age - BN.baseline_age} <= (SELECT max(period) FROM bn_clean2) AS observable "
    f"FROM bn_a{BN.baseline_age} b JOIN bn_elig e ON e.name = b.name JOIN bn_out o ON o.name = b.name"))(_observable)
