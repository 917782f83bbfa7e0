"""Registered queries: one per operator of the inventory.

Every query reads the test tables through the fixture builders (or data Spark
derives from them) and runs the library's operators over the whole input.
``QUERIES[name](spark, sf_dir)`` returns a DataFrame; ``ORACLE[name]`` (when
the operator is SQL-expressible) is the DuckDB twin over the same tables.
Floating point results are rounded to 6 decimals at the edge, in both.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import round6
from ..operators import clean as C
from ..operators import cohort as K
from ..operators import features as FE
from ..operators import labels as L
from ..session import materialize
from ..sources import fixtures as fx
from ..sources import readers as R
from ..spec import FIXTURE_BINARY as BN
from ..spec import FIXTURE_TIER3 as T3
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_SHARED: ContextVar[dict | None] = ContextVar("shared", default=None)


def shared(d, what: str, make):
    """A table that several steps of one query read: made once a call, and gone with it."""
    kept = _SHARED.get()
    if kept is None:
        return make()
    if (str(d), what) not in kept:
        kept[str(d), what] = make()
    return kept[str(d), what]


def _call(fn):
    @wraps(fn)
    def run(spark, d):
        token = _SHARED.set({})
        try:
            return fn(spark, d)
        finally:
            _SHARED.reset(token)
    return run


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = _call(fn)
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- inputs --
def raw(spark, d) -> DataFrame:
    return fx.panel(spark, d, "panel_raw")


def clean_t3(spark, d) -> DataFrame:
    return C.clean_panel(raw(spark, d), T3)


def clean_bn(spark, d) -> DataFrame:
    return C.clean_panel(raw(spark, d), BN)


def train_t3(spark, d) -> DataFrame:
    return FE.training_dataset(clean_t3(spark, d), T3)


def train_bn(spark, d) -> DataFrame:
    return FE.training_dataset(clean_bn(spark, d), BN)


def cohort_t3(spark, d) -> DataFrame:
    """The cohort's table for a query that reads it several times: the panel chain runs once."""
    return shared(d, "t3", lambda: materialize(train_t3(spark, d)))


def cohort_bn(spark, d) -> DataFrame:
    return shared(d, "bn", lambda: materialize(train_bn(spark, d)))


S = T3.panel
PANEL_COLS = ["name", "entity", "period", "age", "pos", "seg", "mp", "usg", "ast", "par", "ts",
              "per", "bpm", "ws48", "g"]
T3_FEATURES = FE.feature_names(T3)
AVG_COLS = [T3.career_mean[1]]  # the only feature that is an average of doubles
BN_FEATURES = FE.feature_names(BN)


def _cols(prefix_filter):
    return [f for f in T3_FEATURES if prefix_filter(f)]


def _q_features(cols: list[str]):
    def run(spark, d):
        return round6(train_t3(spark, d).select("name", *cols), AVG_COLS)
    return run


def _sql_features(cols: list[str], table: str = "t3_train") -> str:
    return O.sql(f"SELECT name, {O.feature_cols(cols)} FROM {table}")


# ------------------------------------------------- projection / clean-up --
query("clean_names", O.sql(f"SELECT entity, period, seg, {O.CLEAN_NAME} AS name FROM panel_raw"))(
    lambda spark, d: C.clean_names(raw(spark, d), "name").select("entity", "period", "seg", "name"))

query("coerce_numeric", O.sql(
    f"SELECT entity, period, seg, {O.num('mp')} AS mp, {O.num('usg')} AS usg FROM panel_raw"))(
    lambda spark, d: C.coerce_numeric(raw(spark, d), S.numeric).select("entity", "period", "seg", "mp", "usg"))

query("filter_period_range", O.sql(
    "SELECT entity, period, seg, mp FROM panel WHERE period BETWEEN 0 AND 12"))(
    lambda spark, d: C.filter_period_range(fx.panel(spark, d), S, 0, 12)
    .select("entity", "period", "seg", "mp"))

query("filter_min_weight", O.sql(
    f"SELECT entity, period, seg, mp FROM panel WHERE mp >= {T3.min_weight}"))(
    lambda spark, d: C.filter_min_weight(fx.panel(spark, d), S, T3.min_weight)
    .select("entity", "period", "seg", "mp"))

query("drop_incomplete", O.sql(
    "SELECT entity, period, seg, mp, usg "
    "FROM (SELECT " + O.COERCED_COLS + " FROM panel_raw) x WHERE mp IS NOT NULL AND usg IS NOT NULL"))(
    lambda spark, d: C.drop_incomplete(C.coerce_numeric(raw(spark, d), S.numeric), ["mp", "usg"])
    .select("entity", "period", "seg", "mp", "usg"))

query("dedupe_total_else_max", O.sql(
    "SELECT name, period, seg, mp FROM ("
    "SELECT *, row_number() OVER (PARTITION BY name, period ORDER BY "
    "CASE WHEN seg = 'TOT' THEN 0 ELSE 1 END, mp DESC NULLS LAST, seg) AS rn "
    "FROM (SELECT name, " + O.COERCED_COLS + " FROM panel_raw) c) r WHERE rn = 1"))(
    lambda spark, d: C.dedupe_total_else_max(C.coerce_numeric(raw(spark, d), S.numeric), S)
    .select("name", "period", "seg", "mp"))

query("dedupe_total_else_first", O.sql(
    "SELECT name, period, seg FROM bn_ranked WHERE rn = 1"))(
    lambda spark, d: C.dedupe_total_else_first(raw(spark, d), S).select("name", "period", "seg"))

query("clean_panel", O.sql(
    f"SELECT {', '.join(PANEL_COLS)} FROM t3_clean"))(
    lambda spark, d: clean_t3(spark, d).select(*PANEL_COLS))

query("clean_panel_binary", O.sql(
    f"SELECT {', '.join(PANEL_COLS)} FROM bn_clean2"))(
    lambda spark, d: clean_bn(spark, d).select(*PANEL_COLS))

HISTORY_ENTITY = "Customer#000000001"
query("entity_history", O.sql(
    f"SELECT name, period, age, mp, usg, bpm FROM t3_clean WHERE name = '{HISTORY_ENTITY}'"))(
    lambda spark, d: C.entity_history(clean_t3(spark, d), S, HISTORY_ENTITY)
    .select("name", "period", "age", "mp", "usg", "bpm"))


def _search_sql(text: str) -> str:
    return O.sql(
        "SELECT match, is_exact FROM (SELECT match, match = '" + text + "' AS is_exact FROM "
        "(SELECT DISTINCT name AS match FROM t3_clean WHERE contains(lower(name), lower('" + text + "'))) h "
        "ORDER BY is_exact DESC, match LIMIT 5) t WHERE is_exact OR NOT EXISTS "
        "(SELECT 1 FROM (SELECT DISTINCT name FROM t3_clean) z WHERE z.name = '" + text + "')")


for _key, _text in (("entity_search", "customer#0000001"), ("entity_search_exact", HISTORY_ENTITY)):
    query(_key, _search_sql(_text))(
        (lambda t: lambda spark, d: C.entity_search(clean_t3(spark, d), "name", t))(_text))

query("entity_list", O.sql(
    f"SELECT name, adaptability_tier, n_rows, {O.tier_label_sql('adaptability_tier')} AS adaptability_tier_label FROM ("
    "SELECT name, min(adaptability_tier) AS adaptability_tier, count(*) AS n_rows FROM t3_train GROUP BY name) x"))(
    lambda spark, d: C.entity_list(train_t3(spark, d), "name", T3.label_col))

query("select_feature_columns", O.sql(f"SELECT {O.feature_cols(T3_FEATURES)} FROM t3_train"))(
    lambda spark, d: round6(C.select_feature_columns(train_t3(spark, d), ["name", T3.label_col]), AVG_COLS))

# ------------------------------------------------------------ cohort --
query("eligible_cohort", O.sql("SELECT name, period FROM t3_elig"))(
    lambda spark, d: K.eligible_cohort(clean_t3(spark, d), T3))

query("eligible_cohort_binary", O.sql("SELECT name FROM bn_elig"))(
    lambda spark, d: K.eligible_cohort(clean_bn(spark, d), BN))


def _restrict(spark, d):
    c = clean_t3(spark, d)
    return K.cohort_restrict(c, K.eligible_cohort(c, T3), T3).select("name", "period", "age", "mp")


query("cohort_restrict", O.sql(
    "SELECT name, period, age, mp FROM t3_clean WHERE name IN (SELECT name FROM t3_elig)"))(
    _restrict)

# ---------------------------------------------------------- features --
STAT_COLS = list(S.stats)


def _row_at(clean_fn, preset, age, pick):
    def run(spark, d):
        c = clean_fn(spark, d)
        r = (c.groupBy(preset.panel.entity).agg(FE.season_at_age(preset, age, pick).alias("r"))
              .filter(F.col("r").isNotNull()).select(preset.panel.entity, "r.*"))
        return r.select("name", "period", *preset.panel.stats)
    return run


query("row_at_age_latest", O.sql(f"SELECT name, period, {', '.join(T3.panel.stats)} FROM t3_a30"))(
    _row_at(clean_t3, T3, 30, "latest"))
query("row_at_age_earliest", O.sql(f"SELECT name, period, {', '.join(BN.panel.stats)} FROM bn_a28"))(
    _row_at(clean_bn, BN, 28, "earliest"))

_FAMILIES = {
    "baseline": _cols(lambda f: f.startswith("age30_")),
    "deltas": _cols(lambda f: f.startswith("delta_")),
    "seasons_to_baseline": ["seasons_at_30"],
    "career_high": ["career_high_usg"],
    "career_mean": ["career_avg_bpm"],
    "position_code": ["position_code"],
    "total_change": _cols(lambda f: f.startswith("total_")),
    "velocity": _cols(lambda f: f.startswith("adaptation_velocity_")),
    "feature_row": T3_FEATURES,
}
for _key, _c in _FAMILIES.items():
    query(_key, _sql_features(_c))(_q_features(_c))

query("training_dataset", O.sql(
    f"SELECT {O.feature_cols(T3_FEATURES)}, name, adaptability_tier FROM t3_train"))(
    lambda spark, d: round6(train_t3(spark, d), AVG_COLS))

_BN_BASE = [f for f in BN_FEATURES if f.endswith("_age28")]
_BN_DELTA = [f for f in BN_FEATURES if "_delta_age" in f]
query("baseline_binary", O.sql(f"SELECT name, {', '.join(_BN_BASE)} FROM bn_train"))(
    lambda spark, d: train_bn(spark, d).select("name", *_BN_BASE))
query("deltas_binary", O.sql(f"SELECT name, {', '.join(_BN_DELTA)} FROM bn_train"))(
    lambda spark, d: train_bn(spark, d).select("name", *_BN_DELTA))
query("training_dataset_binary", O.sql(
    f"SELECT {', '.join(BN_FEATURES)}, name, played_to_35 FROM bn_train"))(
    lambda spark, d: train_bn(spark, d))


def _feature_schema(spark, d):
    t = train_t3(spark, d)
    longf = t.select("name", *[F.col(c).cast("double").alias(c) for c in T3_FEATURES]).unpivot(
        "name", T3_FEATURES, "feature", "value")
    counts = longf.groupBy("feature").agg(F.count("value").alias("n_nonnull"))
    schema = FE.feature_schema(spark, T3)  # one row per feature: bounded by the feature count
    return (schema.join(F.broadcast(counts), "feature", "left")
                  .select("position", "feature", "category", F.coalesce("n_nonnull", F.lit(0)).alias("n_nonnull")))


_SCHEMA_VALUES = ", ".join(f"({i + 1}, '{f.name}', '{f.category}')" for i, f in enumerate(FE.features(T3)))
query("feature_schema", O.sql(
    f"SELECT s.position, s.feature, s.category, coalesce(c.n, 0) AS n_nonnull "
    f"FROM (VALUES {_SCHEMA_VALUES}) s(position, feature, category) LEFT JOIN "
    f"(SELECT feature, count(value) AS n FROM (UNPIVOT (SELECT name, {', '.join(T3_FEATURES)} FROM t3_train) "
    f"ON {', '.join(T3_FEATURES)} INTO NAME feature VALUE value) u GROUP BY feature) c "
    f"ON c.feature = s.feature"))(_feature_schema)

# what-if rows built from the cohort's own baseline and 30->33 change
SCENARIO_CHANGED = ("usg", "ast", "par", "ts", "bpm", "mp")
SCENARIO_RANGES = {"age30_usg": (0.0, 50.0), "age30_mp": (60.0, 3000.0), "age30_ts": (0.85, 1.0)}


def _scenarios(spark, d):
    t = train_t3(spark, d)
    cols = [F.col("name").alias("scenario")]
    cols += [F.col(f"age30_{s}").alias(f"base_{s}") for s in S.stats]
    cols += [F.coalesce(F.col(f"delta_{s}_33"), F.lit(0.0)).alias(f"change_{s}") for s in SCENARIO_CHANGED]
    cols += [F.col("seasons_at_30").alias("seasons"),
             F.coalesce(F.col("career_high_usg"), F.col("age30_usg")).alias("career_high")]
    return FE.scenario_features(t.select(*cols), T3, SCENARIO_CHANGED, SCENARIO_RANGES)


def _scenario_sql() -> str:
    ch = {s: f"coalesce(delta_{s}_33, 0.0)" for s in SCENARIO_CHANGED}
    parts = ["name AS scenario"]
    for s in S.stats:
        parts.append(f"age30_{s}")
    for a, (times, by) in zip(T3.delta_ages, ((1, 3), (2, 3), (1, 1))):
        for s in S.stats:
            e = f"CAST({ch[s]} AS DOUBLE) * {times} / {by}" if s in ch else "0.0"
            parts.append(f"{e} AS delta_{s}_{a}")
    parts += ["CAST(seasons_at_30 AS INT) AS seasons_at_30",
              "coalesce(career_high_usg, age30_usg) AS career_high_usg",
              "age30_bpm * 0.8 AS career_avg_bpm", "3 AS position_code"]
    for s in T3.trend_stats:
        parts.append(f"{ch[s]} AS total_{s}_change")
    for s, n in T3.velocity:
        parts.append(f"{ch[s]} / 3 AS {n}")
    valid = " AND ".join(f"age30_{k[6:]} BETWEEN {lo} AND {hi}" for k, (lo, hi) in SCENARIO_RANGES.items())
    parts.append(f"({valid}) AS valid")
    return O.sql("SELECT " + ", ".join(parts) + " FROM t3_train")


query("scenario_features", _scenario_sql())(_scenarios)


def _request_sql() -> str:
    cols = ["entity"]
    for s in BN.panel.stats:
        cols.append(f"CAST(json_extract(request, '$.age_28.{s}') AS DOUBLE) AS {s}_age28")
    for a in BN.delta_ages:
        for s in BN.panel.stats:
            cols.append(f"CAST(json_extract(request, '$.age_{a}.{s}') AS DOUBLE) - "
                        f"CAST(json_extract(request, '$.age_28.{s}') AS DOUBLE) AS {s}_delta_age{a}")
    return O.sql("SELECT " + ", ".join(cols) + " FROM requests")


query("request_features", _request_sql())(
    lambda spark, d: FE.request_features(fx.requests(spark, d), BN))

query("parse_requests", O.sql(
    "SELECT entity, k1.key AS age_key, k2.key AS stat, CAST(k2.value AS DOUBLE) AS value "
    "FROM requests, json_each(request) k1, json_each(k1.value) k2"))(
    lambda spark, d: R.request_values(fx.requests(spark, d)))


def mixed_requests(spark, d) -> DataFrame:
    """The requests, some of them broken, in a way that the entity's number tells."""
    e, text = F.col("entity"), F.col("request")
    broken = (F.when(e % 11 == 1, F.lit(None)).when(e % 11 == 2, F.expr("substr(request, 1, length(request) - 3)"))
              .when(e % 11 == 3, F.lit("[1, 2]")).when(e % 11 == 4, F.replace(text, F.lit('"mp": '), F.lit('"mp": "x", "old": ')))
              .when(e % 11 == 5, F.lit("{}")).when(e % 11 == 6, F.lit('{"age_28": 7}')).otherwise(text))
    return fx.requests(spark, d).withColumn("request", broken)


def _requests_checked(spark, d) -> DataFrame:
    good, rejected = R.split_requests(mixed_requests(spark, d))
    return good.select("entity", F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("entity", "reason"))


_REASONS = " ".join(f"WHEN entity % 11 IN ({codes}) THEN '{reason}'" for codes, reason in (
    ("1", R.NO_REQUEST), ("2, 3, 6", R.MALFORMED), ("4", R.NOT_A_NUMBER), ("5", R.EMPTY)))
query("requests_checked", O.sql(f"SELECT entity, CASE {_REASONS} END AS reason FROM requests"))(_requests_checked)
query("parse_requests_mixed", O.sql(
    "SELECT entity, k1.key AS age_key, k2.key AS stat, CAST(k2.value AS DOUBLE) AS value "
    "FROM (SELECT * FROM requests WHERE entity % 11 NOT BETWEEN 1 AND 6) r, json_each(request) k1, json_each(k1.value) k2"))(
    lambda spark, d: R.request_values(mixed_requests(spark, d)))

# ------------------------------------------------------------ labels --
query("outcome_tier", O.sql("SELECT name, adaptability_tier FROM t3_tier"))(
    lambda spark, d: L.outcome_labels(clean_t3(spark, d), T3))
query("outcome_reached", O.sql("SELECT name, played_to_35 FROM bn_out"))(
    lambda spark, d: L.outcome_labels(clean_bn(spark, d), BN))
query("tier_names", O.sql(
    f"SELECT name, adaptability_tier, {O.tier_label_sql('adaptability_tier')} AS adaptability_tier_label, "
    f"{O.tier_description_sql('adaptability_tier')} AS adaptability_tier_description FROM t3_train"))(
    lambda spark, d: L.tier_names(train_t3(spark, d).select("name", T3.label_col), T3.label_col))


# further registrations (they import the helpers above)
from . import catalog_eval  # noqa: E402,F401
from . import catalog_ml  # noqa: E402,F401
from . import catalog_stream  # noqa: E402,F401
from . import catalog_stump  # noqa: E402,F401
