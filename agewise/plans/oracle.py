"""DuckDB twins of the registered queries (the correctness gate).

The SQL is an independent formulation of each operator (window ranking for
the de-duplication, self-joins per age for the feature row, FILTER clauses for
the context aggregates), generated from the same preset parameters.  Every
statement starts from the driver's pre-registered views.
"""

from __future__ import annotations

from ..functions.columns import NUMERIC_PATTERN
from ..sources.fixtures import fixture_cte
from ..spec import FIXTURE_BINARY, FIXTURE_TIER3, CohortPreset, clean_stat_name

T3 = FIXTURE_TIER3
BN = FIXTURE_BINARY


def num(col: str) -> str:
    v = (f"(CASE WHEN regexp_full_match({col}, '{NUMERIC_PATTERN}') "
         f"THEN TRY_CAST(trim({col}) AS DOUBLE) END)")
    return f"(CASE WHEN isnan({v}) THEN NULL ELSE {v} END)"


def dbl(col: str) -> str:
    return f"(CASE WHEN isnan({col}) THEN NULL ELSE CAST({col} AS DOUBLE) END)"


CLEAN_NAME = "regexp_replace(regexp_replace(name, '\\*', '', 'g'), '^\\s+|\\s+$', '', 'g')"

# panel_raw after the numeric coercion (string columns mp and usg)
COERCED_COLS = (f"entity, period, age, pos, seg, {num('mp')} AS mp, {num('usg')} AS usg, "
                f"{dbl('ast')} AS ast, {dbl('par')} AS par, {dbl('ts')} AS ts, {dbl('per')} AS per, "
                f"{dbl('bpm')} AS bpm, {dbl('ws48')} AS ws48, g")


def _pos_sql(col: str, preset: CohortPreset) -> str:
    whens = " ".join(f"WHEN contains({col}, '{t}') THEN {c}" for t, c in preset.position_rules)
    return f"CAST(CASE WHEN {col} IS NULL THEN NULL {whens} ELSE {preset.position_default} END AS INT)"


def _at_ages(prefix: str, clean: str, preset: CohortPreset) -> str:
    order = "DESC" if preset.pick == "latest" else "ASC"
    parts = [f"{prefix}_at AS (SELECT *, row_number() OVER (PARTITION BY name, age "
             f"ORDER BY period {order}) AS k FROM {clean})"]
    for a in (preset.baseline_age, *preset.delta_ages):
        parts.append(f"{prefix}_a{a} AS (SELECT * FROM {prefix}_at WHERE age = {a} AND k = 1)")
    return ",\n".join(parts)


def _feature_select(prefix: str, preset: CohortPreset) -> list[str]:
    base = preset.baseline_age
    stats = preset.panel.stats
    cols = []
    for s in stats:
        cols.append(f"b.{s} AS " + preset.baseline_fmt.format(stat=clean_stat_name(s), raw=s, age=base))
    for a in preset.delta_ages:
        for s in stats:
            cols.append(f"a{a}.{s} - b.{s} AS "
                        + preset.delta_fmt.format(stat=clean_stat_name(s), raw=s, age=a))
    if preset.with_context:
        cols.append(f"c.seasons_at_{base}")
        cols.append(f"c.{preset.career_high[1]}")
        cols.append(f"c.{preset.career_mean[1]}")
        cols.append(_pos_sql("b.pos", preset) + " AS position_code")
        t = preset.delta_ages[-1]
        for s in preset.trend_stats:
            cols.append(f"a{t}.{s} - b.{s} AS total_{s}_change")
        for s, n in preset.velocity:
            cols.append(f"(a{t}.{s} - b.{s}) / {t - base} AS {n}")
    return cols


def _feature_joins(prefix: str, preset: CohortPreset) -> str:
    js = [f"LEFT JOIN {prefix}_a{preset.baseline_age} b ON b.name = e.name"]
    for a in preset.delta_ages:
        js.append(f"LEFT JOIN {prefix}_a{a} a{a} ON a{a}.name = e.name")
    return "\n".join(js)


def _tier_case(preset: CohortPreset) -> str:
    r = preset.tier_rule
    rate, imp, w = (f"coalesce(r_out, {r.missing_rate})", f"coalesce(i_out, {r.missing_impact})",
                    f"coalesce(w_out, {r.missing_weight})")
    return (f"CAST(CASE WHEN n_out < {r.mid_min_rows} THEN 0 "
            f"WHEN n_out >= {r.top_min_rows} AND ({rate} >= {r.top_rate} OR {imp} >= {r.top_impact}) "
            f"AND {w} >= {r.top_weight} THEN 2 "
            f"WHEN n_out >= {r.mid_min_rows} AND ({rate} >= {r.mid_rate} OR {imp} >= {r.mid_impact}) "
            f"AND {w} >= {r.mid_weight} THEN 1 ELSE 0 END AS INT)")


def _ctes() -> str:
    t3, bn = T3, BN
    lo, hi = t3.period_range
    clo, chi = t3.cohort_periods
    blo, bhi = bn.cohort_periods
    r = t3.tier_rule
    base = t3.baseline_age
    return f""",
t3_coerced AS (
  SELECT {CLEAN_NAME} AS name, {COERCED_COLS} FROM panel_raw
),
t3_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name, period
         ORDER BY CASE WHEN seg = '{t3.panel.total_marker}' THEN 0 ELSE 1 END, mp DESC NULLS LAST, seg) AS rn
  FROM t3_coerced
),
t3_clean AS (
  SELECT * EXCLUDE (rn) FROM t3_ranked
  WHERE rn = 1 AND period BETWEEN {lo} AND {hi} AND mp >= {t3.min_weight}
    AND name IS NOT NULL AND period IS NOT NULL AND age IS NOT NULL AND mp IS NOT NULL
),
{_at_ages('t3', 't3_clean', t3)},
t3_ctx AS (
  SELECT name,
         CAST(count(*) FILTER (WHERE age <= {base}) AS INT) AS seasons_at_{base},
         max({t3.career_high[0]}) FILTER (WHERE age < {base}) AS {t3.career_high[1]},
         avg({t3.career_mean[0]}) FILTER (WHERE age < {base}) AS {t3.career_mean[1]},
         count(*) FILTER (WHERE age >= {r.outcome_age}) AS n_out,
         avg({r.rate_stat}) FILTER (WHERE age >= {r.outcome_age}) AS r_out,
         avg({r.impact_stat}) FILTER (WHERE age >= {r.outcome_age}) AS i_out,
         avg(mp) FILTER (WHERE age >= {r.outcome_age}) AS w_out
  FROM t3_clean GROUP BY name
),
t3_tier AS (SELECT name, {_tier_case(t3)} AS {t3.label_col} FROM t3_ctx),
t3_elig AS (
  SELECT DISTINCT name, period FROM t3_clean
  WHERE age = {base} AND mp >= {t3.min_weight} AND period BETWEEN {clo} AND {chi}
),
t3_train AS (
  SELECT {', '.join(_feature_select('t3', t3))}, e.name, t.{t3.label_col}
  FROM t3_elig e JOIN t3_ctx c ON c.name = e.name JOIN t3_tier t ON t.name = e.name
  {_feature_joins('t3', t3)}
),
bn_ranked AS (
  SELECT *, row_number() OVER (PARTITION BY name, period
         ORDER BY CASE WHEN seg = '{bn.panel.total_marker}' THEN 0 ELSE 1 END, seg) AS rn
  FROM panel_raw WHERE name IS NOT NULL AND period IS NOT NULL
),
bn_clean AS (
  SELECT name, {COERCED_COLS} FROM bn_ranked WHERE rn = 1
),
bn_clean2 AS (SELECT * FROM bn_clean WHERE mp >= {bn.min_weight}),
{_at_ages('bn', 'bn_clean2', bn)},
bn_elig AS (
  SELECT DISTINCT name FROM bn_clean2 WHERE age = {bn.baseline_age} AND period BETWEEN {blo} AND {bhi}
),
bn_out AS (
  SELECT name, CAST(max(CASE WHEN age >= {bn.outcome_age} THEN 1 ELSE 0 END) AS INT) AS {bn.label_col}
  FROM bn_clean2 GROUP BY name
),
bn_train AS (
  SELECT {', '.join(_feature_select('bn', bn))}, e.name, o.{bn.label_col}
  FROM bn_elig e JOIN bn_out o ON o.name = e.name
  {_feature_joins('bn', bn)}
)
"""


def sql(select: str) -> str:
    """Full DuckDB statement: fixture CTEs + operator CTEs + ``select``."""
    return "WITH " + fixture_cte() + _ctes() + "\n" + select


def r6(expr: str, alias: str | None = None) -> str:
    return f"round({expr}, 6) AS {alias or expr.split('.')[-1]}"


def round_cols(cols, prefix: str = "") -> str:
    return ", ".join(r6(f"{prefix}{c}", c) for c in cols)


AVG_FEATURES = {T3.career_mean[1]}


def feature_cols(cols, prefix: str = "") -> str:
    """Feature columns, rounding only those that are averages of doubles."""
    return ", ".join(r6(f"{prefix}{c}", c) if c in AVG_FEATURES else f"{prefix}{c}" for c in cols)


# --- SQL forms of the fixed words (agewise.fixed), for the twins -------------
def _case_map(col: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items())
    return f"CASE {col} {whens} ELSE 'Unknown' END"


def tier_label_sql(col: str) -> str:
    from .. import fixed as FX
    return _case_map(col, FX.TIER_LABELS)


def tier_description_sql(col: str) -> str:
    from .. import fixed as FX
    return _case_map(col, FX.TIER_DESCRIPTIONS)


def bands_sql(x: str, bands, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {lim} THEN '{w}'" for lim, w in bands) + f" ELSE '{otherwise}' END"


def signal_sql(c: str) -> str:
    from .. import fixed as FX
    return (f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '{FX.SIGNAL_FLAT}' WHEN {c} > 0 THEN '{FX.SIGNAL_UP}' "
            f"WHEN {c} < 0 THEN '{FX.SIGNAL_DOWN}' ELSE '{FX.SIGNAL_FLAT}' END")
