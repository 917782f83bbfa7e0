"""Forests with a closed form: one tree, no bootstrap, all features, one split, integer features.

Such a tree's split is the midpoint of two neighbouring values with the largest weighted Gini gain, its
leaves are weighted class shares, and its importances are one for the split's feature.  All of it can be said
in SQL, so the whole path (median imputation, balanced weights, fit, cross-validation, search, scores,
metrics) is checked against a twin.  Features have at most 31 different values, fewer than the forest's bins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed as FX
from .training import ForestConfig

STUMP = ForestConfig(n_trees=1, max_depth=1, min_leaf=FX.FOREST["min_leaf"], max_features="all", scale=False, bootstrap=False)
STUMP_BINARY = ForestConfig(n_trees=1, max_depth=1, min_leaf=FX.BINARY_FOREST["min_leaf"], max_features="all", scale=False, bootstrap=False)
#: Leaves small enough for a split on the smallest table: without one the balanced class shares are all equal, and
#: which class is predicted is left to rounding.
STUMP_GRID = {"n_trees": [1], "max_depth": [1], "min_leaf": [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], "max_features": ["all"]}

#: Integer features: name, source column, unit, least and largest value.
TIER3_STEPS = (("c_weight", "age30_mp", 20, 0, 30), ("c_change", "delta_mp_31", 20, -15, 15), ("c_late", "delta_mp_33", 20, -15, 15),
               ("c_seasons", "seasons_at_30", 1, 0, 30), ("c_position", "position_code", 1, 0, 5))
BINARY_STEPS = (("c_weight", "mp_age28", 20, 0, 30), ("c_change", "mp_delta_age29", 20, -15, 15), ("c_late", "mp_delta_age31", 20, -15, 15))


def names(steps) -> list[str]:
    return [s[0] for s in steps]


def stepped(table: DataFrame, steps) -> DataFrame:
    """Integer features beside a table's columns: the source in whole units, cut off at both ends; missing stays so."""
    out = {}
    for name, source, unit, low, high in steps:
        v = F.floor(F.col(source).cast("double") / unit)
        out[name] = F.when(F.col(source).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v))).cast("double")
    return table.withColumns(out)


def stepped_sql(steps) -> str:
    return ", ".join(f"CASE WHEN {source} IS NOT NULL THEN CAST(greatest({low}, least({high}, floor(CAST({source} AS DOUBLE) / {unit}))) AS DOUBLE) END AS {name}"
                     for name, source, unit, low, high in steps)


def fit_sql(rows: str, leaf: str, steps, k: int, p: str = "q") -> str:
    """CTEs of the trees of several fits at once: ``{p}_tree`` has a row each, ``{p}_out`` each row's class shares.

    ``rows`` selects (g, held, name, label, features): ``g`` tells fits apart, ``held`` rows are scored but not
    learnt from.  ``leaf`` gives the fewest rows of a leaf for ``g``."""
    each = " UNION ALL ".join(f"SELECT g, held, name, label, {i} AS f, {c} AS v FROM {p}_rows" for i, c in enumerate(names(steps)))
    cls = range(k)
    gini = lambda x: "(1 - (" + " + ".join(f"({x}{c} / ({'+'.join(f'{x}{i}' for i in cls)})) ** 2" for c in cls) + "))"
    total = lambda x: "(" + " + ".join(f"{x}{c}" for c in cls) + ")"
    first = lambda x: "CASE " + " ".join(f"WHEN {' AND '.join(f'{x}{c} >= {x}{i}' for i in cls)} THEN {c}" for c in cls) + " END"
    sums = lambda src, name: ", ".join(f"sum(CASE WHEN label = {c} THEN {src} ELSE 0 END) AS {name}{c}" for c in cls)
    run = lambda name: f"sum({name}) OVER (PARTITION BY g, f ORDER BY x)"
    return f"""{p}_rows AS ({rows}),
{p}_long AS ({each}),
{p}_med AS (SELECT g, f, (max(CASE WHEN r = (n - 1) // 2 THEN v END) + max(CASE WHEN r = n // 2 THEN v END)) / 2.0 AS med FROM (
  SELECT g, f, v, row_number() OVER (PARTITION BY g, f ORDER BY v) - 1 AS r, count(*) OVER (PARTITION BY g, f) AS n
  FROM {p}_long WHERE NOT held AND v IS NOT NULL) z GROUP BY g, f),
{p}_imp AS (SELECT l.g, l.held, l.name, l.label, l.f, coalesce(l.v, m.med) AS x FROM {p}_long l LEFT JOIN {p}_med m USING (g, f)),
{p}_cls AS (SELECT g, label, count(*) AS n_c FROM {p}_rows WHERE NOT held GROUP BY g, label),
{p}_w AS (SELECT g, label, sum(n_c) OVER (PARTITION BY g) / (count(*) OVER (PARTITION BY g) * n_c) AS w FROM {p}_cls),
{p}_at AS (SELECT i.g, f, x, count(*) AS n, {sums('w', 'w')} FROM {p}_imp i JOIN {p}_w USING (g, label) WHERE NOT held GROUP BY i.g, f, x),
{p}_cut AS (SELECT g, f, (x + lead(x) OVER (PARTITION BY g, f ORDER BY x)) / 2 AS t, {run('n')} AS n_l,
  sum(n) OVER (PARTITION BY g, f) - {run('n')} AS n_r, {', '.join(f"{run(f'w{c}')} AS l{c}" for c in cls)},
  {', '.join(f"sum(w{c}) OVER (PARTITION BY g, f) AS a{c}" for c in cls)} FROM {p}_at),
{p}_side AS (SELECT *, {', '.join(f'a{c} - l{c} AS r{c}' for c in cls)} FROM {p}_cut WHERE t IS NOT NULL),
{p}_gain AS (SELECT s.*, {gini('a')} - {total('l')} / {total('a')} * {gini('l')} - {total('r')} / {total('a')} * {gini('r')} AS gain
  FROM {p}_side s JOIN ({leaf}) m USING (g) WHERE n_l >= m.leaf AND n_r >= m.leaf),
{p}_best AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY round(gain, 12) DESC, f, t) AS place FROM {p}_gain),
{p}_root AS (SELECT g, {sums('w', 'a')} FROM {p}_rows JOIN {p}_w USING (g, label) WHERE NOT held GROUP BY g),
{p}_tree AS (SELECT o.g, CASE WHEN b.gain > 0 AND {first('b.l')} <> {first('b.r')} THEN f END AS f, b.t, b.gain,
  {', '.join(f'b.l{c}, b.r{c}, o.a{c}' for c in cls)} FROM {p}_root o LEFT JOIN (SELECT * FROM {p}_best WHERE place = 1) b ON b.g = o.g),
{p}_side2 AS (SELECT r.g, r.held, r.name, r.label, {', '.join(f"CASE WHEN t.f IS NULL THEN a{c} WHEN i.x <= t.t THEN l{c} ELSE r{c} END AS s{c}" for c in cls)}
  FROM {p}_rows r JOIN {p}_tree t ON t.g = r.g LEFT JOIN {p}_imp i ON i.g = r.g AND i.name = r.name AND i.held = r.held AND i.f = t.f),
{p}_out AS (SELECT g, held, name, label, {', '.join(f"s{c} / {total('s')} AS p{c}" for c in cls)}, CAST({first('s')} AS INT) AS pred FROM {p}_side2)"""


def f1_sql(rows: str, k: int) -> str:
    """(g, f1) of ``rows`` (g, label, pred): the F1 of each class, weighted by its rows."""
    return (f"SELECT g, sum(CASE WHEN tp > 0 THEN 2 * tp / (support + n_pred) ELSE 0 END * support) / sum(support) AS f1 FROM ("
            f"SELECT g, c, sum(CASE WHEN label = c THEN 1 ELSE 0 END) AS support, sum(CASE WHEN pred = c THEN 1 ELSE 0 END) AS n_pred, "
            f"sum(CASE WHEN label = c AND pred = c THEN 1 ELSE 0 END) AS tp FROM ({rows}) e, (SELECT range AS c FROM range({k})) cc GROUP BY g, c) z GROUP BY g")
