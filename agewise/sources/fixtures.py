"""Stand-in inputs derived from the TPC-H style test tables.

These builders only produce rows in the schemas the operators expect (a
player x season like panel, JSON requests); the operators themselves live in
``agewise.operators``.  The SQL text is shared with the DuckDB oracle so that
both engines see the same input rows.

panel        entity = customer, period = half-year since 1995, segment = order
             priority with a 'TOT' total row per (entity, period) from GROUPING
             SETS, weight ``mp`` = summed quantity, position = market segment.
panel_gappy  the panel without the 'TOT' row of every third (entity, period),
             so that "else" branches of the de-duplication are exercised.
panel_raw    panel_gappy with dirty names and numbers stored as strings, some of
             them not numbers at all.
requests     one JSON request per entity with its total rows at ages 28..31.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Common table expressions shared by Spark (``{orders}`` etc. are DataFrame
# parameters of ``spark.sql``) and DuckDB (plain view names).
FIXTURE_CTE = """
fx_base AS (
  SELECT o.o_custkey AS entity, c.c_name AS name, c.c_mktsegment AS pos,
         o.o_orderpriority AS seg,
         CAST((year(o.o_orderdate) - 1995) * 2
              + CASE WHEN month(o.o_orderdate) > 6 THEN 1 ELSE 0 END AS INT) AS period,
         l.l_quantity AS q, l.l_extendedprice AS p, l.l_discount AS d, l.l_tax AS t
  FROM {orders} o
  JOIN {lineitem} l ON l.l_orderkey = o.o_orderkey
  JOIN {customer} c ON c.c_custkey = o.o_custkey
),
panel AS (
  SELECT entity, name, period,
         CAST(24 + entity % 7 + period AS INT) AS age,
         pos,
         CASE WHEN grouping(seg) = 1 THEN 'TOT' ELSE seg END AS seg,
         sum(q) AS mp,
         sum(q) / count(*) AS usg,
         CAST(sum(tc) AS DOUBLE) / count(*) AS ast,
         CAST(sum(dc) AS DOUBLE) / (100 * count(*)) AS par,
         CAST(sum(pc * (100 - dc)) AS DOUBLE) / CAST(100 * sum(pc) AS DOUBLE) AS ts,
         CAST(sum(pc) AS DOUBLE) / (100 * sum(q)) AS per,
         CAST(sum(pc * dc) AS DOUBLE) / CAST(100 * sum(pc) AS DOUBLE) - 0.05 AS bpm,
         count(*) / sum(q) AS ws48,
         count(*) AS g
  FROM (SELECT *, CAST(round(p * 100) AS BIGINT) AS pc, CAST(round(d * 100) AS BIGINT) AS dc,
               CAST(round(t * 100) AS BIGINT) AS tc
        FROM fx_base) x
  GROUP BY GROUPING SETS ((entity, name, pos, period), (entity, name, pos, period, seg))
),
panel_gappy AS (
  SELECT * FROM panel WHERE NOT (seg = 'TOT' AND (entity + period) % 3 = 0)
),
panel_raw AS (
  SELECT entity,
         CASE entity % 5 WHEN 0 THEN name || '*'
                         WHEN 1 THEN '  ' || name || chr(9)
                         WHEN 2 THEN '*' || name || ' '
                         ELSE name END AS name,
         period, age, pos, seg,
         CASE WHEN (entity + period + length(seg)) % 23 = 0 THEN 'n/a'
              WHEN (entity + period + length(seg)) % 29 = 0 THEN ''
              WHEN (entity + period + length(seg)) % 31 = 0 THEN '1d'
              WHEN (entity + period + length(seg)) % 37 = 0 THEN 'NaN'
              ELSE CAST(mp AS STRING) END AS mp,
         CASE WHEN (entity * 3 + period) % 19 = 0 THEN 'x'
              WHEN (entity * 3 + period) % 41 = 0 THEN 'NaN'
              ELSE CAST(usg AS STRING) END AS usg,
         ast, par, ts, per, bpm, ws48, g
  FROM panel_gappy
),
requests AS (
  SELECT entity, name,
         '{{' || string_agg('"age_' || CAST(age AS STRING) || '": {{'
            || concat_ws(', ',
                 CASE WHEN entity % 7 <> 0 THEN '"par": ' || CAST(par AS STRING) END,
                 CASE WHEN entity % 7 <> 1 THEN '"ast": ' || CAST(ast AS STRING) END,
                 CASE WHEN entity % 7 <> 2 THEN '"usg": ' || CAST(usg AS STRING) END,
                 CASE WHEN entity % 7 <> 3 THEN '"ts": ' || CAST(ts AS STRING) END,
                 CASE WHEN entity % 7 <> 4 THEN '"ws48": ' || CAST(ws48 AS STRING) END,
                 CASE WHEN entity % 7 <> 5 THEN '"bpm": ' || CAST(bpm AS STRING) END,
                 '"mp": ' || CAST(mp AS STRING))
            || '}}', ', ') || '}}' AS request
  FROM panel
  WHERE seg = 'TOT' AND age BETWEEN 28 AND 31
  GROUP BY entity, name
)
"""

FIXTURE_TABLES = ("orders", "lineitem", "customer")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def fixture_cte() -> str:
    """DuckDB text of the fixture CTEs over the pre-registered views."""
    return FIXTURE_CTE.format(**{t: t for t in FIXTURE_TABLES}).strip()


def fixture_sql(select: str) -> str:
    """DuckDB text: the fixture CTEs over the pre-registered views, then ``select``."""
    # ``str.format`` turns the doubled JSON braces into single ones, as
    # ``spark.sql`` does with its DataFrame parameters.
    cte = FIXTURE_CTE.format(**{t: t for t in FIXTURE_TABLES})
    return "WITH " + cte.strip() + "\n" + select


def _fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: read_table(spark, sf_dir, t) for t in FIXTURE_TABLES}
    return spark.sql("WITH " + FIXTURE_CTE.strip() + f"\nSELECT * FROM {name}", **tables)


def panel(spark: SparkSession, sf_dir: str, kind: str = "panel") -> DataFrame:
    """``kind`` is one of ``panel``, ``panel_gappy``, ``panel_raw``."""
    assert kind in ("panel", "panel_gappy", "panel_raw"), kind
    return _fixture(spark, sf_dir, kind)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fixture(spark, sf_dir, "requests")
