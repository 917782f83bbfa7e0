"""Clean-up traps: numbers, names, totals, ordering of the weight filter."""

from pyspark.sql import functions as F

from agewise.operators import clean as C
from agewise.spec import PanelSpec, FIXTURE_TIER3, FIXTURE_BINARY

SPEC = PanelSpec(entity="name", period="period", age="age", weight="mp", stats=("mp", "usg"),
                 segment="seg", position="pos", tiebreak=("seg",))
SCHEMA = "name string, period int, age int, seg string, mp string, usg string, pos string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_coerce_rejects_java_literals_and_nan(spark):
    df = rows(spark, [("a", 1, 30, "X", v, "1", "C") for v in ["12", " 7.5 ", "1d", "n/a", "", "NaN", "1e3", "-.5"]])
    out = [r.mp for r in C.coerce_numeric(df, ["mp"]).collect()]
    assert out == [12.0, 7.5, None, None, None, None, 1000.0, -0.5]


def test_clean_names_strips_stars_and_all_whitespace(spark):
    df = rows(spark, [("*Ann Lee*\t", 1, 30, "X", "1", "1", "C"), ("  Bo ", 1, 30, "X", "1", "1", "C")])
    assert [r.name for r in C.clean_names(df, "name").collect()] == ["Ann Lee", "Bo"]


def test_total_row_wins_even_below_weight_limit(spark):
    df = C.coerce_numeric(rows(spark, [
        ("a", 1, 30, "TOT", "100", "1", "C"),    # total under the limit
        ("a", 1, 30, "AAA", "900", "2", "C"),    # team row over the limit
        ("b", 1, 30, "BBB", "700", "1", "C"),
        ("b", 1, 30, "CCC", "800", "2", "C"),    # highest weight wins
        ("c", 1, 30, "AAA", None, "1", "C"),     # missing weight sorts last
        ("c", 1, 30, "BBB", "10", "2", "C"),
    ]), ["mp", "usg"])
    d = {r.name: (r.seg, r.mp) for r in C.dedupe_total_else_max(df, SPEC).collect()}
    assert d == {"a": ("TOT", 100.0), "b": ("CCC", 800.0), "c": ("BBB", 10.0)}
    kept = C.filter_min_weight(C.dedupe_total_else_max(df, SPEC), SPEC, 500).collect()
    assert sorted(r.name for r in kept) == ["b"]  # 'a' is gone although a team row had 900


def test_first_row_dedupe_drops_null_keys(spark):
    df = rows(spark, [(None, 1, 30, "A", "1", "1", "C"), ("a", 1, 30, "B", "1", "1", "C"),
                      ("a", 1, 30, "A", "5", "1", "C")])
    out = C.dedupe_total_else_first(df, SPEC).collect()
    assert [(r.name, r.seg) for r in out] == [("a", "A")]


def test_dedupe_is_idempotent_and_order_free(spark, small_dir):
    from agewise.sources import fixtures as fx
    raw = fx.panel(spark, small_dir, "panel_raw")
    spec = FIXTURE_TIER3.panel
    once = C.dedupe_total_else_max(C.coerce_numeric(raw, spec.numeric), spec)
    twice = C.dedupe_total_else_max(once, spec)
    shuffled = C.dedupe_total_else_max(C.coerce_numeric(raw.orderBy(F.rand(7)), spec.numeric), spec)
    key = ["name", "period", "seg", "mp"]
    a = sorted(map(tuple, once.select(*key).collect()), key=str)
    assert a == sorted(map(tuple, twice.select(*key).collect()), key=str)
    assert a == sorted(map(tuple, shuffled.select(*key).collect()), key=str)


def test_presets_clean_order(spark, small_dir):
    from agewise.sources import fixtures as fx
    raw = fx.panel(spark, small_dir, "panel_raw")
    t3 = C.clean_panel(raw, FIXTURE_TIER3)
    bn = C.clean_panel(raw, FIXTURE_BINARY)
    assert t3.filter(F.col("mp") < 60).count() == 0 and bn.filter(F.col("mp") < 60).count() == 0
    assert t3.filter(F.col("name").contains("*")).count() == 0
    assert bn.filter(F.col("name").contains("*")).count() > 0  # binary keeps raw names
    assert t3.groupBy("name", "period").count().filter("count > 1").count() == 0
