"""The presets with the original column names (with '%' and '/') run end to end."""

from agewise.operators.clean import clean_panel
from agewise.operators.features import feature_names, training_dataset
from agewise.spec import BINARY, TIER3

# The original feature order of the three-tier model.
TIER3_NAMES = (
    "age30_USGpct age30_ASTpct age30_3PAr age30_TSpct age30_BPM age30_WS_48 age30_MP age30_PER "
    "delta_USGpct_31 delta_ASTpct_31 delta_3PAr_31 delta_TSpct_31 delta_BPM_31 delta_WS_48_31 delta_MP_31 delta_PER_31 "
    "delta_USGpct_32 delta_ASTpct_32 delta_3PAr_32 delta_TSpct_32 delta_BPM_32 delta_WS_48_32 delta_MP_32 delta_PER_32 "
    "delta_USGpct_33 delta_ASTpct_33 delta_3PAr_33 delta_TSpct_33 delta_BPM_33 delta_WS_48_33 delta_MP_33 delta_PER_33 "
    "seasons_at_30 career_high_USG career_avg_BPM position_code "
    "total_3PAr_change total_USGpct_change total_TSpct_change total_ASTpct_change "
    "adaptation_velocity_USG adaptation_velocity_3PAr").split()

COLS = ["Player", "Year", "Age", "Tm", "Pos", "G", "GS", "MP", "USG%", "AST%", "3PAr", "TS%", "BPM", "WS/48", "PER"]


def _row(p, y, a, tm, mp, bpm=1.0, ws=0.12, pos="SG-PG"):
    return (p, str(y), str(a), tm, pos, "70", "60", str(mp), "25.0", "20.0", "0.3", "0.55", str(bpm), str(ws), "18")


def test_feature_names_match_original_order():
    assert feature_names(TIER3) == TIER3_NAMES


def test_tier3_and_binary_on_original_columns(spark):
    rows = [
        _row("Ann Lee*", 2004, 29, "TOT", 2000), _row("Ann Lee*", 2005, 30, "AAA", 1500),
        _row("Ann Lee*", 2005, 30, "BBB", 900), _row("Ann Lee*", 2006, 31, "TOT", 2100),
        _row("Ann Lee*", 2010, 35, "TOT", 1300, 2.0), _row("Ann Lee*", 2011, 36, "TOT", 1250, 1.0, 0.11),
        _row("Ann Lee*", 2012, 37, "TOT", 1400, 0.5, 0.09),
        _row(" Bo Kim", 2006, 28, "TOT", 900), _row(" Bo Kim", 2007, 29, "TOT", "n/a"),
        _row(" Bo Kim", 2008, 30, "TOT", 700, pos="PF-C"), _row(" Bo Kim", 2014, 36, "TOT", 650, -1.0, 0.01),
    ]
    raw = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in COLS))
    t = training_dataset(clean_panel(raw, TIER3), TIER3)
    assert t.columns == TIER3_NAMES + ["Player", "adaptability_tier"]
    got = {r.Player: r for r in t.collect()}
    assert set(got) == {"Ann Lee", "Bo Kim"}
    ann = got["Ann Lee"]
    # two team rows in 2005: the higher minutes win; the 2004 season is outside the years
    assert ann.age30_MP == 1500.0 and ann.seasons_at_30 == 1 and ann.delta_MP_31 == 600.0
    assert ann.position_code == 2 and ann.adaptability_tier == 2
    assert got["Bo Kim"].position_code == 5 and got["Bo Kim"].adaptability_tier == 0
    b = training_dataset(clean_panel(raw, BINARY), BINARY)
    assert "3PAr_age28" in b.columns and "AST%_delta_age29" in b.columns
    rows_b = {r.Player: r for r in b.collect()}
    assert set(rows_b) == {" Bo Kim"}  # no name clean-up in this preset
    assert rows_b[" Bo Kim"]["MP_delta_age29"] is None  # 'n/a' minutes fail the limit
    assert rows_b[" Bo Kim"].played_to_35 == 1
