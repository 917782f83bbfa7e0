"""Sources: index column dropped, read order stamped, external location."""

import os
import tempfile

from agewise.sources.readers import load_panel, load_panel_external


def _csv(rows, header):
    d = tempfile.mkdtemp(prefix="agewise-src-")
    p = os.path.join(d, "panel.csv")
    with open(p, "w") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(map(str, r)) + "\n")
    return p


def test_csv_drops_index_and_stamps_order(spark):
    p = _csv([(0, "Ann", 2005, 30, "TOT", 900), (1, "Bo", 2005, 29, "AAA", "n/a"), (2, "Ann", 2006, 31, "TOT", 800)],
             ["Unnamed: 0", "Player", "Year", "Age", "Tm", "MP"])
    df = load_panel(spark, p, ordinal="_ordinal")
    assert "Unnamed: 0" not in df.columns and df.columns[-1] == "_ordinal"
    rows = df.orderBy("_ordinal").collect()
    assert [r.Player for r in rows] == ["Ann", "Bo", "Ann"]  # file order
    assert rows[1].MP == "n/a"  # strings until the clean-up coerces them


def test_external_location_from_session_setting(spark):
    p = _csv([("Ann", 2005)], ["Player", "Year"])
    spark.conf.set("agewise.panel.path", p)
    try:
        assert load_panel_external(spark, fmt="csv").count() == 1
    finally:
        spark.conf.unset("agewise.panel.path")
