"""A hot entity holding a third of all rows: results equal a brute force."""

import numpy as np
import pandas as pd

from agewise.operators.clean import clean_panel
from agewise.operators.features import training_dataset
from agewise.spec import FIXTURE_TIER3

COLS = ["name", "period", "age", "pos", "seg", "mp", "usg", "ast", "par", "ts", "per", "bpm", "ws48", "g"]


def _panel(rng):
    rows = []
    # the hot entity: every period duplicated in many segment rows
    for p in range(13):
        for s in range(400):
            rows.append(("hot", p, 24 + p, "AUTOMOBILE", f"S{s:03d}", float(rng.integers(1, 400)),
                         *rng.random(7).tolist(), 1))
    for e in range(300):
        for p in range(13):
            for s in ("TOT", "A", "B"):
                rows.append((f"e{e:03d}", p, 24 + e % 7 + p, "BUILDING", s, float(rng.integers(1, 400)),
                             *rng.random(7).tolist(), 1))
    return pd.DataFrame(rows, columns=COLS)


def _brute(pdf):
    d = pdf.assign(_t=(pdf.seg != "TOT").astype(int)).sort_values(
        ["name", "period", "_t", "mp", "seg"], ascending=[True, True, True, False, True])
    d = d.drop_duplicates(["name", "period"])
    d = d[(d.period >= 0) & (d.period <= 12) & (d.mp >= 60)]
    out = {}
    for n, g in d.groupby("name"):
        b = g[g.age == 30]
        d31 = g[g.age == 31]
        if b.empty or not (0 <= b.period.iloc[-1] <= 6):
            continue
        late = g[g.age >= 35]
        out[n] = (b.mp.iloc[-1], (d31.usg.iloc[-1] - b.usg.iloc[-1]) if not d31.empty else None, len(late),
                  int((g.age <= 30).sum()))
    return out


def test_hot_entity_matches_brute_force(spark):
    pdf = _panel(np.random.default_rng(13))
    assert (pdf.name == "hot").mean() > 0.3
    t = training_dataset(clean_panel(spark.createDataFrame(pdf), FIXTURE_TIER3), FIXTURE_TIER3)
    got = {r.name: (r.age30_mp, r.delta_usg_31, r.seasons_at_30) for r in t.collect()}
    want = _brute(pdf)
    assert set(got) == set(want) and "hot" in got
    for n, (mp, d31, _n_late, seasons) in want.items():
        g_mp, g_d31, g_seasons = got[n]
        assert g_mp == mp and g_seasons == seasons
        assert (g_d31 is None and d31 is None) or abs(g_d31 - d31) < 1e-12
