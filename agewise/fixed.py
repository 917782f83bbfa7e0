"""Fixed values of the original application.

Results only match when these equal the original's: outcome labels and
descriptions, panel rules, the tier rule, position rules, band limits and
words, explanation sentences, what-if constants, and model and search
parameters.  They are stated here once, as plain text, in the original's
order; the operators read them from here.
"""

# --- outcome tiers -----------------------------------------------------------
TIER_LABELS = {0: "FADED", 1: "SURVIVED", 2: "THRIVED"}
TIER_DESCRIPTIONS = {
    0: "FADED - Could not adapt to aging, out of league or minimal impact after 35",
    1: "SURVIVED - Adapted to reduced role, remained valuable rotation player after 35",
    2: "THRIVED - Remained high-impact player, starter-quality into late 30s",
}

# --- stats, in feature order ---------------------------------------------------
TIER3_STATS = ("USG%", "AST%", "3PAr", "TS%", "BPM", "WS/48", "MP", "PER")
BINARY_STATS = ("3PAr", "AST%", "USG%", "TS%", "WS/48", "BPM", "MP")
TREND_STATS = ("3PAr", "USG%", "TS%", "AST%")

# --- panel and cohort rules ----------------------------------------------------
MIN_WEIGHT = 500
TIER3_PERIODS = (2005, 2017)
TIER3_COHORT = (2005, 2012)
BINARY_COHORT = (2005, 2018)
TIER3_BASELINE_AGE, TIER3_DELTA_AGES = 30, (31, 32, 33)
BINARY_BASELINE_AGE, BINARY_DELTA_AGES = 28, (29, 30, 31)
OUTCOME_AGE = 35

# --- tier rule over the rows at or above the outcome age -------------------------
# tier 2: 3+ rows, (avg WS/48 >= 0.100 or avg BPM >= 1.5), avg MP >= 1200
# tier 1: 2+ rows, (avg WS/48 >= 0.050 or avg BPM >= 0.0), avg MP >= 600
# missing averages count as -999 / -999 / 0
TIER_RULE = {
    "top_min_rows": 3, "top_rate": 0.100, "top_impact": 1.5, "top_weight": 1200.0,
    "mid_min_rows": 2, "mid_rate": 0.050, "mid_impact": 0.0, "mid_weight": 600.0,
    "missing_rate": -999.0, "missing_impact": -999.0, "missing_weight": 0.0,
}

# --- position codes: first hit wins, anything else 3 --------------------------------
POSITION_RULES = (("C", 5), ("PF", 4), ("SF", 3), ("SG", 2), ("PG", 1))
POSITION_DEFAULT = 3

# --- bands -----------------------------------------------------------------------------
CONFIDENCE_BANDS = ((0.6, "HIGH"), (0.4, "MEDIUM"))   # on the largest class probability
CONFIDENCE_ELSE = "LOW"
RISK_BANDS = ((0.7, "Low"), (0.4, "Medium"))           # on the probability of the outcome
RISK_ELSE = "High"
SIGNAL_UP, SIGNAL_DOWN, SIGNAL_FLAT = "↑ spacing increase", "↓ efficient role shift", "↔ stable"

# --- explanation sentences --------------------------------------------------------------
MAGNITUDES = ((1.5, "significantly"), (0.5, "moderately"))  # on |z|, strictly above
MAGNITUDE_ELSE = "slightly"
ABOVE, BELOW = "above", "below"
INCREASED, DECREASED = "increased", "decreased"
# placeholders: {stat} {base} {age} {feature} {magnitude} {direction} {change}
# {value1} {value2} {value3}: the value with 1/2/3 decimals, {abs2} {abs3}: its
# magnitude, {mean2}: the mean, {int}: the value as an integer, {signed1}: with sign
TEMPLATES = {
    "baseline": "{stat} at age {base} is {magnitude} {direction} average ({value2} vs {mean2})",
    "delta": "{stat} {change} by {abs2} from age {base} to {age}",
    "total": "Total {stat} {change} by {abs3} from {base}-{age}",
    "velocity": "Adaptation rate for {stat}: {value3} per year",
    "seasons": "Had {int} seasons of experience by age {base}",
    "high": "Career high {stat} was {value1}%",
    "mean": "Career average {stat} before {base} was {signed1}",
    "other": "{feature}: {value2}",
}
OPENINGS = {
    2: "The model predicts {entity} will THRIVE into their late 30s ({pct} probability).",
    1: "The model predicts {entity} will SURVIVE as a valuable rotation player ({pct} probability).",
    0: "The model predicts {entity} will struggle to adapt (FADED tier, {pct} probability).",
}
STRENGTH = " Key strength: {text}."
CONCERN = " Main concern: {text}."
SIMILAR = " Similar to players like {names} (outcomes: {labels})."
TOP_FACTORS = 5
COMPARABLES = 5
COMPARABLES_IN_SENTENCE = 3

# --- what-if form --------------------------------------------------------------------------
SCENARIO_SHARES = ((1, 3), (2, 3), (1, 1))   # times / by: of the 30->33 change at ages 31, 32, 33
SCENARIO_CAREER_MEAN_FACTOR = 0.8       # career mean impact = 0.8 x baseline impact
SCENARIO_POSITION = 3

# --- models and search ----------------------------------------------------------------------
SEED = 42
TEST_FRACTION = 0.2
FOLDS = 5
SEARCH_DRAWS = 30
FOREST = {"n_trees": 500, "max_depth": 12, "min_leaf": 10, "max_features": "sqrt"}  # min split 20: no Spark counterpart
TUNING_GRID = {
    "n_trees": [200, 300, 500, 700],
    "max_depth": [8, 10, 12, 15, None],
    "min_leaf": [5, 8, 10, 15],
    "max_features": ["sqrt", "log2"],
}  # the min-split axis (10, 15, 20, 30) has no Spark counterpart
BINARY_FOREST = {"n_trees": 400, "max_depth": None, "min_leaf": 1, "max_features": "sqrt"}
GM_ADVICE = "Retain on short-term. Bench veteran or glue-guy role."
