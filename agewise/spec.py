"""Declarative description of a panel and of a cohort study over it.

Every operator in the package takes a :class:`PanelSpec` (which columns play
which role) and, where study parameters matter, a :class:`CohortPreset`.  Two
presets reproduce the two pipelines of the original application
(``TIER3`` and ``BINARY``); ``FIXTURE_TIER3`` / ``FIXTURE_BINARY`` run the
same operators over the panel derived from the TPC-H style test tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from . import fixed as FX


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of an entity x period panel."""

    entity: str
    period: str
    age: str
    weight: str
    stats: tuple[str, ...]
    segment: str | None = None
    total_marker: str = "TOT"
    position: str | None = None
    # Columns that stand in for "file order" when two rows tie.
    tiebreak: tuple[str, ...] = ()
    # Extra columns coerced to numbers next to the stats (games etc.).
    extra_numeric: tuple[str, ...] = ()

    @property
    def numeric(self) -> tuple[str, ...]:
        cols = [self.age, self.period, self.weight, *self.extra_numeric, *self.stats]
        seen: list[str] = []
        for c in cols:
            if c not in seen:
                seen.append(c)
        return tuple(seen)


@dataclass(frozen=True)
class TierRule:
    """Three-tier outcome rule over the rows at or above ``outcome_age``.

    tier 2: n >= top_min_rows and (avg rate >= top_rate or avg impact >= top_impact)
            and avg weight >= top_weight
    tier 1: n >= mid_min_rows and (avg rate >= mid_rate or avg impact >= mid_impact)
            and avg weight >= mid_weight
    tier 0: otherwise (also whenever n < mid_min_rows).
    Missing averages are replaced by the ``missing_*`` values before comparing.
    """

    rate_stat: str
    impact_stat: str
    outcome_age: int = FX.OUTCOME_AGE
    top_min_rows: int = FX.TIER_RULE["top_min_rows"]
    top_rate: float = FX.TIER_RULE["top_rate"]
    top_impact: float = FX.TIER_RULE["top_impact"]
    top_weight: float = FX.TIER_RULE["top_weight"]
    mid_min_rows: int = FX.TIER_RULE["mid_min_rows"]
    mid_rate: float = FX.TIER_RULE["mid_rate"]
    mid_impact: float = FX.TIER_RULE["mid_impact"]
    mid_weight: float = FX.TIER_RULE["mid_weight"]
    missing_rate: float = FX.TIER_RULE["missing_rate"]
    missing_impact: float = FX.TIER_RULE["missing_impact"]
    missing_weight: float = FX.TIER_RULE["missing_weight"]


@dataclass(frozen=True)
class CohortPreset:
    """All parameters of one cohort study."""

    name: str
    panel: PanelSpec
    # cleaning
    clean_names: bool
    dedupe: str  # "total_else_max_weight" | "total_else_first"
    drop_null_keys: bool
    min_weight: float
    period_range: tuple[int, int] | None
    # cohort and features
    baseline_age: int
    delta_ages: tuple[int, ...]
    pick: str  # "latest" | "earliest" season when one age has several
    cohort_periods: tuple[int, int]
    distinct_entities: bool
    label: str  # "tier" | "reached"
    label_col: str
    tier_rule: TierRule | None = None
    outcome_age: int = FX.OUTCOME_AGE
    baseline_fmt: str = "age{age}_{stat}"
    delta_fmt: str = "delta_{stat}_{age}"
    with_context: bool = True
    position_rules: tuple[tuple[str, int], ...] = ()
    position_default: int = FX.POSITION_DEFAULT
    career_high: tuple[str, str] | None = None  # (stat, feature name)
    career_mean: tuple[str, str] | None = None
    seasons_name: str = "seasons_at_{age}"
    trend_stats: tuple[str, ...] = ()
    trend_fmt: str = "total_{stat}_change"
    velocity: tuple[tuple[str, str], ...] = ()  # (stat, feature name)
    trend_age: int | None = None  # age of the "total change" (last delta age)
    names: dict = field(default_factory=dict)  # stat -> display name for features

    def __post_init__(self):
        if self.label not in ("tier", "reached"):
            raise ValueError(f"label must be 'tier' or 'reached', not {self.label!r}")
        if self.label == "tier" and self.tier_rule is None:
            raise ValueError("a 'tier' label needs a tier_rule")
        if self.dedupe not in ("total_else_max_weight", "total_else_first"):
            raise ValueError(f"unknown de-duplication {self.dedupe!r}")
        if self.pick not in ("latest", "earliest"):
            raise ValueError(f"pick must be 'latest' or 'earliest', not {self.pick!r}")
        if not self.delta_ages:
            raise ValueError("at least one delta age is needed")

    def with_(self, **kw) -> "CohortPreset":
        return replace(self, **kw)


def clean_stat_name(stat: str) -> str:
    """Feature-name form of a stat: ``%`` becomes ``pct`` and ``/`` becomes ``_``."""
    return stat.replace("%", "pct").replace("/", "_")


# The original's values live in agewise.fixed; these names are kept for imports.
REFERENCE_TIER3_STATS = FX.TIER3_STATS
REFERENCE_BINARY_STATS = FX.BINARY_STATS
REFERENCE_POSITION_RULES = FX.POSITION_RULES
TIER_LABELS = FX.TIER_LABELS
TIER_DESCRIPTIONS = FX.TIER_DESCRIPTIONS

REFERENCE_PANEL = PanelSpec(
    entity="Player", period="Year", age="Age", weight="MP",
    stats=REFERENCE_TIER3_STATS, segment="Tm", total_marker="TOT", position="Pos",
    tiebreak=("_ordinal",), extra_numeric=("G", "GS"),
)

TIER3 = CohortPreset(
    name="tier3", panel=REFERENCE_PANEL, clean_names=True,
    dedupe="total_else_max_weight", drop_null_keys=False, min_weight=FX.MIN_WEIGHT,
    period_range=FX.TIER3_PERIODS, baseline_age=FX.TIER3_BASELINE_AGE, delta_ages=FX.TIER3_DELTA_AGES,
    pick="latest", cohort_periods=FX.TIER3_COHORT, distinct_entities=False,
    label="tier", label_col="adaptability_tier",
    tier_rule=TierRule(rate_stat="WS/48", impact_stat="BPM"),
    position_rules=REFERENCE_POSITION_RULES, position_default=FX.POSITION_DEFAULT,
    career_high=("USG%", "career_high_USG"), career_mean=("BPM", "career_avg_BPM"),
    trend_stats=FX.TREND_STATS,
    velocity=(("USG%", "adaptation_velocity_USG"), ("3PAr", "adaptation_velocity_3PAr")),
)

BINARY = CohortPreset(
    name="binary",
    panel=replace(REFERENCE_PANEL, stats=REFERENCE_BINARY_STATS),
    clean_names=False, dedupe="total_else_first", drop_null_keys=True,
    min_weight=FX.MIN_WEIGHT, period_range=None, baseline_age=FX.BINARY_BASELINE_AGE,
    delta_ages=FX.BINARY_DELTA_AGES, pick="earliest", cohort_periods=FX.BINARY_COHORT, distinct_entities=True,
    label="reached", label_col="played_to_35",
    baseline_fmt="{raw}_age{age}", delta_fmt="{raw}_delta_age{age}",
    with_context=False,
)

# ---------------------------------------------------------------------------
# Presets over the panel derived from the test tables (see sources.fixtures):
# entity = customer name, period = half-year, segment = order priority,
# weight = summed quantity (limit 60), position = market segment.
# ---------------------------------------------------------------------------
FIXTURE_PANEL = PanelSpec(
    entity="name", period="period", age="age", weight="mp",
    stats=("usg", "ast", "par", "ts", "bpm", "ws48", "mp", "per"),
    segment="seg", total_marker="TOT", position="pos", tiebreak=("seg",),
    extra_numeric=("g",),
)

FIXTURE_TIER3 = TIER3.with_(
    name="fixture_tier3", panel=FIXTURE_PANEL, min_weight=60,
    period_range=(0, 12), cohort_periods=(0, 6),
    tier_rule=TierRule(rate_stat="ws48", impact_stat="bpm", top_rate=0.075,
                       top_impact=0.002, top_weight=150, mid_rate=0.065,
                       mid_impact=-0.002, mid_weight=80),
    position_rules=(("AUTO", 5), ("BUILD", 4), ("MACH", 2), ("HOUSE", 1)),
    career_high=("usg", "career_high_usg"), career_mean=("bpm", "career_avg_bpm"),
    trend_stats=("par", "usg", "ts", "ast"),
    velocity=(("usg", "adaptation_velocity_usg"), ("par", "adaptation_velocity_par")),
)

FIXTURE_BINARY = BINARY.with_(
    name="fixture_binary",
    panel=replace(FIXTURE_PANEL, stats=("par", "ast", "usg", "ts", "ws48", "bpm", "mp")),
    min_weight=60, cohort_periods=(0, 13),
)

PRESETS = {p.name: p for p in (TIER3, BINARY, FIXTURE_TIER3, FIXTURE_BINARY)}
