"""They must equal the published method's for results to match."""

# --- fixed values -----------------------------------------------------------
MAX_FIELD = 24
TEAMMATE_GAP_CLIP = 3.0
PRACTICE_MAX_GAP_PCT = 7.0
VENUE_CLASS_WINDOW = 10
MIN_GRID_COVERAGE = 0.9
MAX_SLOT = 30
FIELD_SIZE = (16, 26)
MAX_PER_TEAM = 2
ENTRY_SESSIONS = ("Q", "S", "SQ", "FP3", "FP2")

SMOOTHING = 0.002
TRAILING_EVENTS = 24
MIN_CALIBRATION_EVENTS = 10
TEMPERATURES = [0.05 * i for i in range(1, 41)] + [2.2 + 0.2 * i for i in range(30)]
LOG_FLOOR = 1e-12

DNF_ENTITY_SHARE, DNF_TEAM_SHARE = 0.35, 0.65
DNF_UNKNOWN, DNF_FLOOR, DNF_CAP = 0.12, 0.02, 0.35

BACK_OFFSET = 1000.0
FRONT_RUNNER = 6.0
HOLD_BACK_SLOT = 0.7
HOLD_BACK_SHARE = 0.6

RELIABILITY_EDGES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0)
ECE_BINS = 10
WILSON_Z = 1.96

MIN_TRAIN_EVENTS = 30
CALIBRATION_WARMUP = 24
RECENCY_FLOOR = 0.15
RECENCY_CANDIDATES = (1.0, 1.5, 2.0, 3.0, 4.0)
BLEND_CANDIDATES = tuple(i / 10 for i in range(11))
DEFAULTS = {"recency": 2.0, "temperature": 0.35, "blend": 0.7, "quali_temperature": 0.55, "sprint": 0.5}

POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
SPRINT_POINTS_FIRST = (3, 2, 1)
SPRINT_POINTS = (8, 7, 6, 5, 4, 3, 2, 1)
SPRINT_FIRST_SEASON = 2021
FASTEST_LAP_SEASONS = (2019, 2024)

CLEAN_LAP_FACTOR = 1.10
MIN_STINT_LAPS = 5

TYPICAL_WINDOW = 8
MIN_OWN_EVENTS = 3
CHECKPOINT_FRACTIONS = (0.35, 0.55, 0.75, 0.90)
COVERAGE_TARGET = 0.80
SPREAD_CANDIDATES = tuple(range(10))
TITLE_EDGES = (0.0, 0.5, 0.8, 0.95, 1.0001)
MIN_BIAS_EVENTS = 15
BIAS_WARN, BIAS_FAIL = 1.5, 3.0

LOWER_IS_BETTER = frozenset(
    {
        "win_logloss",
        "win_brier",
        "podium_brier",
        "top10_brier",
        "pole_logloss",
        "position_error",
        "driver_points_mae",
        "team_points_mae",
        "teammate_gap_mae",
        "champion_logloss",
    }
)

BASE_FEATURES = [
    "drv_avg_finish_3", "drv_avg_finish_5", "drv_points_rate_5", "drv_dnf_rate_10", "drv_experience",
    "team_avg_finish_3", "team_avg_finish_5", "team_points_rate_5", "team_dnf_rate_10",
    "champ_position_before", "champ_points_before", "drv_circuit_avg_finish", "team_circuit_avg_finish",
    "circuit_overtaking_score", "circuit_dnf_rate", "season_progress", "team_pace_gap_pct", "team_pace_trend",
    "drv_positions_gained_5", "drv_podium_rate_10", "drv_top10_rate_10", "drv_circuit_starts",
    "circuit_pole_win_rate", "team_avg_quali_5",
]
GRID_FEATURES = ["grid", "quali_position", "quali_gap_to_pole_pct"]
RACE_FEATURES = BASE_FEATURES + GRID_FEATURES
PRACTICE_FEATURES = ["fp_long_run_gap_pct", "fp_best_gap_pct", "practice_available"]
PRACTICE_DETAIL_FEATURES = [
    "fp1_gap_pct", "fp2_gap_pct", "fp3_gap_pct", "fp_latest_gap_pct", "fp_latest_rank", "fp_team_gap_pct",
    "fp_teammate_gap_pct", "fp_trend_12", "fp_trend_23", "fp_consistency",
]
QUALI_HISTORY_FEATURES = [
    "drv_avg_quali_3", "drv_avg_quali_5", "drv_pole_rate_10", "drv_quali_top3_rate_10", "team_avg_quali_5",
    "drv_pace_gap_pct", "team_pace_gap_pct", "team_pace_trend", "drv_teammate_quali_edge",
]
QUALI_CONTEXT_FEATURES = [
    "drv_experience", "team_avg_finish_5", "drv_circuit_avg_finish", "team_circuit_avg_finish",
    "circuit_pole_win_rate", "season_progress",
]
QUALI_FEATURES = QUALI_HISTORY_FEATURES + QUALI_CONTEXT_FEATURES + PRACTICE_FEATURES + PRACTICE_DETAIL_FEATURES
CLASS_FEATURES = ["street_circuit", "drv_type_avg_finish", "team_type_avg_finish"]
# --- end of fixed values ----------------------------------------------------

# --- fixed values: groups an explanation speaks about -------------------------
EXPLANATION_GROUPS = {
    "grid": "grid",
    "quali_position": "grid",
    "drv_avg_finish_3": "race_form",
    "drv_avg_finish_5": "race_form",
    "drv_points_rate_5": "race_form",
    "drv_podium_rate_10": "race_form",
    "drv_top10_rate_10": "race_form",
    "drv_positions_gained_5": "race_form",
    "team_avg_finish_3": "team_form",
    "team_avg_finish_5": "team_form",
    "team_points_rate_5": "team_form",
    "team_pace_gap_pct": "one_lap_pace",
    "team_pace_trend": "one_lap_pace",
    "quali_gap_to_pole_pct": "one_lap_pace",
    "team_avg_quali_5": "one_lap_pace",
    "champ_position_before": "championship",
    "champ_points_before": "championship",
    "drv_dnf_rate_10": "reliability",
    "team_dnf_rate_10": "reliability",
    "drv_circuit_avg_finish": "circuit",
    "team_circuit_avg_finish": "circuit",
    "drv_circuit_starts": "circuit",
    "circuit_overtaking_score": "circuit",
    "circuit_dnf_rate": "circuit",
    "circuit_pole_win_rate": "circuit",
    "drv_experience": "experience",
    "season_progress": "experience",
}
PENALTY_GAP = 3
GROUP_LABELS = {
    "grid": "starting position",
    "race_form": "recent race results",
    "team_form": "the team's recent results",
    "one_lap_pace": "one-lap pace",
    "championship": "championship position",
    "reliability": "reliability record",
    "circuit": "record at this circuit",
    "experience": "experience and point in the season",
}
# --- end of fixed values ----------------------------------------------------

#: Entrants of one event; the position distribution refuses larger fields.
FIELD_LIMIT = 100
