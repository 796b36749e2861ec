"""Names, codes, word lists, patterns and thresholds.

Results depend on these being exactly what the data contract says, so they are
stated here once, as plain data, and used everywhere else by name.
"""

from __future__ import annotations

from dataclasses import dataclass

# --- fixed values: column names of the four input tables -------------------------


@dataclass(frozen=True)
class Columns:
    """Column names of the data contract; every one can be replaced."""

    contest_id: str = "fight_id"
    event_date: str = "event_date"
    split: str = "split"
    target: str = "target_a_win"
    a_id: str = "fighter_a_id"
    a_name: str = "fighter_a_name"
    b_id: str = "fighter_b_id"
    b_name: str = "fighter_b_name"
    context_class: str = "division"
    title: str = "is_title_bout"
    entity_id: str = "fighter_id"
    entity_name: str = "fighter_name"
    display_name: str = "display_name"
    as_of: str = "as_of_date"
    last_event: str = "last_fight_date"
    dob: str = "dob"
    last_class: str = "last_division"
    stance: str = "stance"
    feature_prefix: str = "feature_"

    @property
    def contest_required(self) -> tuple[str, ...]:
        return (
            self.contest_id, self.event_date, self.split, self.target, self.a_id,
            self.a_name, self.b_id, self.b_name, self.context_class, self.title,
        )

    @property
    def snapshot_required(self) -> tuple[str, ...]:
        return (self.entity_id, self.entity_name, self.as_of, self.last_event)


DICTIONARY_COLUMNS = ("column", "role", "available_pre_fight", "description")
FEATURE_ROLE = "model_feature"
TARGET_ROLE = "target"
SPLIT_LABELS = ("train", "validation", "test")
TRUE_WORDS = ("1", "true", "yes")
FALSE_WORDS = ("0", "false", "no")

# --- fixed values: column names that would leak the outcome -----------------------

LEAK_NAMES = (
    "winner", "method", "end_round", "end_time", "total_fight_time_sec",
    "fighter_1", "fighter_2", "wins", "losses", "draws", "slpm", "sapm",
    "str_acc", "str_def", "td_avg", "td_acc", "td_def", "sub_avg",
)
LEAK_PATTERNS = (
    r"^(?:f1|f2)_",
    r"(?:^|_)post_?fight(?:_|$)",
    r"(?:^|_)fight_result(?:_|$)",
)
LEAK_TARGET_PREFIX = "target_"

# --- fixed values: semantic feature groups, first matching rule wins ---------------

FEATURE_GROUP_RULES = (
    ("missingness", ("missing", "debut")),
    ("recent_form", ("recent",)),
    ("ratings", ("elo",)),
    ("activity", ("layoff", "activity_")),
    ("physical", ("age", "height", "reach", "stance", "southpaw", "switch")),
    ("experience", ("prior_fights", "career_minutes", "win_rate", "loss_rate", "current_streak")),
    ("striking", ("_sig_", "_kd_", "strike_share", "clinch_strike", "ground_strike")),
    ("grappling", ("_td_", "_sub_", "control_share", "control_allowed")),
    ("context", ("division_lbs", "is_womens", "is_catch_weight")),
)
FEATURE_GROUP_OTHER = "other"

# group -> (tokens to include, tokens to exclude); a feature may be in several
ABLATION_RULES = (
    ("elo", ("elo",), ()),
    ("physical_attributes", ("age", "height", "reach"), ()),
    (
        "career_performance",
        ("win_rate", "finish_", "ko_win", "submission_win", "sig_", "kd_", "td_", "sub_", "control_"),
        ("recent5",),
    ),
    ("recent_five_performance", ("recent5",), ()),
    ("activity_and_layoff", ("activity_", "layoff"), ()),
    ("stance_and_style", ("stance", "southpaw", "switch", "strike_share"), ()),
    (
        "experience",
        ("prior_fights", "career_minutes", "debut", "current_streak", "division_elo_fights"),
        (),
    ),
)

# --- fixed values: context classes (code, pounds, womens, catch weight) ------------

CONTEXT_CLASSES = (
    ("M_FLY", 125.0, False, False),
    ("M_BANTAM", 135.0, False, False),
    ("M_FEATHER", 145.0, False, False),
    ("M_LIGHT", 155.0, False, False),
    ("M_WELTER", 170.0, False, False),
    ("M_MIDDLE", 185.0, False, False),
    ("M_LIGHT_HEAVY", 205.0, False, False),
    ("M_HEAVY", 265.0, False, False),
    ("W_STRAW", 115.0, True, False),
    ("W_FLY", 125.0, True, False),
    ("W_BANTAM", 135.0, True, False),
    ("W_FEATHER", 145.0, True, False),
    ("CATCH", None, False, True),
)
CONTEXT_ALIASES = {
    "flyweight": "M_FLY",
    "mens flyweight": "M_FLY",
    "men flyweight": "M_FLY",
    "bantamweight": "M_BANTAM",
    "mens bantamweight": "M_BANTAM",
    "men bantamweight": "M_BANTAM",
    "featherweight": "M_FEATHER",
    "mens featherweight": "M_FEATHER",
    "men featherweight": "M_FEATHER",
    "lightweight": "M_LIGHT",
    "mens lightweight": "M_LIGHT",
    "men lightweight": "M_LIGHT",
    "welterweight": "M_WELTER",
    "mens welterweight": "M_WELTER",
    "men welterweight": "M_WELTER",
    "middleweight": "M_MIDDLE",
    "mens middleweight": "M_MIDDLE",
    "men middleweight": "M_MIDDLE",
    "light heavyweight": "M_LIGHT_HEAVY",
    "mens light heavyweight": "M_LIGHT_HEAVY",
    "men light heavyweight": "M_LIGHT_HEAVY",
    "heavyweight": "M_HEAVY",
    "mens heavyweight": "M_HEAVY",
    "men heavyweight": "M_HEAVY",
    "womens strawweight": "W_STRAW",
    "women strawweight": "W_STRAW",
    "strawweight": "W_STRAW",
    "womens flyweight": "W_FLY",
    "women flyweight": "W_FLY",
    "womens bantamweight": "W_BANTAM",
    "women bantamweight": "W_BANTAM",
    "womens featherweight": "W_FEATHER",
    "women featherweight": "W_FEATHER",
    "catchweight": "CATCH",
    "catch weight": "CATCH",
}
CLASS_LABEL_NOISE = ("ufc ", " interim ", " title ", " tournament ", " superfight ", " bout")
UNUSABLE_CLASSES = ("UNKNOWN", "OPEN")
UNSPECIFIED_CLASS = "UNSPECIFIED"
CLASS_STATE_TOKENS = ("elo_division", "division_elo_fights")
SUPPORTED_CLASS_PREFIXES = ("M_", "W_")
UNKNOWN_STANCES = ("unknown", "nan", "none")

# --- fixed values: pairwise features ------------------------------------------------

DIFFERENCE_PREFIX = "feature_a_minus_b_"
SHARED_FEATURES = (
    "feature_division_lbs",
    "feature_is_womens",
    "feature_is_catch_weight",
    "feature_min_prior_fights",
    "feature_total_prior_fights",
    "feature_log_total_career_minutes",
    "feature_both_debutants",
    "feature_exactly_one_debutant",
    "feature_same_known_stance",
    "feature_any_age_missing",
    "feature_any_height_missing",
    "feature_any_reach_missing",
    "feature_min_division_elo_fights",
    "feature_mean_elo_global",
)
DAYS_PER_YEAR = 365.2425
DEFAULT_LAYOFF_DAYS = 365
ACTIVITY_WINDOWS = (("feature_activity_365d", 365), ("feature_activity_730d", 730))

# --- fixed values: evaluation ----------------------------------------------------------

LOG_LOSS_EPSILON = 2.220446049250313e-16
LOGIT_EPSILON = 1e-6
MISSING_MARKER = "<missing>"
SMALL_GROUP_REASON = "Fewer than min_samples={} rows."
MIN_SAMPLES_ERROR = "min_samples must be between 1 and the sample count."
# names of the standard segments: class, both known, one unknown, both experienced, experience, probability, title
STANDARD_SEGMENTS = (
    "seg_division", "both_fighters_have_ufc_history", "at_least_one_ufc_debutant", "both_fighters_have_three_plus_fights",
    "experience_band", "probability_band", "title_bout",
)
# (label, largest count in the band); the last band is open
EXPERIENCE_BANDS = (("debut", 0), ("1_to_2", 2), ("3_to_5", 5), ("6_to_10", 10), ("11_plus", None))
# (label, upper bound, exclusive); the last band is open
PROBABILITY_BANDS = (
    ("0.50_to_0.60", 0.60), ("0.60_to_0.70", 0.70), ("0.70_to_0.80", 0.80), ("0.80_plus", None),
)

# --- fixed values: identity --------------------------------------------------------------

STABLE_ID_PATTERN = r"^[0-9a-fA-F]{16}$"
REDACTED_ID_PATTERN = r"(?i)\b[0-9a-f]{12,}\b"
SUGGESTION_CUTOFF = 0.65
SUGGESTION_LIMIT = 5
UNKNOWN_ENTITY_NAME = "Unknown Fighter"

# --- fixed values: support grading (penalties, thresholds, messages) ---------------------

PENALTY_ONE_DEBUT = 0.30
PENALTY_BOTH_DEBUT = 0.42
PENALTY_LIMITED = 0.14
PENALTY_STALE = 0.16
PENALTY_VERY_STALE = 0.25
VERY_STALE_DAYS = 730
PENALTY_LAYOFF = 0.13
# (largest day count, penalty, severity); the last is open
CUTOFF_STEPS = ((180, 0.03, "info"), (365, 0.07, "warning"), (None, 0.15, "warning"))
PENALTY_DISAGREE = 0.17
PENALTY_DISAGREE_CRITICAL = 0.32
RANGE_BASE, RANGE_STEP, RANGE_CAP, RANGE_CRITICAL_COUNT = 0.06, 0.02, 0.26, 8
UNSUPPORTED_BASE, UNSUPPORTED_STEP, UNSUPPORTED_CAP = 0.35, 0.05, 0.55
TIER_STEPS = (("standard", 0.85), ("reduced", 0.65), ("low", 0.40), ("unsupported", None))
EVEN_TOLERANCE = 1e-12
MSG_DEBUT_BOTH = "Both fighters have no recorded UFC history."
MSG_DEBUT_ONE = "One fighter has no recorded UFC history."
MSG_LIMITED = "At least one fighter has limited UFC history; rate estimates will be less stable."
MSG_STALE = "The prediction relies on a stale snapshot or a long period of fighter inactivity."
MSG_CUTOFF = "The current prediction time is after the model's training data cutoff."
MSG_CUTOFF_NOTE = (
    "Rolling activity counts come from the selected snapshot; only windows guaranteed "
    "empty by the recalculated layoff are reset to zero."
)
MSG_DISAGREE = "Swapping fighter order materially changes the model's implied probability."
MSG_RANGE = "One or more matchup features fall outside the model's recorded training range."
MSG_UNSUPPORTED = (
    "The matchup includes conditions not represented by the supported inference contract."
)

# --- fixed values: public messages for rejected requests ------------------------------------

MSG_SAME = "Choose two different fighters."
MSG_NO_MATCH = "No fighter matched {}"
MSG_CLOSE = ". Close matches: {}"
MSG_OTHER_ID = "{} does not refer to fighter_id {}"
MSG_REPEATED = "fighter {} has {} snapshots on {}"
MSG_POST_CUTOFF = "The current server date is after the model cutoff and post-cutoff prediction is disabled"
MSG_CLASS_UNSUPPORTED = "unsupported division {}; supply division_lbs and is_womens to score it explicitly"
MSG_CLASS_REQUIRED = "division is required when it cannot be inferred from both snapshots"
MSG_CLASS_WEIGHT = "catchweight predictions require an explicit division_lbs"
MSG_STATE_MISSING = "{} has UFC history but no reconstructable division-specific rating state"
MSG_STATE_MISMATCH = (
    "{}'s snapshot stores division-specific ratings for {}, not requested division {}; "
    "per-division history is required to score a division change"
)
SIDE_NAMES = ("fighter A", "fighter B")
MSG_AMBIGUOUS = "More than one fighter matches that name. Use a more specific full name."
MSG_GENERIC = "The prediction service could not complete this request. Please try again later."

# --- fixed values: display labels ----------------------------------------------------------

LABELS = {
    "confidence": {
        "LOW": "Low", "REDUCED": "Reduced", "STANDARD": "Standard", "UNSUPPORTED": "Unsupported",
    },
    "division": {
        "CATCH": "Catchweight",
        "M_BANTAM": "Male Bantamweight",
        "M_FEATHER": "Male Featherweight",
        "M_FLY": "Male Flyweight",
        "M_HEAVY": "Male Heavyweight",
        "M_LIGHT": "Male Lightweight",
        "M_LIGHT_HEAVY": "Male Light Heavyweight",
        "M_MIDDLE": "Male Middleweight",
        "M_WELTER": "Male Welterweight",
        "OPEN": "Openweight",
        "UNKNOWN": "Unknown division",
        "UNSPECIFIED": "Unspecified division",
        "W_BANTAM": "Female Bantamweight",
        "W_FEATHER": "Female Featherweight",
        "W_FLY": "Female Flyweight",
        "W_STRAW": "Female Strawweight",
    },
    "method": {
        "COULD_NOT_CONTINUE": "Could not continue",
        "DECISION_MAJORITY": "Majority decision",
        "DECISION_SPLIT": "Split decision",
        "DECISION_UNANIMOUS": "Unanimous decision",
        "DQ": "Disqualification",
        "KO": "Knockout",
        "KO/TKO": "KO/TKO",
        "M_DEC": "Majority decision",
        "OTHER": "Other method",
        "S_DEC": "Split decision",
        "SUB": "Submission",
        "SUBMISSION": "Submission",
        "TKO": "Technical knockout",
        "TKO_DOCTOR'S_STOPPAGE": "Technical knockout (doctor's stoppage)",
        "U_DEC": "Unanimous decision",
    },
    "outcome": {
        "D": "Draw", "DRAW": "Draw", "L": "Loss", "LOSS": "Loss", "NC": "No contest",
        "NO_CONTEST": "No contest", "OVERTURNED": "Overturned", "W": "Win", "WIN": "Win",
    },
    "stance": {
        "OPEN_STANCE": "Open stance", "ORTHODOX": "Orthodox", "OTHER": "Other stance",
        "SIDEWAYS": "Sideways stance", "SOUTHPAW": "Southpaw", "SWITCH": "Switch",
        "UNKNOWN": "Unknown stance",
    },
    "warning": {
        "AFTER_CUTOFF": "Date after data cutoff",
        "DEBUT": "UFC debut",
        "LIMITED_HISTORY": "Limited UFC history",
        "ORIENTATION_DISAGREEMENT": "Model orientation disagreement",
        "OUT_OF_RANGE": "Outside training range",
        "STALE": "Stale fighter data",
        "UNSUPPORTED": "Unsupported matchup",
    },
    "weight_class": {"CATCH_WEIGHT_BOUT": "Catchweight", "OPEN_WEIGHT_BOUT": "Openweight"},
}
# order in which the kinds are merged when a key is unknown to its own kind:
# a later kind replaces an earlier one
LABEL_MERGE_ORDER = (
    "confidence", "division", "method", "outcome", "stance", "warning", "weight_class",
)
LABEL_FALLBACK = "Unknown"
PUBLIC_FIELDS = (
    "predicted_at", "model_cutoff", "dataset_cutoff", "division", "probability_a",
    "probability_b", "prior_ufc_fights_a", "prior_ufc_fights_b", "snapshot_date_a",
    "snapshot_date_b", "predicted_winner_name", "is_even_probability",
    "orientation_disagreement", "confidence_tier",
)

# --- fixed values: default model settings and their limits ------------------------------------

# name, depth, learning rate, child weight, row share, column share
DEFAULT_TREES = (
    ("depth2_conservative", 2, 0.03, 5.0, 0.9, 0.9),
    ("depth3_balanced", 3, 0.03, 3.0, 0.9, 0.9),
    ("depth3_regularized", 3, 0.05, 5.0, 0.8, 0.8),
    ("depth4_balanced", 4, 0.025, 4.0, 0.85, 0.85),
    ("depth5_slow", 5, 0.015, 6.0, 0.8, 0.8),
)
TREE_LIMITS = {
    "max_depth": (2, 10), "learning_rate": (0.005, 0.3), "min_child_weight": (0.0, 50.0), "subsample": (0.5, 1.0),
    "colsample": (0.5, 1.0), "gamma": (0.0, 20.0), "max_bin": (32, 2_048), "rounds": (1, 5_000),
}
TREE_SPACE = {
    "max_depth": (2, 7), "learning_rate": (0.01, 0.15), "min_child_weight": (1.0, 12.0), "subsample": (0.6, 1.0),
    "colsample": (0.6, 1.0), "gamma": (0.0, 5.0), "max_bin": (128, 512), "rounds": (200, 2000),
}
