"""Fixed values the semantics depend on.

FIXED VALUES: these must equal the behaviour being reproduced (word lists,
thresholds, bin edges, feature order, sizes). They are stated plainly, in
natural order, and are passed as parameters to the operators.
"""

# Position code -> label.
POSITION_LABELS = {1: "GKP", 2: "DEF", 3: "MID", 4: "FWD"}
POSITIONS = ["GKP", "DEF", "MID", "FWD"]

# Keywords marking an injury note (substring match on the lower-cased note).
INJURY_KEYWORDS = ["injury", "injur", "doubt", "ill", "operation", "surgery",
                   "knock", "strain", "hamstring", "suspended", "ban"]
LOAN_KEYWORD = "loan"

# Right-closed bins: (-0.01, 2] cold, (2, 4] average, (4, 7] hot, (7, 100] elite.
FORM_EDGES = [-0.01, 2.0, 4.0, 7.0, 100.0]
FORM_LABELS = ["cold", "average", "hot", "elite"]
# Right-closed bins for ownership percentage.
OWNERSHIP_EDGES = [-0.01, 5.0, 15.0, 30.0, 100.0]
OWNERSHIP_LABELS = ["differential", "medium", "popular", "template"]

# Availability: chance of playing (NULL counts as 100) must reach this.
AVAILABLE_MIN_CHANCE = 75
# xP penalties and clamp.
INJURY_FACTOR = 0.3
UNAVAILABLE_FACTOR = 0.1
XP_MIN, XP_MAX = 0.0, 15.0
EASE_BASE = 6.0
EASE_EPS = 1e-9
MINMAX_EPS = 1e-9

# Feature order (22).
FEATURE_COLS = [
    "avg_minutes_per_gw", "appearance_rate",
    "goals_per_90", "assists_per_90", "cs_per_90", "bonus_per_90",
    "gc_per_90", "ict_per_90",
    "form", "ownership",
    "price",
    "strength",
    "team_avg_goals_scored", "team_avg_goals_conceded",
    "avg_opp_strength", "fixture_count", "fixture_ease",
    "has_injury_news",
    "pos_DEF", "pos_FWD", "pos_GKP", "pos_MID",
]
TARGET = "xP"

# Advice thresholds per position: elite / good / bench. Unknown position uses MID.
ADVICE_THRESHOLDS = {
    "GKP": (5.0, 3.5, 2.0),
    "DEF": (5.5, 3.5, 2.0),
    "MID": (6.0, 4.0, 2.5),
    "FWD": (6.5, 4.5, 2.5),
}
ADVICE_DEFAULT_POSITION = "MID"
ADVICE_AVOID_STATUS = "🔴 Avoid — Injury/availability concern"
ADVICE_STRONG = "🟢 Strong Start — High expected returns"
ADVICE_GOOD = "✅ Good Start — Solid pick this GW"
ADVICE_BENCH = "🟡 Bench — Consider alternatives"
ADVICE_AVOID_LOW = "🔴 Avoid — Low expected output"

# Composite score weights: prediction, value, form, fixture ease, availability.
COMPOSITE_WEIGHTS = (40.0, 20.0, 15.0, 15.0, 10.0)

# Intent keywords (substring hits on the lower-cased question).
NEWS_INTENT_KEYWORDS = [
    "injury", "injured", "injur", "fit", "fitness", "doubt", "doubtful",
    "ill", "illness", "operation", "surgery", "knock", "strain", "hamstring",
    "suspended", "suspension", "ban", "banned", "available", "unavailable",
    "return", "returning", "out", "ruled", "news", "update", "latest",
    "status", "absence", "absent", "recover", "recovery", "muscle",
    "red card", "yellow card",
]
STATS_INTENT_KEYWORDS = [
    "predict", "prediction", "points", "score", "worth", "price", "value",
    "cost", "pick", "buy", "sell", "transfer", "invest", "ownership",
    "selected", "xg", "expected goals", "expected assists", "xa",
    "bps", "bonus", "ict",
]
# Stop list for the capitalised-word name detector.
NAME_STOPWORDS = [
    "should", "i", "is", "are", "what", "how", "when", "will", "can",
    "the", "a", "an", "about", "for", "to", "his", "her", "their",
    "injury", "news", "update", "points", "score", "form", "fit",
    "play", "playing", "bench", "start", "captain", "available",
    "predict", "worth", "price", "value", "pick", "buy", "sell",
]
PROPER_NOUN_PATTERN = "[A-Z][a-z]+"

# Text index sizes.
CHUNK_SIZE = 600
CHUNK_OVERLAP = 100
HISTORY_TURNS = 4
RETRIEVE_K = 6
ANSWER_K = 5
MMR_LAMBDA = 0.5
SEARCH_LIMIT = 10
NEWS_SOURCE_OFFICIAL = "FPL Official"
NOTE_URL_PREFIX = "fpl://player-news/"
NOTE_TITLE_SUFFIX = " — FPL Update"

# Train / test split and tree parameters.
TEST_FRACTION = 0.2
SPLIT_SEED = 42
RF_PARAMS = dict(numTrees=300, maxDepth=8, minInstancesPerNode=3,
                 featureSubsetStrategy="sqrt", seed=42)
GBT_PARAMS = dict(maxIter=300, maxDepth=4, stepSize=0.05, subsamplingRate=0.8,
                  featureSubsetStrategy="0.8", seed=42)
CV_FOLDS = 5

# Fixed values of the answers: questions without a match, the sentence of a prediction, display labels.
NOT_FOUND_NEWS = "Player not found in database."
NOT_FOUND_ADVICE = "Try searching by the player's FPL web name (e.g., Salah, Haaland, Saka)."
EXPECTED_NEWS = ("Expected ", " pts next GW based on form, fixtures, and historical performance.")
LABEL_PREDICTION = "**ML Prediction** — "
LABEL_ANALYSIS = " pts\n\n**Analysis**\n"
