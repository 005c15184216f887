"""Fixed values.

Everything in this module must equal the values the original pipeline uses,
otherwise results differ.  They are listed plainly, in the order the
original states them.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original pipeline)
# ---------------------------------------------------------------------------

# Transaction feed columns, in feed order.
REQUIRED_COLUMNS = [
    "transaction_id",
    "user_id",
    "amount",
    "event_time",
    "hour",
    "device_risk",
    "location_risk",
    "txn_velocity",
    "edge_fraud_probability",
    "status",
]

# Trailing frame lengths of the feature job, in seconds.
WINDOW_24H_SECONDS = 24 * 60 * 60
WINDOW_10M_SECONDS = 10 * 60

# Rule flag (cloud_rule_risk): first matching branch wins.
RULE_PROBABILITY_MIN = 0.8        # edge_fraud_probability >= 0.8
RULE_BURST_COUNT_MIN = 4          # rolling_txn_count_10m >= 4
RULE_NIGHT_AMOUNT_ABOVE = 250000  # amount > 250000 ...
RULE_NIGHT_HOUR_MAX = 4           # ... and hour <= 4

# Edge heuristic score: sigmoid of a linear score minus an offset.
HEURISTIC_AMOUNT_WEIGHT = 0.00002
HEURISTIC_NIGHT_WEIGHT = 0.8      # applied when hour <= 4
HEURISTIC_NIGHT_HOUR_MAX = 4
HEURISTIC_DEVICE_WEIGHT = 1.4
HEURISTIC_LOCATION_WEIGHT = 1.2
HEURISTIC_VELOCITY_WEIGHT = 0.15
HEURISTIC_OFFSET = 2.2

# Edge decision.
BLOCK_THRESHOLD = 0.95
BLOCK_REASON = "Edge anomaly threshold exceeded"
APPROVE_REASON = "Standard transfer pattern"
DEFAULT_REASON = "standard transaction pattern"

# Audit risk band.
FLAG_PROBABILITY_MIN = 0.65

# Device and location risk from browser signals.
NEW_DEVICE_RISK = 0.78
KNOWN_DEVICE_RISK = 0.12
OUTSIDE_REGION_RISK = 0.85     # time zone not starting with "Asia/"
IN_REGION_OTHER_RISK = 0.35    # "Asia/..." but not the home zone
HOME_ZONE_RISK = 0.08
REGION_PREFIX = "Asia/"
HOME_ZONE = "Asia/Kolkata"

# Validation bounds of a transaction payload.
TXN_HOUR_MIN, TXN_HOUR_MAX = 0, 23
TXN_RISK_MIN, TXN_RISK_MAX = 0.0, 1.0
TXN_VELOCITY_MIN, TXN_VELOCITY_MAX = 0.0, 10000.0
TXN_STATUSES = ["approved", "blocked"]
TXN_REASON_MAX_CHARS = 240

# Validation bounds of a profile update.
PROFILE_NAME_MIN_CHARS, PROFILE_NAME_MAX_CHARS = 2, 80
PROFILE_MONEY_MIN, PROFILE_MONEY_MAX = 0, 999999999
RISK_APPETITES = ["conservative", "balanced", "aggressive"]
DEFAULT_RISK_APPETITE = "balanced"

# Ledger messages.
MSG_BLACKLISTED = "Account locked by Cloud Risk Intelligence (R-Cluster Anomaly)."
MSG_FAILED = "Transaction processing failed."
MSG_INVALID = "Invalid transaction payload."
MSG_NO_PROFILE = "Financial profile not found."
MSG_INSUFFICIENT = "Insufficient account balance."
MSG_ACCEPTED = "Transaction forwarded to cloud processor"

# Page sizes of the read side.
LATEST_DEFAULT_LIMIT = 20
LATEST_MIN_LIMIT, LATEST_MAX_LIMIT = 1, 200
TOP_RISK_ROWS = 3
FEED_ROWS = 7

# Risk analysis.
CITIES = [
    ("Mumbai", 19.0760, 72.8777),
    ("Delhi", 28.6139, 77.2090),
    ("Bengaluru", 12.9716, 77.5946),
    ("Hyderabad", 17.3850, 78.4867),
    ("Chennai", 13.0827, 80.2707),
]
RISK_SEED = 42
OVERSAMPLE_FACTOR = 2             # draw min(n_normal, 2 * n_flagged)
CLUSTER_FEATURES = ["amount", "device_risk", "location_risk", "rolling_total_spend_24h"]
CLUSTER_K = 3
CLUSTER_STARTS = 10
CLUSTER_MAX_ITER = 10            # the default iteration cap of the original clustering call
RISK_WEIGHTS = [                  # 100 * (sum of weight * minmax(column)) + flag bonus
    ("amount", 0.30),
    ("rolling_total_spend_24h", 0.25),
    ("location_risk", 0.20),
    ("device_risk", 0.20),
]
RISK_FLAG_WEIGHT = 0.05
BLACKLIST_SCORE_ABOVE = 75
BLACKLIST_REASON = "Cluster anomaly detected by R"

# Model training.
MODEL_FEATURES = ["amount", "hour", "device_risk", "location_risk", "txn_velocity"]
MODEL_LABEL = "Class"
MODEL_SEED = 42
VALIDATION_FRACTION = 0.2
HIDDEN_LAYERS = [16, 8]
BATCH_SIZE = 128
EPOCHS = 20
PATIENCE = 3
AUC_GATE = 0.85
CARD_MINMAX_EPS = 1e-9
CARD_VELOCITY_FACTOR = 2.0
CARD_VELOCITY_MAX = 25.0
