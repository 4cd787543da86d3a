"""Fixed values the results depend on.

These values must equal the reference behaviour for matching results; they
are stated here once, plainly, and every operator reads them from here.
"""

# ---------------------------------------------------------------- fixed values
# Window lengths in ticks (a tick is one minute in the original data model).
WINDOW_5 = 5
WINDOW_15 = 15
WINDOW_LOAD = 2
WINDOW_1 = 1
ACTIVE_ROWS_5 = 5            # bank / network rates: previous 5 populated ticks

FLAG_DOWN_THRESHOLD = 0.70   # route flagged down when trailing 5-tick rate < this
NO_EVENT_SENTINEL = 9999.0   # "never happened" for time-since features
BANK_ROUTE_SHRINK_K = 10     # pseudo-count of the bank x route shrinkage prior
TRAIN_FRACTION = 0.75        # first 75 % of the timeline is training data
VALIDATION_FRACTION = 0.20   # last 20 % of training rows (by time) validate
LATENCY_EPS = 1e-6           # added to the base latency in the latency ratio

TICKS_PER_DAY_AT_MINUTE = 1440
MINUTES_PER_HOUR = 60

# Business cost model.
FAILURE_COST_FIXED = 50.0
FAILURE_COST_PCT_OF_AMOUNT = 0.02
TARGET_FAILURE_RECALL = 0.50
COST_MULTIPLIERS = (0.5, 1.0, 2.0, 3.0, 5.0, 10.0)
# Failure-probability thresholds printed in the threshold analysis table.
ANALYSIS_THRESHOLDS = (0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10,
                       0.075, 0.05, 0.025, 0.01)
# Cost sweep: 0.02, 0.04, ..., 0.54 (27 values), rounded to 3 dp.
COST_SWEEP_START = 0.02
COST_SWEEP_STEP = 0.02
COST_SWEEP_COUNT = 27

# Weighted-random router weights (also the traffic share of each route).
ROUTE_WEIGHTS = {"R1": 0.35, "R2": 0.25, "R3": 0.25, "R4": 0.15}

# Static route dimension: id, base success rate, base latency ms,
# fee percent, payment methods, networks, base capacity tps.
ROUTES = (
    ("R1", 0.986, 145, 2.10, ("CARD", "UPI"), ("Visa", "Mastercard", "UPI"), 120000),
    ("R2", 0.981, 85, 1.45, ("CARD", "UPI"), ("Visa", "Rupay", "UPI"), 150000),
    ("R3", 0.979, 110, 1.10, ("CARD", "UPI"), ("Visa", "Mastercard", "Rupay", "UPI"), 100000),
    ("R4", 0.983, 175, 1.75, ("CARD", "UPI"), ("Visa", "Mastercard", "Rupay", "UPI"), 75000),
)
ROUTE_IDS = tuple(r[0] for r in ROUTES)

# Capacity multiplier by observed health label.
HEALTH_CAPACITY_MULTIPLIER = {"HEALTHY": 1.00, "DEGRADED": 0.60, "OUTAGE": 0.00}

# Amount clamp.
AMOUNT_MIN = 10.0
AMOUNT_MAX = 50000.0
# Amounts from which risk is medium and high.
RISK_BAND_EDGES = (1000.0, 5000.0)

# How long a decision waits for its outcome (seconds).
PENDING_TTL_SECONDS = 3600

# Calibration bins.
CALIBRATION_BINS = 10

# Model matrix: numeric and categorical inputs, in model order.
NUMERIC_FEATURES = (
    "day_in_week", "hour_of_day", "amount",
    "route_base_success_rate", "route_base_latency_ms", "route_cost_percent",
    "route_success_rate_5m", "route_success_rate_15m", "route_avg_latency_5m",
    "route_utilization", "system_tps",
    "time_since_last_failure", "route_flagged_down",
    "bank_route_success_rate_15m",
    "route_failure_rate_5m", "route_failure_rate_15m",
    "route_success_drop_5m", "route_success_drop_15m",
    "route_latency_ratio", "bank_route_gap", "route_stress",
    "bank_failure_rate_5m", "network_failure_rate_5m", "route_failure_rate_1m",
    "time_since_last_bank_route_success", "amount_to_bank_avg_ratio",
)
# Numeric inputs of the baseline model, which has no weights and no derived inputs.
BASELINE_NUMERIC_FEATURES = (
    "tick", "day_in_week", "hour_of_day", "amount",
    "route_base_success_rate", "route_base_latency_ms", "route_cost_percent",
    "route_success_rate_5m", "route_success_rate_15m", "route_avg_latency_5m",
    "route_current_load", "route_requests_1m",
    "time_since_last_failure", "route_flagged_down",
    "bank_route_success_rate_15m",
)
CATEGORICAL_FEATURES = ("bank", "network", "payment_method", "merchant", "device", "risk", "route_id")

# Feature table (v2): 28 columns in output order.
FEATURE_TABLE_COLUMNS = (
    "txn_id", "tick", "day_in_week", "hour_of_day",
    "amount", "bank", "network", "payment_method", "merchant", "device", "risk",
    "route_id", "route_base_success_rate", "route_base_latency_ms", "route_cost_percent",
    "route_success_rate_5m", "route_success_rate_15m", "route_avg_latency_5m",
    "route_current_load", "route_requests_1m", "time_since_last_failure",
    "route_flagged_down", "route_utilization", "route_effective_capacity_tps", "system_tps",
    "bank_route_success_rate_15m", "success", "dataset_split",
)
# --------------------------------------------------------------- end fixed values
