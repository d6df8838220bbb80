"""Fixed values of the fare panel."""

from __future__ import annotations

# Collection eras.
FLI_ERA = "FLI_LIBRARY_ERA"
TRIP_ERA = "TRIP_COM_BROWSER_ERA"
BRIDGE_TRANSITION = f"{FLI_ERA}->{TRIP_ERA}"

# Booking grid in days until departure, farthest first.
BOOKING_WINDOWS = (60, 45, 30, 21, 14, 10, 7, 5, 3, 2, 1)

# Route and highest fare still counted as standard, in VND.
ROUTE_CEILINGS = {
    "SGN-HAN": 5_000_000,
    "HAN-SGN": 5_000_000,
    "SGN-DAD": 3_800_000,
    "DAD-SGN": 3_800_000,
    "HAN-DAD": 4_500_000,
    "DAD-HAN": 4_500_000,
    "SGN-CXR": 2_800_000,
    "CXR-SGN": 2_800_000,
    "SGN-PQC": 2_800_000,
    "PQC-SGN": 2_800_000,
    "HAN-PQC": 5_800_000,
    "PQC-HAN": 5_800_000,
    "DAD-PQC": 3_800_000,
    "PQC-DAD": 3_800_000,
    "HAN-CXR": 5_000_000,
    "CXR-HAN": 5_000_000,
    "SGN-HPH": 3_500_000,
    "HPH-SGN": 3_500_000,
    "HAN-VCA": 5_500_000,
    "VCA-HAN": 5_500_000,
}
EXTREME_FARE = 10_000_000

# Airline codes.
AIRLINES = ("VN", "VJ", "9G", "VU", "QH")

# Market group of a route; every other route is REGIONAL_ALTERNATIVE.
TRUNK_ROUTES = ("SGN-HAN", "HAN-SGN", "SGN-DAD", "DAD-SGN", "HAN-DAD", "DAD-HAN")
TOURISM_ROUTES = (
    "SGN-PQC", "PQC-SGN", "HAN-PQC", "PQC-HAN", "DAD-PQC",
    "PQC-DAD", "SGN-CXR", "CXR-SGN", "HAN-CXR", "CXR-HAN",
)

# Holiday travel periods, both ends included.
PEAK_PERIODS = (
    ("2026-02-14", "2026-02-22"),
    ("2026-04-25", "2026-04-27"),
    ("2026-04-30", "2026-05-03"),
)

# Forecast quantile levels.
QUANTILES = (0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95)

# Right-closed bands as (labels, inner upper edges).
DUD_BUCKETS = (
    ("DUD01_03", "DUD04_07", "DUD08_14", "DUD15_30", "DUD31_60", "DUD61_PLUS"),
    (3, 7, 14, 30, 60),
)
CONFORMAL_DUD_BANDS = (("D0_3", "D4_7", "D8_14", "D15_30", "D31_60", "D61P"), (3, 7, 14, 30, 60))
DEPARTURE_PERIODS = (("NIGHT", "MORNING", "AFTERNOON", "EVENING"), (299, 719, 1019))
HISTORY_BANDS = (("FIRST_0", "COLD_1_2", "WARM_3_PLUS"), (0, 2))
PEER_SUPPORT_BANDS = (("NONE_0", "LOW_1_9", "MEDIUM_10_49", "HIGH_50_PLUS"), (0, 9, 49))
ANCHOR_SUPPORT_BANDS = (
    ("UNSEEN_0", "LOW_1_99", "MEDIUM_100_499", "HIGH_500_1999", "VERY_HIGH_2000_PLUS"),
    (0, 99, 499, 1999),
)
ANCHOR_AGE_BANDS = (("FRESH_LE_12H", "AGE_12_24H", "AGE_24_48H", "STALE_GT_48H"), (12, 24, 48))
SESSION_GAP_BANDS = (("LE_6H", "H6_18", "H18_30", "H30_48", "LONG_GT_48H"), (6, 18, 30, 48))

# Drop-event definitions (kind, fraction, amount).
EVENT_DEFINITIONS_MIN = {
    "any_decrease": ("PCT", 0.0, 0),
    "drop_2pct": ("PCT", 0.02, 0),
    "drop_3pct": ("PCT", 0.03, 0),
    "drop_4pct": ("PCT", 0.04, 0),
    "drop_5pct": ("PCT", 0.05, 0),
    "drop_50k": ("VND", 0.0, 50_000),
    "drop_5pct_or_50k": ("MIN", 0.05, 50_000),
}
EVENT_DEFINITIONS_MAX = {
    "drop_50k": ("VND", 0.0, 50_000),
    "drop_2pct": ("PCT", 0.02, 0),
    "drop_3pct": ("PCT", 0.03, 0),
    "drop_4pct": ("PCT", 0.04, 0),
    "drop_5pct": ("PCT", 0.05, 0),
    "drop_max_5pct_50k": ("MAX", 0.05, 50_000),
}

# Decision policy.
WAIT_THRESHOLD = 0.30
FRICTION_VND = 50_000
FRICTIONS_VND = (0, 25_000, 50_000, 100_000)
THRESHOLDS = tuple(round(0.20 + 0.05 * i, 2) for i in range(13))
UNSAFE_BUY_WEIGHT = 2.0

# Shrinkage strengths of the two-level drop-rate hierarchy.
TRANSITION_KAPPA = 3000.0
GRANULAR_KAPPA = 1600.0

# Smallest support of a backoff level, of a conformal group and of a peer median.
BACKOFF_MIN_SUPPORT = 100
CONFORMAL_MIN_SUPPORT = 100
PEER_MIN_SUPPORT = 3
SEQUENCE_LENGTH = 21
SEQUENCE_GAP_CLIP_HOURS = 3072.0
