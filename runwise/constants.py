"""Fixed values.

FIXED VALUES — these must equal the analysed model's values for results to
match.  They are stated plainly, in natural order, in one place.
"""

from __future__ import annotations

# --- FIXED VALUES: speeds, rates, factors -----------------------------------
SLOW_SPEED_MS = 50.0          # runway-occupancy / slow-point speed threshold, m/s
TAXI_SPEED_MS = 11.83         # taxi speed, m/s
ROT_BENEFIT = 1.11
AIRPORT_SAVINGS_FACTOR = {"KPHX": 0.25, "KATL": 0.291667, "KBWI": 0.125}   # any other airport: 0
PASSENGER_RATE = {"GA": 0.26, "Small": 0.66, "Medium": 2.03, "Large": 3.75, "Super": 6.83}  # $/s, unknown: 0
FUEL_RATE = 0.1796667         # $/s
CREW_RATE = 0.271
MAINT_RATE = 0.2003333
OWNERSHIP_RATE = 0.132
ENV_RATE = 0.6
OTHER_RATE = 0.0451667
DEFAULT_SIZE_CLASS = "GA"
FEET_TO_M = 0.3048
M_TO_FEET = 3.28084

# --- FIXED VALUES: feature extraction --------------------------------------
TRAFFIC_HALF_WINDOW_MS = 900000   # both ends open
DECEL_POSITIONS = 20
DECEL_CUT = -0.5                  # keep decel <= this
MIN_ITEMS = 5                     # links / positions must have more items than this
BOX_LAT_TOLERANCE = 0.00016
BOX_ANGLE_TOLERANCE = 4.0
NO_ANGLE = -999.0

# --- FIXED VALUES: ellipsoid (WGS-84) and iteration ------------------------
WGS84_A = 6378137.0
WGS84_B = 6356752.314245
WGS84_F = 1 / 298.257223563
GEO_MAX_ROUNDS = 95
GEO_EPSILON = 1e-12

# --- FIXED VALUES: model ------------------------------------------------------
SPLIT_WEIGHTS = (0.7, 0.3)
SPLIT_SEED = 4873
FOREST_SEED = 4283
FOREST_IMPURITY = "entropy"
FOREST_SUBSET = "sqrt"
FOREST_SUBSAMPLING = 1.0
FOREST_MAX_BINS = 500
FOREST_TREES = (40, 85, 115, 165)
FOREST_DEPTHS = (5, 6, 7, 8)
TUNE_TREES = (105, 115)
TUNE_DEPTH = 7
TUNE_FOLDS = 10
SAMPLE_CAP = 50

# --- FIXED VALUES: link-name patterns (unanchored find) ------------------------
RUNWAY_LINK_PATTERN = r"[0-9]+\D?\/[0-9]+\D(\D|\.)?\D?\D?[0-9]+?\D?\_[0-9]+\D?\/[0-9]+\D(\D|\.)?\D?\D?[0-9]+?\D?"
EXIT_LINK_PATTERN = r"[0-9]+\D?\/[0-9]+\D?(\.|\D)\D?\D?[0-9]+"

# --- FIXED VALUES: airport names -> ICAO code (case-insensitive full match) ----
AIRPORT_NAMES = {
    "PHX": "KPHX", "PHOENIX": "KPHX",
    "ATL": "KATL", "ATLANTA": "KATL",
    "BWI": "KBWI", "BALTIMORE": "KBWI",
    "DEN": "KDEN", "DENVER": "KDEN",
}

# All features a user may choose from; `runway` is always used.
ALL_FEATURES = ("runway", "depAirport", "aircraftType", "arrGate", "touchdownLat", "touchdownLong",
                "hour", "day", "decel", "carrier", "traffic")
MIN_FEATURES = 5
