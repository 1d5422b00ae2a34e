"""Fixed values of the domain: unit factors, airline prefixes, regions, bands, thresholds."""

from __future__ import annotations

from datetime import timedelta
from typing import NamedTuple

FEET_PER_METER = 3.28084
KNOTS_PER_METER_PER_SECOND = 1.94384
TYPICAL_CRUISE_KNOTS = 460

# Airline and its callsign prefixes. The first match in this order wins, so DLH falls
# to Delta through the shorter prefix DL.
AIRLINE_PREFIXES = [
    ("Emirates", ["EK", "UAE"]),
    ("Ryanair", ["RYR", "FR"]),
    ("American", ["AAL", "AA"]),
    ("Delta", ["DAL", "DL"]),
    ("United", ["UAL", "UA"]),
    ("Lufthansa", ["DLH", "LH"]),
    ("IndiGo", ["IGO", "IN"]),
    ("British Airways", ["BAW", "BA"]),
    ("Air France", ["AFR", "AF"]),
    ("Qatar Airways", ["QTR", "QR"]),
    ("Singapore Air", ["SIA", "SQ"]),
    ("Turkish Airlines", ["THY", "TK"]),
    ("Saudia", ["SVA", "SV"]),
    ("Air India", ["AIC", "AI"]),
]
OTHER_AIRLINE = "Other"


class Region(NamedTuple):
    name: str
    lat_min: float
    lat_max: float
    lon_min: float
    lon_max: float


# Regions of the map table. Bounds are inclusive and the boxes overlap.
MAP_REGIONS = [
    Region("North America", 15, 72, -170, -52),
    Region("Europe", 34, 72, -25, 45),
    Region("Asia Pacific", -10, 70, 60, 180),
    Region("Middle East", 12, 42, 35, 65),
    Region("South America", -60, 15, -82, -34),
    Region("Africa", -35, 38, -20, 52),
    Region("Oceania", -50, -10, 110, 180),
]

# Regions of the activity scores.
SCORE_REGIONS = [
    Region("N.America", 15, 72, -170, -52),
    Region("Europe", 34, 72, -25, 45),
    Region("Asia-Pac", -10, 70, 60, 180),
    Region("Mid-East", 12, 42, 35, 65),
    Region("S.America", -60, 15, -82, -34),
    Region("Africa", -35, 38, -20, 52),
    Region("Oceania", -50, -10, 110, 180),
    Region("Russia-CIS", 50, 80, 30, 180),
]

# Altitude bands in display order, with their upper bounds in feet.
GROUND_BAND = "Ground"
ALTITUDE_BANDS = [("Low", 3000), ("Climbing", 15000), ("Cruise", 45000)]
TOP_ALTITUDE_BAND = "High Alt"
BAND_ORDER = ["Ground", "Low", "Climbing", "Cruise", "High Alt"]

# Bands of the two speed/altitude scatter charts.
PERFORMANCE_BANDS_3 = [("low", 3000), ("climbing", 15000)]
PERFORMANCE_TOP_3 = "cruise"
PERFORMANCE_BANDS_5 = [("ground", 1000), ("low", 10000), ("climbing", 25000), ("cruise", 40000)]
PERFORMANCE_TOP_5 = "high"

LOW_ALTITUDE_FEET = 3000
CRUISE_EVENT_METERS = 9000

LONGITUDE_BINS = 72
# Density classes by share of the fullest bin, strictly above the bound.
DENSITY_LEVELS = [("high", 0.7), ("medium", 0.3), ("low", 0.05)]
DENSITY_FLOOR = "minimal"

GHOST_RUN_GRACE = timedelta(seconds=30)
GHOST_AGE = timedelta(minutes=2)
GHOST_MAX_MINUTES = 15
CYCLE_INTERVAL = timedelta(seconds=180)
LIVE_RETENTION = timedelta(minutes=30)
HISTORY_RETENTION = timedelta(hours=1)
ANOMALY_RETENTION = timedelta(hours=25)
RUN_RETENTION = timedelta(days=3)
OUTAGE_SECONDS = 3600
#: A snapshot whose time lies further ahead of its landing is rejected.
CLOCK_TOLERANCE = timedelta(minutes=5)
# Texts that consumers compare.
EMPTY_FETCH_MESSAGE = "Empty response from OpenSky"
#: The run of a rejected snapshot, at its landing; it is no cycle.
FUTURE_MESSAGE = "Snapshot dated ahead of its landing"

HIT_RADIUS_PX = 14
TILE_PX = 256
FEED_SIZE = 28
FEED_CRUISE_PICKS = 2
# Fixed value: what stands for a missing field.
NO_VALUE = "—"
