"""Numbers every operator turns on, as arguments' defaults.

Everything here is a fixed value: it must equal the published choice for the
results to be right, so it is stated once, plainly, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

KEY = ("source", "cell_id")
MEASURES = ("tasmax", "tasmin", "tas", "pr", "clt", "hurs", "sfcWind", "psl", "rsds")
TEMPERATURES = ("tasmax", "tasmin", "tas")

# --- fixed values: served periods ------------------------------------------
PERIODS = (
    ("era5", date(1970, 1, 1), date(2025, 12, 31), "observed"),
    ("cordex", date(2027, 1, 1), date(2100, 12, 31), "simulated"),
)
FIRST_YEAR, LAST_YEAR = 1970, 2100
SIMULATED = "cordex"

# --- fixed values: daily record names ----------------------------------------
RECORD_FIELDS = {
    "tasmax": "temperature_max",
    "tasmin": "temperature_min",
    "tas": "temperature_mean",
    "pr": "precipitation",
    "clt": "cloud_cover",
    "hurs": "relative_humidity_mean",
    "sfcWind": "wind_speed_mean",
}
KMH_PER_MS = 3.6

# --- fixed values: packed storage (step, unsigned) ---------------------------
PACKING = {
    "tasmax": (0.01, False),
    "tasmin": (0.01, False),
    "tas": (0.01, False),
    "pr": (0.1, True),
    "clt": (0.01, True),
    "hurs": (0.01, True),
    "sfcWind": (0.01, True),
    "psl": (0.1, True),
    "rsds": (0.1, True),
}
INT16_FILL, UINT16_FILL = -32768, 65535

# --- fixed values: search limits ---------------------------------------------
MAX_DAYS = 92
MIN_ELEVATION_M, MAX_ELEVATION_M = -500.0, 6000.0

# --- fixed values: classes ----------------------------------------------------
WET_DAY_MM = 1.0
SNOW_SKY_C = 1.5
OVERCAST_PERCENT, CLOUDY_PERCENT = 70.0, 30.0
BAND_EDGES = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0, 30.0, 35.0, 40.0)
HUMID_HEAT_C, HUMID_HEAT_EXTREME_C = 26.0, 30.0
NEAR_SIGMAS, MUCH_SIGMAS = 0.5, 1.5
RAIN_RATIOS = (0.5, 0.8, 1.2, 1.5)
TONE_K = 5.0

# --- fixed values: altitude lift (K per km, January to December) --------------
LAPSE_TASMIN = (2.4, 3.3, 4.1, 4.2, 4.2, 4.2, 4.0, 3.6, 3.6, 3.1, 3.0, 2.4)
LAPSE_TASMAX = (3.9, 5.7, 7.5, 8.4, 8.4, 8.0, 7.8, 7.6, 7.2, 6.1, 4.7, 3.5)
MAX_LIFT_M = 2500.0
PLAIN_LAPSE = 6.5

# --- fixed values: snow and soil ------------------------------------------------
SNOW_FALL_C = 0.5
SNOW_MELT_MM = 4.0
SNOW_STOCK_MM = 2.0
SNOW_SEASON_MONTHS = (11, 12, 1, 2, 3, 4)
SNOW_RESET_MONTH = 8
SNOW_MAX_ELEVATION_M = 800.0
SNOW_RARE_DAYS = 3.0
SNOW_BASELINE = (1991, 2020)
SOIL_CAPACITY_MM = 100.0
SOIL_DEPLETION_FRACTION = 0.5

# --- fixed values: normals, windows, epochs -------------------------------------
REFERENCES = (1971, 1981, 1991)
REFERENCE_YEARS = 30
POOL_HALF_WINDOW = 7
MAP_NORMAL_DAYS = 31
CLIMATE_SPAN = 15
EPOCHS = (("old", 1970, 2010), ("new", 2011, 2050), ("future", 2051, 2100))
KIND_SHARE = 0.2
NAMED_YEARS = 3
TYPICAL_MIN_YEARS = 20

# --- fixed values: correction ----------------------------------------------------
LEVELS = 100
MAX_RATIO = 10.0
MIN_WET_DAYS = 30
SLIDING_YEARS = 30
WINTER_MONTHS = (12, 1, 2, 3)
ALL_MONTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
DAY_SECONDS = 86400.0


@dataclass(frozen=True)
class Variable:
    """How one variable is corrected."""

    kind: str  # "add" or "mul"
    low: float | None = None
    high: float | None = None
    wet: float | None = None
    mean_only: tuple[int, ...] = ()
    derived: bool = False


# Form, bounds and special months of each corrected variable.
VARIABLES = {
    "tas": Variable("add"),
    "tasmax": Variable("add"),
    "tasmin": Variable("add"),
    "pr": Variable("mul", low=0.0, wet=1.0 / DAY_SECONDS),
    "hurs": Variable("add", low=0.0, high=100.0),
    "huss": Variable("mul", low=0.0, derived=True),
    "clt": Variable("add", low=0.0, high=100.0),
    "sfcWind": Variable("mul", low=0.0),
    "rsds": Variable("mul", low=0.0),
    "rlds": Variable("add", low=0.0),
    "rsus": Variable("mul", low=0.0, derived=True),
    "alb": Variable("add", low=0.0, high=1.0),
    "ps": Variable("add", mean_only=WINTER_MONTHS),
    "evspsbl": Variable("add"),
    "zg500": Variable("add", mean_only=WINTER_MONTHS),
    "psl": Variable("add", mean_only=ALL_MONTHS),
}

# --- fixed values: grids, remap, reference ----------------------------------------
COARSE_STEP, FINE_STEP = 0.25, 0.1
FINE_RADIUS = 0.1
MIN_COVERAGE = 0.9
SUBCELLS = 20
COMPLETE_SHARE = 0.99
MIN_LAND_SHARE = 0.5

# --- fixed values: places -----------------------------------------------------------
EARTH_KM = 6371.0
NEAREST_MAX_KM = 50.0
CONTRAST_POPULATION = 500_000
CONTRAST_SHIFT_DEG = 7.2
CONTRAST_SOUTH_LAT = 44.0
CONTRAST_AWAY_KM = 300.0
EUROPE = (
    "AD", "AL", "AT", "BA", "BE", "BG", "BY", "CH", "CY", "CZ", "DE", "DK", "EE", "ES",
    "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IS", "IT", "LI", "LT", "LU", "LV", "MC",
    "MD", "ME", "MK", "MT", "NL", "NO", "PL", "PT", "RO", "RS", "RU", "SE", "SI", "SK",
    "SM", "UA", "VA", "XK",
)

# --- fixed values: heat waves, warming levels, indices ------------------------------
HEAT_S1, HEAT_S2, HEAT_S3 = 0.995, 0.975, 0.95
HEAT_MIN_DAYS, HEAT_MAX_DIP = 3, 2
WARMING_LEVELS = (1.4, 2.1, 3.4)
TREND_YEARS = 20

# --- fixed values: soil water -------------------------------------------------------
MJ_PER_W = 0.0864
STEFAN_BOLTZMANN = 4.903e-9
GRASS_ALBEDO = 0.23
