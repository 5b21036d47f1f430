"""Domain constants. Everything here is a fixed value of the field protocol or of the data products."""

# --- survey bounds and metric grid -------------------------------------------------------------
LAT_BOUNDS = (-26.0, -11.0)
LON_BOUNDS = (43.0, 51.0)
CELL_SIZE_M = 1000.0

# --- season calendar: October (1) ... July (10) ------------------------------------------------
SEASON_MONTHS = (10, 11, 12, 1, 2, 3, 4, 5, 6, 7)
DECADES_PER_SEASON = 30
PANEL_EPOCH = "2001-10-01"
PANEL_EPOCH_YEAR = 2001
SKIPPED_CAMPAIGNS = ("2023-2024",)

# --- potential matrix: density class 0..7 (right-closed bins) per phase level -------------------
DENSITY_BINS = (0.0, 10.0, 100.0, 500.0, 1500.0, 2500.0, 10000.0)
POTENTIAL = {
    "absent": (0, 0, 0, 0, 0, 0, 0, 0),
    "S": (0, 1, 1, 2, 2, 3, 3, 3),
    "St": (0, 1, 2, 2, 3, 3, 3, 3),
    "T": (0, 2, 2, 2, 3, 3, 3, 4),
    "T1": (0, 2, 2, 2, 3, 3, 3, 4),
    "T2": (0, 2, 2, 2, 3, 3, 4, 4),
    "T3": (0, 2, 2, 3, 3, 3, 4, 5),
    "G": (0, 2, 2, 3, 3, 3, 4, 5),
}
PHASES = ("S", "St", "T", "G")
PHASE_LEVELS = ("absent", "S", "St", "T", "G")

# --- severity ------------------------------------------------------------------------------------
SEVERITY_LEVELS = (0, 1, 2, 3)
PHASE_COUNTERS = {3: ("Greg", "Greg_larve"), 2: ("Trans", "Trans_larve"), 1: ("Sol", "Sol_larve")}
LABEL_KEYS = ("cell_id", "campagne_calc", "campagne_decade")

# --- covariates -----------------------------------------------------------------------------------
RAIN_BAND = (50.0, 125.0)
LAGGED = ("chirps_sum_mean", "ndvi_mean", "evi_mean", "lst_mean")
RAIN_WINDOW = (0, 1)          # (lead, lag) days around a decade
VEGETATION_WINDOW = (8, 9)
TEMPERATURE_WINDOW = (4, 5)
VEGETATION_SCALE = 0.0001
TEMPERATURE_SCALE = 0.02
NATIVE_SCALES_M = {"rain": 5566, "vegetation": 250, "temperature": 1000}
CLIMATOLOGY_YEARS = (1981, 2010)
CUBE_META = (
    "cell_id", "AIRE_CODE", "campagne_calc", "campagne_decade",
    "date_start", "date_end", "year", "month", "decade_part",
)

# --- model tables ---------------------------------------------------------------------------------
NON_PREDICTORS = (
    "cell_id", "campagne_calc", "date_start", "date_end", "year",
    "severite", "intensite", "binaire", "a_predire", "effort_prospection",
)
REGION_KEYS = ("rn_num", "rn_nom", "campagne_calc", "campagne_decade")
REGION_META = ("split", "effort_prospection", "label", "date_start")
REGION_TARGETS = ("densite_imago_median", "niveau_gregarite_dominant")
BASELINE_MODEL = "regression_ordinale"
HORIZONS = {"decadaire": 1, "mensuel": 3, "saisonnier": 10}

# probability thresholds 0.05, 0.06, ... 0.50 (46 values of an evenly spaced grid)
THRESHOLDS = tuple(0.05 + i * ((0.50 - 0.05) / 45) for i in range(45)) + (0.50,)

# --- text kit -------------------------------------------------------------------------------------
KEYWORDS = (
    "criquet", "locuste", "grégaire", "solitaire", "pullulation", "essaim", "grégarisation",
    "migration", "surveillance", "lutte", "prévention", "NDVI", "télédétection", "Madagascar", "climat",
)
