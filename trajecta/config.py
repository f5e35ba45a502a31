"""Settings of the analysis, plus the limits that decide how a job is planned."""

from __future__ import annotations

# The analysis defaults and the label/target dimension of the
# eight standard process parameters.
GRID_POINTS = 100
GOLDEN_PERCENTILE = 0.75
GOOD_PERCENTILE = 0.50
GOLDEN_LADDER = (0.75, 0.67, 0.60, 0.50)
TRAINING_LADDER = ((0.75, "p75"), (0.60, "p60"), (0.50, "p50"))
K_SIGMA = 2.0
BAND_ALPHA = 0.05
OUTLIER_IQR = 2.5
LIMIT_PERCENTILES = (95, 99)
MONITOR_COMPONENTS = 5
MONITOR_VARIANCE = 0.90
RANKING_COMPONENTS = 5
RANKING_VARIANCE = 0.85
FORECAST_COMPONENTS = 5
BOOTSTRAP_REPS = 500

VARIABLES = (
    "temperature", "pH", "dissolved_o2", "agitation",
    "pressure", "feed_rate", "foam_level", "conductivity",
)
LABELS = {
    "temperature": "Temperature (°C)",
    "pH": "pH",
    "dissolved_o2": "Dissolved O₂ (%)",
    "agitation": "Agitation (RPM)",
    "pressure": "Pressure (bar)",
    "feed_rate": "Feed Rate (L/h)",
    "foam_level": "Foam Level (%)",
    "conductivity": "Conductivity (mS/cm)",
}
TARGETS = {
    "temperature": 37.0,
    "pH": 7.2,
    "dissolved_o2": 40.0,
    "agitation": 190.0,
    "pressure": 1.0,
    "feed_rate": 40.0,
    "foam_level": 15.0,
    "conductivity": 6.5,
}

# Inclusive phase masks over normalised time.
PHASES = (("Startup", 0.00, 0.33), ("Reaction", 0.33, 0.67), ("Harvest", 0.67, 1.00))

# Planning limits.  A table is broadcast only when its counted rows times its
# row width stay under BROADCAST_BYTES; a key group above HOT_ROWS is split.
BROADCAST_BYTES = 64 * 1024 * 1024
HOT_ROWS = 1_000_000
SALT_BUCKETS = 32
QUANTILE_ROWS = 1_000_000
QUANTILE_ACCURACY = 10_000
SPLINE_BLOCK = 50_000
SPLINE_HALO = 64
MATRIX_LIMIT = 4096
WIDE_MATRIX = 8192
SPARSE_LIMIT = 512
FOLD_VALUES = 4_000_000
BOOTSTRAP_RANGE = 1_000_000
BOOTSTRAP_BINS = 4096
BOOTSTRAP_TASK = 250_000
STREAM_BUCKETS = 512
