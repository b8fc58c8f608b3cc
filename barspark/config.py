"""Fixed values and defaults.

Everything under "fixed values" must equal what the surveyed workload uses for results to
match; it is stated once here, in natural order.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Fixed values (must match the surveyed workload)
# ---------------------------------------------------------------------------------------------

# Market profiles: ticker suffixes (case-insensitive) that select the India session; every
# other ticker trades on the US session. Session bounds are inclusive, in local minutes.
INDIA_SUFFIXES = (".NS", ".BO")
INDIA_MARKET = {"market": "IN", "timezone": "Asia/Kolkata", "open_min": 9 * 60 + 15, "close_min": 15 * 60 + 30}
US_MARKET = {"market": "US", "timezone": "America/New_York", "open_min": 9 * 60 + 30, "close_min": 16 * 60}

# A series whose median bar gap is at least this long is daily (weekday filter only).
DAILY_MEDIAN_GAP_SECONDS = 20 * 3600

# The 24 model features of the package dialect, in model-input order.
PACKAGE_FEATURES = [
    "Open", "High", "Low", "Close", "Volume",
    "return_1", "rsi", "ema_fast", "ema_slow", "macd", "macd_signal", "macd_hist",
    "rolling_mean_5", "rolling_std_5", "rolling_mean_10", "rolling_std_10",
    "rolling_mean_20", "rolling_std_20",
    "hour", "day_of_week", "hour_sin", "hour_cos", "day_sin", "day_cos",
]
PRICE_COLUMNS = ["Open", "High", "Low", "Close", "Volume"]
BAR_COLUMNS = ["Timestamp", "Ticker", "Open", "High", "Low", "Close", "Volume"]

# Package-dialect indicator parameters.
RSI_WINDOW = 14
EMA_FAST = 12
EMA_SLOW = 26
MACD_SIGNAL = 9
ROLLING_WINDOWS = (5, 10, 20)
HORIZON = 3
SEQUENCE_LENGTH = 48
VALIDATION_SPLIT = 0.2
INTERVAL_MULTIPLIER = 1.96

# Notebook-dialect indicator parameters.
NB_LAGS = (1, 2, 3, 5, 10)
NB_SMA = (5, 10, 20, 50, 200)
NB_EMA = (12, 26, 50)
NB_RSI = (14, 21)
NB_RSI_LOW, NB_RSI_HIGH = 30, 70
NB_BB_WINDOW, NB_BB_K = 20, 2
NB_ATR = (14, 21)
NB_VOL_WINDOWS = (5, 10, 20, 30)
NB_VOLUME_MA = (5, 20, 50)
NB_VWAP_WINDOW = 20
NB_ROC = (5, 10, 20)
NB_MOMENTUM = 10
TRADING_DAYS = 252
# Target_Class bin edges, right-closed: (-inf,-0.02] (-0.02,-0.005] (-0.005,0.005] (0.005,0.02] (0.02,inf)
TARGET_CLASS_EDGES = (-0.02, -0.005, 0.005, 0.02)
RISK_FREE_RATE = 0.02
TRANSACTION_COST = 0.001
MAPE_EPSILON = 1e-10
CALIBRATED_COVERAGE = (75.0, 85.0)

# ---------------------------------------------------------------------------------------------
# Engine defaults (not part of the workload semantics)
# ---------------------------------------------------------------------------------------------

# Rows per series chunk. Every ordered per-ticker computation runs per (Ticker, chunk), so one
# hot ticker is spread over many tasks. Overridable per session with spark.conf key below.
CHUNK_ROWS_CONF = "barspark.chunkRows"
DEFAULT_CHUNK_ROWS = 1_000_000
# Width of the time blocks used to number rows without a single-task window per ticker.
BLOCK_SECONDS_CONF = "barspark.blockSeconds"
DEFAULT_BLOCK_SECONDS = 7 * 86400
# Directories of a table partitioned by ticker, however many tickers it has. Part of the layout of
# written tables: readers find a ticker's directory with it.
KEY_GROUPS = 256
# Relative influence below which an exponential recurrence's start-up is considered gone.
EMA_TOLERANCE = 1e-17


@dataclass(frozen=True)
class FeatureSettings:
    """The small config record the package dialect reads."""

    rsi_window: int = RSI_WINDOW
    ema_fast: int = EMA_FAST
    ema_slow: int = EMA_SLOW
    macd_signal: int = MACD_SIGNAL
    rolling_windows: tuple = ROLLING_WINDOWS
    horizon: int = HORIZON
    sequence_length: int = SEQUENCE_LENGTH
    validation_split: float = VALIDATION_SPLIT
    interval_multiplier: float = INTERVAL_MULTIPLIER
    extra: dict = field(default_factory=dict)
