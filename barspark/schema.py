"""Explicit schemas, column lists and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barspark import config

SEQ = "_seq"  # input order of a bar, used for first-wins dedup

BAR_SCHEMA = T.StructType([
    T.StructField("Timestamp", T.TimestampType(), True),
    T.StructField("Ticker", T.StringType(), True),
    T.StructField("Open", T.DoubleType(), True),
    T.StructField("High", T.DoubleType(), True),
    T.StructField("Low", T.DoubleType(), True),
    T.StructField("Close", T.DoubleType(), True),
    T.StructField("Volume", T.DoubleType(), True),
])

MARKET_SCHEMA = "market string, suffix string, timezone string, open_min int, close_min int"

PREDICTION_SCHEMA = T.StructType([
    T.StructField("ticker", T.StringType(), False),
    T.StructField("predictions", T.ArrayType(T.DoubleType()), True),
    T.StructField("confidence", T.DoubleType(), True),
    T.StructField("intervals", T.ArrayType(T.ArrayType(T.DoubleType())), True),
    T.StructField("model_version", T.StringType(), True),
])

# Persisted tables: names and order of columns are fixed values.
REGISTRY_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("artifact_key", T.StringType(), False),
    T.StructField("model_type", T.StringType(), False),
    T.StructField("features_count", T.IntegerType(), False),
    T.StructField("model_timestamp", T.TimestampType(), True),
    T.StructField("metrics", T.MapType(T.StringType(), T.DoubleType()), False),
    T.StructField("feature_names", T.ArrayType(T.StringType()), False),
    T.StructField("model_file", T.StringType(), False),
    T.StructField("scaler_file", T.StringType(), False),
    T.StructField("metadata_file", T.StringType(), False),
    T.StructField("is_active", T.BooleanType(), False),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
])

JOBS_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("symbol", T.StringType(), False),
    T.StructField("model_registry_entry_id", T.StringType(), True),
    T.StructField("requested_as_of_date", T.TimestampType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("predicted_return", T.DecimalType(12, 8), True),
    T.StructField("predicted_direction", T.StringType(), True),
    T.StructField("latest_close", T.DecimalType(14, 4), True),
    T.StructField("predicted_next_close", T.DecimalType(14, 4), True),
    T.StructField("signal_label", T.StringType(), True),
    T.StructField("signal_confidence", T.DecimalType(5, 4), True),
    T.StructField("error_message", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
    T.StructField("completed_at", T.TimestampType(), True),
])


class SchemaError(ValueError):
    pass


def validate_bars(df: DataFrame) -> DataFrame:
    """Check the 7 bar columns exist with usable types."""
    missing = [c for c in config.BAR_COLUMNS if c not in df.columns]
    if missing:
        raise SchemaError(f"bar table is missing columns {missing}")
    types = dict(df.dtypes)
    if not types["Timestamp"].startswith("timestamp"):
        raise SchemaError(f"Timestamp must be a timestamp, got {types['Timestamp']}")
    for c in config.PRICE_COLUMNS:
        if types[c] not in ("double", "float", "int", "bigint", "smallint") and not types[c].startswith("decimal"):
            raise SchemaError(f"{c} must be numeric, got {types[c]}")
    return df


def validate_features(df: DataFrame, required=None) -> DataFrame:
    """Containment check: every required feature column is present."""
    required = list(required or config.PACKAGE_FEATURES)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise SchemaError(f"feature table is missing columns {missing}")
    return df
