"""The offline pipeline as published tables (raw -> clean -> features)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from barspark.config import FeatureSettings
from barspark.operators import cleaning, indicators
from barspark.sources import bars_io


def run_pipeline(raw: DataFrame, settings: FeatureSettings = FeatureSettings(), out_dir: str | None = None) -> dict[str, DataFrame]:
    """Clean and featurise ``raw`` bars; each stage is a separate artifact (checkpointed, and
    written as Ticker-partitioned parquet under ``out_dir`` when given)."""
    clean = cleaning.clean_market_data(raw)
    features = indicators.feature_frame(clean, settings)
    tables = {"raw": raw, "clean": clean, "features": features}
    if out_dir:
        for name, df in tables.items():
            bars_io.write_table(df.drop("_seq") if "_seq" in df.columns else df, f"{out_dir.rstrip('/')}/{name}")
    return tables
