"""Query registry: name -> (Spark job, DuckDB oracle SQL or None).

Keys start with the SURVEY §2 row ID they cover. Every job reads the driver tables through the
fixture views, so its work grows with the data.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from barspark.session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = (run, sql)
        return fn

    return deco


def load_all() -> None:
    from barspark.plans import (  # noqa: F401  (registration side effects)
        q_clean, q_features, q_notebook, q_profile, q_dataset, q_evaluate, q_serving, q_sources, q_models,
        q_streaming)


def queries() -> dict[str, QueryFn]:
    load_all()
    return {k: v[0] for k, v in sorted(_REGISTRY.items())}


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: v[1] for k, v in sorted(_REGISTRY.items()) if v[1] is not None}
