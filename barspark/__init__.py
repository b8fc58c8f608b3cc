"""barspark: market-bar analytics (cleaning, indicators, datasets, evaluation) as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from barspark.session import configure, get_spark

__all__ = ["configure", "get_spark"]

# Functions that run in tasks travel with the job: workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
