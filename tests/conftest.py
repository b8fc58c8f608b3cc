import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from barspark.session import get_spark

    s = get_spark("local[4]", shuffle_partitions=4, app="barspark-tests")
    yield s
    s.stop()


@pytest.fixture
def tiny_chunks(spark):
    """Force many chunks (and halos larger than a chunk) to exercise the skew-safe plan."""
    from barspark import config

    old = spark.conf.get(config.CHUNK_ROWS_CONF, None)
    old_blk = spark.conf.get(config.BLOCK_SECONDS_CONF, None)
    spark.conf.set(config.CHUNK_ROWS_CONF, "7")
    spark.conf.set(config.BLOCK_SECONDS_CONF, str(6 * 3600))
    yield
    for key, value in ((config.CHUNK_ROWS_CONF, old), (config.BLOCK_SECONDS_CONF, old_blk)):
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
