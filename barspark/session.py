"""Session setup shared by the library, the tests and bench.py."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime SQL settings every barspark job relies on. They are session-level and can be set
# on a session somebody else created (the driver's, a notebook's).
RUNTIME_CONF = {
    # All timestamps are instants in UTC; local market time goes through from_utc_timestamp.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Feature frames carry ~110 derived columns; inferring IsNotNull/equality constraints over
    # all their aliases explodes planning time (seen on the notebook frame) and buys nothing here.
    "spark.sql.constraintPropagation.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared ``spark.checkpoint.dir``. Only a local master gets a scratch folder when it
    is unset (tests); elsewhere executors would not see it, so that is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="barspark-ckpt-")
    sc.setCheckpointDir(path)
    return path


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "barspark", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BARSPARK_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    for key, value in {**RUNTIME_CONF, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def scratch_folder(spark: SparkSession) -> str:
    """This session's folder for intermediate tables and sinks; deleted when Python ends first."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/barspark-{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


_folders: set[str] = set()


def _remove(spark: SparkSession, folder: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:  # the session still runs
        p = sc._jvm.org.apache.hadoop.fs.Path(folder)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df):
    """Cut lineage at a pipeline table boundary (clean bars, feature frame): write the table to the
    shared scratch folder and read it back. Later jobs that use it several times (split, scaler,
    windows) scan only the columns they need, with file statistics, and a lost executor costs a
    re-read, not a rerun of the whole pipeline."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/table-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_clustered(df, keys, order, buckets: int | None = None):
    """``materialize`` as a table bucketed by ``keys`` and sorted by ``order`` inside each bucket: joins,
    aggregates and windows on ``keys`` read it without another shuffle. The catalog names it until the
    session ends; its files lie in the scratch folder like those of any other table."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"barspark_{uuid.uuid4().hex[:12]}"
    (df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*order)
     .option("path", f"{scratch_folder(spark)}/{name}").saveAsTable(name))
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
