"""Helpers shared by the corpus operators: tables, scratch tables, whole-table numbering."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspark.session import ensure_checkpoint_dir

# Fixed values of the corpus contracts.
WORD = r"[^\x20\x09-\x0D]+"          # a word: a run without blanks, tabs or line ends
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_folder(spark: SparkSession) -> str:
    """This session's folder for intermediate tables, on the storage all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/llm-{spark.sparkContext.applicationId}"


def cut(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a scratch table, with ``options`` of the writer, and return the table: lineage ends here."""
    spark = df.sparkSession
    folder = scratch_folder(spark)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    if folder not in _registered:
        _registered.add(folder)
        atexit.register(_release_quietly, spark, folder)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that no later step reads."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_registered: set[str] = set()


def _release_quietly(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is not None:  # the session still runs
        remove(spark, folder)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def packed(df: DataFrame) -> DataFrame:
    """The whole input row in one struct column, so that no added column can clash with it."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")) if df.columns else df


def unpacked(df: DataFrame, *added: str) -> DataFrame:
    """Input columns again, then the added ones; an added column replaces one of the same name."""
    names = [f.name for f in df.schema["row"].dataType.fields]
    taken = {a.lower() for a in added}
    return df.select(*[F.col("row").getField(n).alias(n) for n in names if n.lower() not in taken], *added)


def hashable(df: DataFrame, column: str = "row") -> Column:
    """A 64-bit value of a packed row; maps count as their sorted entries."""
    fields = df.schema[column].dataType.fields
    parts = []
    for f in fields:
        c = F.col(column).getField(f.name)
        kind = f.dataType.simpleString()
        parts.append(F.to_json(F.struct(c)) if "map<" in kind or "variant" in kind else c)
    return F.xxhash64(*parts)


def running_total(df: DataFrame, order: list[Column], value: Column, out: str, parts: int | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all earlier rows in ``order`` (0 for the first).

    Rows are dealt by range, written, summed inside each range, and each range gets the total of
    the earlier ranges from a table with one row per range: no task sees more than one range.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(parts, *order)
                 .withColumn("_range", F.spark_partition_id()).withColumn("_value", value), "ranged")
    starts = (ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
              .withColumn("_start", F.coalesce(F.sum("_sum").over(
                  Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("_range", "_start"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
            .join(F.broadcast(starts), "_range")  # at most one row per shuffle partition
            .withColumn(out, F.col("_start") + F.col("_inside"))
            .drop("_range", "_value", "_inside", "_start"))
