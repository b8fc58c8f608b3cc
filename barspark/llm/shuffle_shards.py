"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records into buckets that fit a task's memory, by a seeded hash. Pass 2 puts
each bucket in a fixed order, applies a seeded Fisher-Yates shuffle to it (Spark's ``shuffle``)
and writes it as a scratch table. The buckets laid end to end are a random permutation of all
records; dealing it round robin gives shards whose row counts differ by at most one (law ``rows``).
Only DataFrame functions run.

The number of buckets follows the bytes of the table. The hash covers all columns and the number of
the input partition, so neither one key nor exact repeats of a row (a third of the table, say)
can fill one bucket.

Defined cases: null text counts no bytes, has crc32 0; repeated rows get a slot each; an empty
table gives an empty result; columns added replace input columns of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspark.llm.common import cut, hashable, packed, running_total, unpacked

# Production parameters of op8.
SHARDS = 8
BUCKET_BYTES = 4 << 20      # text bytes a bucket holds on average
SEED = 20_260_108
BUCKETS_A_TASK = 4


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def external_shuffle(df: DataFrame, text: str = "text", n_shards: int = SHARDS, seed: int = SEED,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Input rows with size, law, shard (0 … n_shards-1) and slot (0, 1, … inside the shard)."""
    rows = packed(df).withColumn("size", text_size(F.col("row").getField(text)))
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_buckets = max(1, math.ceil(total / bucket_bytes))
    scattered = (rows.withColumn("h", hashable(rows))
                 .withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "h", F.spark_partition_id()), F.lit(n_buckets)))
                 .repartition(math.ceil(n_buckets / BUCKETS_A_TASK), "bucket"))
    # One fixed order of buckets and rows before the seeded shuffle: a task run again gives the same.
    # Only hashes and places are compared, as a row may hold a map; rows of one hash are repeats.
    buckets = (scattered.groupBy("bucket").agg(F.collect_list(F.struct("h", "size", "row")).alias("found"))
               .withColumn("order", F.array_sort(F.transform("found", lambda x, i: F.struct(x["h"].alias("h"), i.alias("i")))))
               .select("bucket", F.transform("order", lambda o: F.get("found", o["i"])).alias("records"))
               .sortWithinPartitions("bucket"))
    shuffled = cut(buckets.select("bucket", F.shuffle("records", F.lit(seed)).alias("records"))
                   .select("bucket", F.posexplode("records").alias("place", "record"))
                   .select("bucket", "place", "record.size", "record.row"), "buckets")
    counts = shuffled.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = running_total(counts, [F.col("bucket")], F.col("n"), "start").select("bucket", "start")
    at = F.col("start") + F.col("place")
    placed = shuffled.join(starts, "bucket").select(
        "row", "size", F.lit("rows").alias("law"), F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"),
        F.floor(at / n_shards).cast("long").alias("slot"))
    return unpacked(placed, "size", "law", "shard", "slot")


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Shuffle ``df`` and write it as ``path/shard=k/``, each file in slot order."""
    placed = external_shuffle(df, **options)
    pieces = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    piece = F.pmod(F.floor(F.col("slot") / 65536), F.lit(pieces))
    (placed.repartition(pieces, "shard", piece).sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))
