"""Fixture tables for the corpus operator tests."""

from pyspark.sql import types as T

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType())])


def documents_dir(spark, tmp_path_factory, rows, **others):
    """A folder with documents.parquet (missing columns null, extra ones kept) and other tables."""
    path = str(tmp_path_factory.mktemp("tables"))
    extra = [k for k in (rows[0].asDict() if rows else {}) if k not in DOCUMENTS.names]
    schema = T.StructType(DOCUMENTS.fields + [T.StructField(k, T.StringType()) for k in extra])
    data = [tuple(r.asDict().get(n) for n in schema.names) for r in rows]
    spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    for name, df in others.items():
        df.write.parquet(f"{path}/{name}.parquet")
    return path
