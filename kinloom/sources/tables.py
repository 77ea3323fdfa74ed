"""Files: tab-separated records without quoting, id lists in and out, cached sources, vector stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("entity_id", "business_name", "business_address", "country")])


def read_tsv(spark: SparkSession, path: str, schema: T.StructType = RECORD) -> DataFrame:
    """Tab-separated with a header; quotes are data, nothing is inferred, missing fields are empty strings."""
    df = spark.read.csv(path, sep="\t", quote="", escape="", header=True, schema=schema, nullValue="", emptyValue="", enforceSchema=True)
    return df.na.fill("", [f.name for f in schema if isinstance(f.dataType, T.StringType)])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", quote="", escape="", header=True, emptyValue="", nullValue="")


def cached_source(spark: SparkSession, path: str, cache: str, schema: T.StructType = RECORD) -> DataFrame:
    """The source as Parquet, written once; later reads prune columns and push filters down."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        read_tsv(spark, path, schema).write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def explode_ids(df: DataFrame, key: str, ids: str, out: str) -> DataFrame:
    """A comma list for each key, as (key, out) pairs; empty entries are dropped."""
    return df.select(key, F.explode(F.split(F.coalesce(F.col(ids), F.lit("")), ",")).alias(out)).where(F.col(out) != "")


def id_lists(keys: DataFrame, pairs: DataFrame, key: str, member: str, out: str) -> DataFrame:
    """One row for every key: its distinct members sorted as text and joined by commas, empty without any."""
    lists = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(member).cast("string"))), ",").alias(out))
    return keys.select(key).join(lists, key, "left").select(key, F.coalesce(out, F.lit("")).alias(out))


def semi_scan(spark: SparkSession, path: str, ids: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """The named columns of the rows whose key is in ids."""
    return spark.read.parquet(path).select(on, *(c for c in columns if c != on)).join(ids.select(on), on, "left_semi")


def append_log(spark: SparkSession, path: str, row: dict[str, str]) -> None:
    """One more line of a run log."""
    spark.createDataFrame([tuple(row.values())], list(row)).coalesce(1).write.mode("append").csv(path, header=True)


def export_sample(df: DataFrame, path: str, share: float, seed: int = 7) -> None:
    """A seeded share of the rows as CSV, for reading by eye."""
    df.sample(fraction=share, seed=seed).write.mode("overwrite").csv(path, header=True)


def write_vectors(df: DataFrame, path: str, key: str, vec: str) -> None:
    """Vectors as Parquet float arrays, in key order within files so that range filters skip row groups."""
    df.select(key, F.col(vec).cast("array<float>").alias(vec)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
