"""Entity, pair and truth views over the driver tables; pure DataFrame plans with the SQL that means the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Business records from part: entity_id, side (1: reference records, 2 and 3: queries), country, name_core, state, num, addr."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("entity_id"),
        F.when(F.col("p_partkey") % 3 == 0, 1).when(F.col("p_partkey") % 3 == 1, 2).otherwise(3).alias("side"),
        F.col("p_brand").alias("country"), F.col("p_name").alias("name_core"), F.col("p_type").alias("state"), F.col("p_size").alias("num"),
        F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("addr"),
    )


PE = """pe AS (SELECT p_partkey AS entity_id, CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS side, p_brand AS country, p_name AS name_core,
  p_type AS state, p_size AS num, p_type || ' ' || CAST(p_size AS VARCHAR) AS addr FROM part)"""


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs from lineitem: s1_id, s23_id, p in [0, 1), src (2 or 3), country."""
    hashed = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_linenumber") * 31) % 10007
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("s1_id"), F.col("l_orderkey").alias("s23_id"))
        .agg(F.max(hashed.cast("double") / F.lit(10007.0).cast("double")).alias("p"))
        .withColumn("src", (F.lit(2) + F.col("s23_id") % 2).cast("int"))
        .withColumn("country", F.when(F.col("s1_id") % 3 == 0, "US").when(F.col("s1_id") % 3 == 1, "India").otherwise("France"))
    )


SP = """sp AS (SELECT s1_id, s23_id, p, CAST(2 + s23_id % 2 AS INTEGER) AS src, CASE s1_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
  FROM (SELECT l_partkey AS s1_id, l_orderkey AS s23_id, max(CAST((l_orderkey * 7919 + l_partkey * 104729 + l_linenumber * 31) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)) AS p
    FROM lineitem GROUP BY 1, 2))"""


def truth_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One true s1_id for each query with a returned line."""
    return table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == "A").groupBy(F.col("l_orderkey").alias("s23_id")).agg(F.min("l_partkey").alias("s1_id"))


TP = "tp AS (SELECT l_orderkey AS s23_id, min(l_partkey) AS s1_id FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)"


def s1_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("s1_id"))


S1 = "s1 AS (SELECT p_partkey AS s1_id FROM part)"
