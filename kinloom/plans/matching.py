"""Exact-key matching end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.fixtures import PE, parts_entities
from kinloom.registry import REGISTRY


@REGISTRY.query(f"""
    WITH {PE}, c AS (SELECT q.entity_id AS q_id, s.entity_id AS s1_id, q.country, count(*) OVER (PARTITION BY q.entity_id) AS n
      FROM pe q JOIN pe s ON q.country = s.country AND q.name_core = s.name_core AND q.state = s.state WHERE q.side > 1 AND s.side = 1)
    SELECT q_id, s1_id, country FROM c WHERE n = 1""")
def m31_exact_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query matches when exactly one reference record carries its (country, name, state) key."""
    e = parts_entities(spark, sf_dir)
    key = ["country", "name_core", "state"]
    refs = e.where(F.col("side") == 1).select(*key, F.col("entity_id").alias("s1_id"))
    pairs = e.where(F.col("side") > 1).select(*key, F.col("entity_id").alias("q_id")).join(refs, key)
    return pairs.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("q_id"))).where("n = 1").select("q_id", "s1_id", "country")
