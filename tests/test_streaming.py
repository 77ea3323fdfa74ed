"""Streams give what one batch would."""

from __future__ import annotations

from helpers import DATA
from pyspark.sql import functions as F

from kinloom.fixtures import parts_entities
from kinloom.sources import tables
from kinloom.streaming import resolve

SF = f"{DATA}/sf0.001"


def test_resolve_stream(spark, tmp_path):
    e, key = parts_entities(spark, SF), ["country", "name_core", "state"]
    refs = e.where("side = 1").select(*key, F.col("entity_id").alias("s1_id"))
    queries = e.where("side > 1").select(*key, F.col("entity_id").alias("q_id"))
    queries.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    resolve.resolve_stream(stream, refs, key, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {(r.q_id, r.s1_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.q_id, r.s1_id) for r in resolve.matches(queries, refs, key).collect()}


def test_windowed_counts(spark, tmp_path):
    src = f"{SF}/events.parquet"
    static = spark.read.parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    schema = spark.read.parquet(src).schema
    (tmp_path / "ev").mkdir()
    (tmp_path / "ev" / "a.parquet").symlink_to(src)
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev")).withColumn("ts", F.col("ts").cast("timestamp"))
    run = resolve.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("hourly").trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {(r.start, r.event_type, r.n) for r in resolve.counts_by_window(static).collect()}
    assert want and {(r.start, r.event_type, r.n) for r in spark.sql("SELECT * FROM hourly").collect()} == want


def test_small_sinks(spark, tmp_path):
    tables.append_log(spark, str(tmp_path / "log"), {"run": "a", "f": "0.5"})
    tables.append_log(spark, str(tmp_path / "log"), {"run": "b", "f": "0.6"})
    assert spark.read.csv(str(tmp_path / "log"), header=True).count() == 2
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    tables.write_vectors(df, str(tmp_path / "v"), "vec_id", "embedding")
    assert spark.read.parquet(str(tmp_path / "v")).count() == df.count()
    tables.export_sample(df.select("vec_id"), str(tmp_path / "s"), 0.1)
    assert 0 < spark.read.csv(str(tmp_path / "s"), header=True).count() < df.count()
    assert all(len(r.sha256) == 64 for r in tables.content_hashes(spark, str(tmp_path / "v")).collect())
