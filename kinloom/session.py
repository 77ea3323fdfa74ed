"""Session settings; tests and the bench use them, a cluster brings its own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session with UTC, AQE and few shuffle partitions; extra settings override."""
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory,
        "spark.driver.host": "127.0.0.1",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.master(master).appName("kinloom").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, local sessions get one of their own; a cluster without it is an error."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return "file:///tmp/checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: what several plans read is computed once, and a lost executor costs no more than its tasks."""
    path = f"{shared_dir(df.sparkSession)}/kinloom/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
