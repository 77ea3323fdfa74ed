"""What the corpus operators share: the shared folder, written tables, table access."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's text types treat these as white space nowhere; the contracts do.
ASCII_SPACE = r"[ \t-\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's spark.checkpoint.dir.

    Where that is unset, local sessions (tests) get /tmp/checkpoints; a cluster without it is an error.
    """
    conf = spark.sparkContext.getConf()
    if folder := spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    return "file:///tmp/checkpoints"


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/kinloom/{tag}-{uuid.uuid4().hex[:12]}"


#: Rows that Python gets at once while a table is written: with Spark's 10,000 whole texts, executor and worker each hold all of a task's input.
ROWS_A_BATCH = 1000


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Plans that run inside hand at most ROWS_A_BATCH rows to Python at once; the session's own setting comes back."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)
    if not 0 < int(own) <= ROWS_A_BATCH:
        spark.conf.set(key, str(ROWS_A_BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, own)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """The rows of df, written to the shared folder and read again: lineage ends here, lost executors cost nothing."""
    path = fresh_path(df.sparkSession, tag)
    with short_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of one partition, and times an even share of all, beyond which a table is dealt out anew; and into how many partitions at most: so many are written without being sorted.
ROWS_A_TASK, LOPSIDED, DEALT = 20_000, 2, 200


def dealt(df: DataFrame) -> DataFrame:
    """The rows of df, a written table, dealt out evenly if one task would read most of them: a file is split between row groups only.

    Rows are counted from the files' footers; a task that reads a large row group then has no Python worker beside it, and Python's work is shared by all.
    """
    counts = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counts or max(counts) <= max(ROWS_A_TASK, LOPSIDED * sum(counts) / df.sparkSession.sparkContext.defaultParallelism):
        return df
    return df.repartition(max(2, min(DEALT, sum(counts) * 10 // ROWS_A_TASK)), F.monotonically_increasing_id())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(columns: list[str], name: str) -> str:
    """The name, with underscores before it as long as a column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def schema_of(df: DataFrame) -> str:
    """The columns and their types as map_batches takes them."""
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def ascii_lower(col: Column) -> Column:
    """A-Z only; other letters stay, as the contracts ask."""
    return F.translate(col, UPPER, LOWER)


def words_of(col: Column) -> Column:
    """Words between ASCII white space, A-Z lower-cased; null and blank texts have none."""
    return F.filter(F.split(ascii_lower(F.coalesce(col, F.lit(""))), ASCII_SPACE), lambda w: w != "")


def lower_words(col: Column) -> Column:
    """Words between ASCII white space of the lower-cased text; null and blank texts have none. Cheaper than words_of."""
    trimmed = F.btrim(F.lower(F.coalesce(col, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, ASCII_SPACE))


def held_out(col: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32(id as text) mod modulus is the remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def give_back() -> None:
    """Memory that a task has freed goes back to the system: workers are used again, and their executors answer for what they hold."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux
        trim(0)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]], schema: str) -> DataFrame:
    """mapInArrow with state that each task makes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield from step(batch)
        del step
        give_back()

    return df.mapInArrow(run, schema)
