"""WARC archives: write records, and read them back by boundary-chain verification.

Reading never trusts a magic string. Each task reads a byte range of an archive, cut at every `WARC/1.1` line, and emits a candidate
record with the offset at which its Content-Length says the next record starts. Pointer jumping from offset 0 of the file keeps the
candidates that are reachable; magic inside a payload is reached by no record and falls away.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

MAGIC, CRLF2 = "WARC/1.1\r\n", "\r\n\r\n"
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 100
#: Groups of equal payloads up to which their table is broadcast (about 100 bytes each); beyond, a shuffled join takes over.
BROADCAST_GROUPS = 100_000


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", broadcast_groups: int = BROADCAST_GROUPS) -> None:
    """Write one record per row below path, an archive per input partition.

    Of rows with equal payloads of REVISIT_BYTES bytes or more those with the smallest id are responses and the others revisits
    without a block. Null payloads are empty, null URLs too; a null id is never smallest, so such a row revisits if a row with an
    id has its payload, and else is a response. Repeated rows give repeated records; other columns are ignored. An empty table
    gives an empty folder.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = (
        rows.where(F.col("bytes") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where((F.col("copies") > 1) & F.col("first_id").isNotNull()).select(F.col("digest").alias("first_digest"), "first_id")
    )
    firsts = firsts.persist(StorageLevel.MEMORY_AND_DISK)
    if firsts.count() <= broadcast_groups:
        firsts = F.broadcast(firsts)
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    head = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn(F.col("id"))),
        _header("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z\r\n"),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(_header("WARC-Refers-To", urn(F.col("first_id"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit("")),
        _header("X-Payload-Length", F.col("bytes").cast("string")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    out = rows.join(firsts, F.col("digest") == F.col("first_digest"), "left")
    out.select(F.concat(head, block).alias("value")).write.option("lineSep", CRLF2).text(path)


def _reachable(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pointer jumping over one archive's candidates: each round doubles how far the marks from the file's start have gone."""
    pdf = pdf.sort_values("at", kind="stable")
    at, after = pdf["at"].to_numpy(), pdf["after"].to_numpy()
    n = len(at)
    jump = np.searchsorted(at, after)
    jump = np.where((jump < n) & (at[np.minimum(jump, n - 1)] == after), jump, n)
    jump = np.append(jump, n)  # n: no candidate there; it points to itself
    live = np.zeros(n + 1, bool)
    live[np.flatnonzero(at == 0)] = True
    for _ in range(max(1, n).bit_length()):
        live[jump[np.flatnonzero(live)]] = True
        jump = jump[jump]
    return pdf.loc[live[:n], ["file", "at", "after"]]


def _chunks(spark: SparkSession, path: str, payloads: bool) -> DataFrame:
    """What stands between magics, with its offset; the offsets come from lengths summed within a byte range and over ranges."""
    m = len(MAGIC)
    raw = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.col("value").cast("binary").alias("raw"), "value"
    )
    head = F.substring_index("value", CRLF2, 1)
    raw = raw.select("file", "start", "seq", F.octet_length("raw").cast("long").alias("size"), F.when(F.octet_length(head) < F.octet_length("raw"), head).alias("head"), "raw")
    raw = raw.withColumn("length", F.expr("try_cast(regexp_extract(head, '(?mi)^Content-Length:[ \\\\t]*([0-9]+)', 1) AS BIGINT)"))
    body = F.octet_length("head") + len(CRLF2) + 1
    inside = F.col("length") <= F.col("size") - body + 1
    raw = raw.withColumn("block", F.when(inside, F.expr(f"substring(raw, CAST(octet_length(head) + {len(CRLF2) + 1} AS INT), CAST(length AS INT))")))
    light = raw.select(
        "file", "start", "seq", "size", "length", "head", F.octet_length("head").alias("head_size"), F.sha2("block", 256).alias("block_digest"),
        F.when(inside, F.col("length")).alias("block_size"), *(["raw", "block"] if payloads else []),
    )
    within = Window.partitionBy("file", "start").orderBy("seq")
    over = light.withColumn("before", F.sum(F.col("size") + m).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = light.groupBy("file", "start").agg(F.sum(F.col("size") + m).alias("whole"))
    ranges = ranges.withColumn("base", F.coalesce(F.sum("whole").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = over.join(ranges.drop("whole"), ["file", "start"])
    # a chunk begins behind its magic; the first of a file has none before it
    placed = placed.withColumn("at", F.col("base") + F.coalesce("before", F.lit(0)) - m)
    return placed.withColumn("after", F.col("at") + m + F.col("head_size") + len(CRLF2) + F.col("length") + len(CRLF2)).drop("base", "before", "seq", "start")


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record: file, at (its offset), after (its successor's), head, length, block_digest (SHA-256 hex), and with payloads also block (binary).

    Records whose block holds magic are put together from their pieces. Candidates that the chain from the file's start does not
    reach, files that do not start with a record, and a last record that its file's end cuts off give no rows. Memory in a task: 24 bytes for each candidate of one archive.
    Without payloads the blocks stay in the scan and only digests are shuffled.
    """
    chunks = _chunks(spark, path, payloads).where(F.col("at") >= 0)
    real = chunks.where(F.col("after").isNotNull()).select("file", "at", "after").groupBy("file").applyInPandas(_reachable, "file string, at long, after long")
    real = real.persist(StorageLevel.MEMORY_AND_DISK)
    columns = ["file", "at", "after", "head", "length", "block_digest", *(["block"] if payloads else [])]
    kept = chunks.join(real, ["file", "at", "after"])
    whole = kept.where(F.col("block_size").isNotNull()).select(*columns)
    # blocks that hold magic: the pieces of their files are read again and joined in order
    split = kept.where(F.col("block_size").isNull()).select("file", "at", "after", "head", "length", "head_size").persist(StorageLevel.MEMORY_AND_DISK)
    if split.isEmpty():
        return whole
    pieces = _chunks(spark, path, True).where(F.col("at") >= 0).join(split.select("file").distinct(), "file", "left_semi")
    owners = pieces.join(real.select("file", "at", F.lit(True).alias("real")), ["file", "at"], "left").withColumn(
        "owner", F.last(F.when(F.col("real"), F.col("at")), True).over(Window.partitionBy("file").orderBy("at"))
    )
    magic = F.lit(MAGIC).cast("binary")
    joined = (
        owners.select("file", "owner", "at", "raw").join(split.select("file", F.col("at").alias("owner")), ["file", "owner"], "left_semi")
        .groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("at", F.concat(magic, "raw").alias("piece")))).alias("parts"))
        .select("file", F.col("owner").alias("at"), F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["piece"])), "")).alias("bytes"))
    )
    mended = split.join(joined, ["file", "at"]).withColumn("block", F.expr(f"substring(bytes, CAST(head_size + {len(MAGIC) + len(CRLF2) + 1} AS INT), CAST(length AS INT))"))
    mended = mended.where(F.octet_length("block") == F.col("length"))
    return whole.unionByName(mended.withColumn("block_digest", F.sha2("block", 256)).select(*columns))


def record_digests(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """One row per record of read_warc: the id, the payload's bytes and digest, response or revisit, and the id it refers to.

    A response's figures are those of the block as read; a revisit's come from its header. A response whose block does not have
    the digest that its header states fails the job.
    """
    field = lambda name, what: F.regexp_extract("head", rf"(?mi)^{name}:[ \t]*{what}", 1)
    page = lambda name: F.expr(rf"try_cast(regexp_extract(head, '(?mi)^{name}:[ \\t]*<urn:page:(-?[0-9]*)>', 1) AS BIGINT)")
    rows = records.withColumns({"record_type": field("WARC-Type", "([a-z]+)"), "stated": field("WARC-Payload-Digest", "sha256:([0-9a-f]+)"), "stated_bytes": field("X-Payload-Length", "([0-9]+)").cast("long")})
    revisit = F.col("record_type") == "revisit"
    sound = F.when(revisit | (F.col("stated") == F.col("block_digest")), F.col("stated")).otherwise(F.raise_error(F.concat(F.lit("a block differs from its digest at "), "file", F.lit(" "), F.col("at").cast("string"))))
    return rows.select(
        page("WARC-Record-ID").alias(id_col), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("length")).alias("payload_bytes"), sound.alias("payload_digest"), "record_type",
        page("WARC-Refers-To").alias("refers_to"),
    )
