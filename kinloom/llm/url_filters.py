"""URL filters: expand each URL into host-suffix and path-prefix expressions, equi-join on short hash prefixes, confirm digests.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the rule's
path. All rules that fit compete by the length of host and path, then of the host, then block before allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import ascii_lower

#: Hex digits of the digest that rules and expressions are joined on; the full digest decides.
PREFIX_HEX = 8


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rows as a relation whose size Catalyst knows, so that it broadcasts small ones itself."""
    if not rules:
        return spark.createDataFrame([], "rule_host string, rule_path string, rule_verdict string")
    rows = F.array(*(F.struct(F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(v).alias("rule_verdict")) for h, p, v in rules))
    return spark.range(1).select(F.inline(rows))


def url_verdicts(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (host and path of the one that decides, or null), verdict.

    Nulls and URLs without `://` have an empty host and path and get the default; null ids stay; repeated rows come back as often
    as they came; other columns are dropped, so their names cannot clash. Which host depths and path lengths are expanded
    follows from the rules (their distinct pairs, bounded by the longest rule), never from the URLs: they are one array of constants.
    The join's key is the digest's prefix alone; what it brings together by chance falls away when full digests are compared.
    """
    rest = F.expr("substring(u, locate('://', u) + 3)")
    pages = (
        urls.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
        .withColumn("rest", F.when(F.instr("u", "://") > 0, rest).otherwise(""))
        .select("id", ascii_lower(F.regexp_extract("rest", r"^[^/?#]*", 0)).alias("host"), F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))
        .groupBy("id", "host", "path")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rules = rules.where(F.col("rule_host").isNotNull() & F.col("rule_path").isNotNull()).dropDuplicates()
    shapes = [(r[0], r[1]) for r in rules.select(F.size(F.split("rule_host", r"\.")), F.length("rule_path")).distinct().collect()]
    constants = F.array(*(F.struct(F.lit(-labels).alias("labels"), F.lit(length).alias("length")) for labels, length in sorted(shapes)))
    digest = lambda host, path: F.sha2(F.concat(host, F.lit("\n"), path), 256)
    keyed = rules.withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path"))).withColumn("short", F.substring("rule_digest", 1, PREFIX_HEX))
    if shapes:
        fitting = F.filter(constants, lambda s: s["length"] <= F.length("path"))
        suffix, start = F.call_function("substring_index", F.col("host"), F.lit("."), F.col("e.labels")), F.substring("path", F.lit(1), F.col("e.length"))
        exploded = pages.withColumn("e", F.explode_outer(fitting)).withColumn("digest", digest(suffix, start)).withColumn("short", F.substring("digest", 1, PREFIX_HEX))
        joined = exploded.join(keyed, "short", "left").withColumn("fits", F.col("digest") == F.col("rule_digest"))
    else:
        joined = pages.withColumns({"rule_host": F.lit(None).cast("string"), "rule_path": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string"), "fits": F.lit(False)})
    rank = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("total"), F.length("rule_host").alias("depth"), (F.col("rule_verdict") == "block").alias("strict"),
        F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"),
    )
    best = joined.groupBy("id", "host", "path", "n").agg(F.max(F.when(F.col("fits"), rank)).alias("best"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), "n"))).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
