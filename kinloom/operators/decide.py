"""From scored pairs to matches: assignment, thresholds, caps, gating, patches and expected-score decoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.windows import best_of

#: Acceptance thresholds by country; other countries take the last.
THRESHOLDS, DEFAULT_THRESHOLD = {"US": 0.75, "India": 0.8, "France": 0.75}, 0.75


def by_country(country: Column, values: dict[str, float], default: float) -> Column:
    found = F.lit(default)
    for k, v in values.items():
        found = F.when(country == k, F.lit(v)).otherwise(found)
    return found.cast("double")


def md5_mod(key: Column, m: int) -> Column:
    """A bucket from the first eight hex digits of the key's MD5; the same in any engine."""
    return (F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % m).cast("long")


def assign(pairs: DataFrame, threshold: Column | float, q: str = "s23_id", s1: str = "s1_id", score: str = "p") -> DataFrame:
    """Each query's best pair among those at or above the threshold; ties go to the least reference id."""
    return best_of(pairs.where(F.col(score) >= threshold), [q], [F.col(score), -F.col(s1)])


def leak_free(pairs: DataFrame, held: Column, q: str = "s23_id") -> DataFrame:
    """Pairs of the queries none of whose candidates is a held-out record."""
    return pairs.join(pairs.where(held).select(q).distinct(), q, "left_anti")


def gated(channel: DataFrame, taken: DataFrame, least: float, q: str = "s23_id", s1: str = "s1_id", score: str = "p") -> DataFrame:
    """A channel's best pairs from least on, of queries that are not taken."""
    return assign(channel, least, q, s1, score).join(taken.select(q).distinct(), q, "left_anti")


def patched(matches: DataFrame, extra: DataFrame, q: str = "s23_id") -> DataFrame:
    """Matches and, for queries without one, the extra pairs."""
    return matches.unionByName(extra.join(matches.select(q), q, "left_anti"))


def expected_f_decode(pairs: DataFrame, missing: float = 0.1, s1: str = "s1_id", tie: str = "s23_id", score: str = "p") -> DataFrame:
    """For each reference record the prefix of its candidates, by falling score, that has the best expected F0.5; none if silence expects more."""
    order = Window.partitionBy(s1).orderBy(F.col(score).desc(), F.col(tie))
    whole = Window.partitionBy(s1)
    k = F.row_number().over(order)
    run = F.sum(score).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = pairs.withColumns({"k": k, "run": run, "all": F.sum(score).over(whole), "none": F.exp(F.sum(F.log(F.greatest(1 - F.col(score), F.lit(1e-9)))).over(whole) - missing)})
    steps = steps.withColumn("value", F.round(1.25 * F.col("run") / (0.25 * (F.col("all") + missing) + F.col("k")), 9))
    best = steps.groupBy(s1).agg(F.max(F.struct(F.col("value"), (-F.col("k")).alias("nk"))).alias("b"), F.round(F.max("none"), 9).alias("none"))
    keep = best.where(F.col("b.value") > F.col("none")).select(s1, (-F.col("b.nk")).alias("kb"))
    return steps.join(keep, s1).where(F.col("k") <= F.col("kb")).select(s1, tie, score, F.col("k").cast("long").alias("k"))
