"""Ranking and group context over candidate pairs; every order is total, so that both engines agree on ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank0(group: str | list[str], score: str, tie: str) -> Column:
    """0-based rank by falling score within the group; rows without a score have none."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc_nulls_last(), F.col(tie))
    return F.when(F.col(score).isNotNull(), (F.row_number().over(w) - 1).cast("long"))


def gap_to_best(group: str | list[str], score: str) -> Column:
    return F.col(score) - F.max(score).over(Window.partitionBy(group))


def second_best(group: str | list[str], score: str, tie: str) -> Column:
    """The second score of the group; null in groups of one."""
    w = Window.partitionBy(group)
    return F.nth_value(score, 2).over(w.orderBy(F.col(score).desc_nulls_last(), F.col(tie)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def best_of(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by order, as one aggregate with a partial phase instead of a sort."""
    rest = [c for c in df.columns if c not in group]
    ranked = df.withColumn("__o", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return ranked.groupBy(*group).agg(F.max_by(F.struct(*rest), "__o").alias("__b")).select(*group, *(F.col(f"__b.{c}").alias(c) for c in rest)).select(df.columns)


def top_n(df: DataFrame, group: str | list[str], score: str, tie: str, n: int) -> DataFrame:
    """The n best rows of each group; the limit is applied before the shuffle too."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def context(df: DataFrame, q: str = "s23_id", s1: str = "s1_id", score: str = "p") -> DataFrame:
    """Candidate counts, rank and gaps within the query, gap and count within the reference record: two exchanges in all."""
    by_q, by_s1 = Window.partitionBy(q), Window.partitionBy(s1)
    out = df.withColumns({"q_ncand": F.count(F.lit(1)).over(by_q), "q_rank": rank0(q, score, s1), "q_gap_best": F.round(gap_to_best(q, score), 6), "__second": second_best(q, score, s1)})
    out = out.withColumn("q_gap_2nd", F.round(F.col(score) - F.coalesce("__second", F.col(score)), 6)).drop("__second")
    return out.withColumns({"s1_gap_best": F.round(F.col(score) - F.max(score).over(by_s1), 6), "s1_nq": F.count(F.lit(1)).over(by_s1)})
