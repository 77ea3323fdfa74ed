"""Macro F0.5 over reference records, sweeps, oracles, calibration and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f05(tp: Column, n_pred: Column, n_true: Column) -> Column:
    """F0.5 of one record: 1 if both sets are empty, 0 without a hit, else 1.25 P R / (0.25 P + R)."""
    p, r = tp / n_pred, tp / n_true
    return F.when((n_pred == 0) & (n_true == 0), F.lit(1.0)).when(tp == 0, F.lit(0.0)).otherwise(1.25 * p * r / (0.25 * p + r)).cast("double")


def record_counts(ids: DataFrame, pred: DataFrame, true: DataFrame, s1: str = "s1_id", q: str = "s23_id", grid: tuple[str, list] | None = None) -> DataFrame:
    """(tp, n_pred, n_true) for every id, from one aggregate over the union of both pair sets.

    grid: a column of pred and the few values that it takes; every id has a row for each value, also where nothing is predicted. True
    pairs do not depend on the point: they are marked on the predictions and counted once, and only ids are multiplied by the grid.
    """
    extra = [grid[0]] if grid else []
    t = true.select(s1, q).distinct()
    p = pred.select(s1, q, *extra).distinct().join(t.withColumn("hit", F.lit(1)), [s1, q], "left")
    found = p.groupBy(s1, *extra).agg(F.count("hit").alias("tp"), F.count(F.lit(1)).alias("n_pred"))
    all_ids = ids.select(s1, *(c for c in ids.columns if c not in (s1, *extra))).distinct().join(t.groupBy(s1).agg(F.count(F.lit(1)).alias("n_true")), s1, "left")
    if grid:
        all_ids = all_ids.withColumn(grid[0], F.explode(F.array(*map(F.lit, grid[1]))))
    return all_ids.join(found, [s1, *extra], "left").na.fill(0, ["tp", "n_pred", "n_true"])


def macro_f05(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean F0.5 over all records, micro precision and recall, and accuracy on records without truth."""
    tp, n_pred, n_true = (F.sum(c).cast("double") for c in ("tp", "n_pred", "n_true"))
    return counts.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(f05(F.col("tp"), F.col("n_pred"), F.col("n_true"))), 6).alias("f05"),
        F.round(F.try_divide(tp, n_pred), 6).alias("micro_p"), F.round(F.try_divide(tp, n_true), 6).alias("micro_r"),
        F.round(F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double"))), 6).alias("singleton_acc"),
    )


#: Ranges that the distinct scores of an AUC are dealt to.
RANGES = 64


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """ROC AUC by mean ranks: scores are counted first, dealt out by range, and ranked within ranges on top of the ranges below; no task sees all."""
    from pyspark.sql import Window

    levels = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    dealt = levels.repartitionByRange(RANGES, score).withColumn("part", F.spark_partition_id())
    sizes = dealt.groupBy("part").agg(F.sum("n").alias("whole"))
    base = sizes.withColumn("base", F.sum("whole").over(Window.orderBy("part")) - F.col("whole")).drop("whole")  # RANGES rows
    before = F.sum("n").over(Window.partitionBy("part").orderBy(score)) - F.col("n")
    ranked = dealt.join(F.broadcast(base), "part").withColumn("rank", F.col("base") + before + (F.col("n") + 1) / 2)
    pos, neg = F.sum("pos"), F.sum(F.col("n") - F.col("pos"))
    return ranked.agg(F.round(((F.sum(F.col("rank") * F.col("pos")) - pos * (pos + 1) / 2) / (pos * neg)).cast("double"), 6).alias("auc"))
