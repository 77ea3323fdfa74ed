"""Joins, aggregates, windows, sampling and set operations over scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.fixtures import S1, SP, TP, s1_ids, scored_pairs, table, truth_pairs
from kinloom.operators import decide, windows
from kinloom.registry import REGISTRY

q = REGISTRY.query


@q(f"WITH {TP} SELECT s23_id, s1_id FROM tp")
def io3_explode_truth(spark: SparkSession, sf: str) -> DataFrame:
    """Wide comma lists of truth, exploded again."""
    wide = truth_pairs(spark, sf).groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set(F.col("s23_id").cast("string"))), ",").alias("ids"))
    return wide.select(F.explode(F.split("ids", ",")).alias("m"), "s1_id").where("m <> ''").select(F.col("m").cast("long").alias("s23_id"), "s1_id")


@q(f"WITH {SP}, {S1} SELECT s1.s1_id, coalesce(string_agg(CAST(s23_id AS VARCHAR), ',' ORDER BY CAST(s23_id AS VARCHAR)), '') AS ids FROM s1 LEFT JOIN (SELECT * FROM sp WHERE p >= 0.9) x ON x.s1_id = s1.s1_id GROUP BY 1")
def io4_id_lists(spark: SparkSession, sf: str) -> DataFrame:
    from kinloom.sources.tables import id_lists

    return id_lists(s1_ids(spark, sf), scored_pairs(spark, sf).where("p >= 0.9"), "s1_id", "s23_id", "ids")


@q(f"WITH {SP} SELECT coalesce(a.s1_id, b.s1_id) AS s1_id, coalesce(a.s23_id, b.s23_id) AS s23_id, a.p AS pa, b.p AS pb FROM (SELECT * FROM sp WHERE p < 0.6) a FULL JOIN (SELECT * FROM sp WHERE p > 0.4) b ON a.s1_id = b.s1_id AND a.s23_id = b.s23_id")
def j3_full_outer_channels(spark: SparkSession, sf: str) -> DataFrame:
    sp = scored_pairs(spark, sf)
    a, b = sp.where("p < 0.6").select("s1_id", "s23_id", F.col("p").alias("pa")), sp.where("p > 0.4").select("s1_id", "s23_id", F.col("p").alias("pb"))
    return a.join(b, ["s1_id", "s23_id"], "full_outer")


@q(f"WITH {SP}, {TP} SELECT sp.s1_id, sp.s23_id, p FROM sp JOIN tp ON sp.s1_id = tp.s1_id AND sp.s23_id = tp.s23_id")
def j1_inner_truth(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).join(truth_pairs(spark, sf), ["s1_id", "s23_id"]).select("s1_id", "s23_id", "p")


@q(f"WITH {SP}, {TP} SELECT sp.s1_id, sp.s23_id, CAST(tp.s1_id IS NOT NULL AS INTEGER) AS label FROM sp LEFT JOIN tp ON sp.s1_id = tp.s1_id AND sp.s23_id = tp.s23_id")
def j2_left_label(spark: SparkSession, sf: str) -> DataFrame:
    t = truth_pairs(spark, sf).withColumn("label", F.lit(1))
    return scored_pairs(spark, sf).join(t, ["s1_id", "s23_id"], "left").select("s1_id", "s23_id", F.coalesce("label", F.lit(0)).alias("label"))


@q(f"WITH {SP}, {TP} SELECT * FROM sp WHERE EXISTS (SELECT 1 FROM tp WHERE tp.s23_id = sp.s23_id)")
def j4_semi_truth(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).join(truth_pairs(spark, sf), "s23_id", "left_semi")


@q(f"WITH {SP}, {TP} SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.s23_id = sp.s23_id)")
def j5_anti_truth(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).join(truth_pairs(spark, sf), "s23_id", "left_anti")


@q(f"WITH {SP}, {S1} SELECT s1.s1_id, src.src, count(sp.s23_id) AS n FROM s1 CROSS JOIN (VALUES (2), (3)) src(src) LEFT JOIN sp ON sp.s1_id = s1.s1_id AND sp.src = src.src GROUP BY 1, 2")
def j6_dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    grid = s1_ids(spark, sf).select("s1_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("src"))
    n = scored_pairs(spark, sf).groupBy("s1_id", "src").agg(F.count("*").alias("n"))
    return grid.join(n, ["s1_id", "src"], "left").select("s1_id", "src", F.coalesce("n", F.lit(0)).alias("n"))


@q(f"WITH {SP} SELECT a.s1_id, a.s23_id AS m1, b.s23_id AS m2 FROM sp a JOIN sp b ON a.s1_id = b.s1_id AND a.s23_id < b.s23_id WHERE a.p > 0.95 AND b.p > 0.95")
def j7_self_residual(spark: SparkSession, sf: str) -> DataFrame:
    top = scored_pairs(spark, sf).where("p > 0.95")
    a, b = top.select("s1_id", F.col("s23_id").alias("m1")), top.select("s1_id", F.col("s23_id").alias("m2"))
    return a.join(b, "s1_id").where("m1 < m2")


@q(f"WITH {SP}, {TP} SELECT s1_id, s23_id, p FROM sp WHERE (s1_id, s23_id) IN (SELECT s1_id, s23_id FROM tp) AND country IN ('US', 'France')")
def j8_struct_membership(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).where(F.col("country").isin("US", "France")).join(truth_pairs(spark, sf), ["s1_id", "s23_id"], "left_semi").select("s1_id", "s23_id", "p")


@q(f"WITH {SP} SELECT country, count(*) AS n, round(avg(p), 6) AS mean, round(sum(p), 6) AS total, min(p) AS least, max(p) AS most, count(CASE WHEN p > 0.5 THEN 1 END) AS over_half FROM sp GROUP BY 1")
def a1_group_basics(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"), F.round(F.sum("p"), 6).alias("total"), F.min("p").alias("least"), F.max("p").alias("most"), F.count(F.when(F.col("p") > 0.5, 1)).alias("over_half"))


@q(f"WITH {SP} SELECT country, round(coalesce(sum(p) FILTER (WHERE src = 2), 0), 6) AS s2_sum, count(*) FILTER (WHERE p >= 0.75) AS hits, round(avg(CAST(p >= 0.5 AS DOUBLE)), 6) AS share FROM sp GROUP BY 1")
def a2_conditional_aggs(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country").agg(F.round(F.coalesce(F.sum(F.when(F.col("src") == 2, F.col("p"))), F.lit(0.0)), 6).alias("s2_sum"), F.count_if(F.col("p") >= 0.75).alias("hits"), F.round(F.avg((F.col("p") >= 0.5).cast("double")), 6).alias("share"))


@q(f"WITH {SP} SELECT country, count(DISTINCT s23_id) AS queries, count(DISTINCT s1_id) AS records FROM sp GROUP BY 1")
def a3_distinct_queries(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country").agg(F.countDistinct("s23_id").alias("queries"), F.countDistinct("s1_id").alias("records"))


@q(f"WITH {SP} SELECT s1_id, arg_max(s23_id, struct_pack(p := p, k := -s23_id)) AS best, arg_min(s23_id, struct_pack(p := p, k := s23_id)) AS worst FROM sp GROUP BY 1")
def a4_ordered_first_last(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("s1_id").agg(F.max_by("s23_id", F.struct("p", -F.col("s23_id"))).alias("best"), F.min_by("s23_id", F.struct("p", "s23_id")).alias("worst"))


@q(f"WITH {SP} SELECT s23_id, count(DISTINCT country) AS countries, string_agg(DISTINCT country, '|' ORDER BY country) AS names FROM sp GROUP BY 1")
def a5_collect_unique(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array_sort(F.collect_set("country"))
    return scored_pairs(spark, sf).groupBy("s23_id").agg(names.alias("c")).select("s23_id", F.size("c").cast("long").alias("countries"), F.array_join("c", "|").alias("names"))


@q(f"WITH {SP} SELECT country, round(quantile_cont(p, 0.25), 6) AS q25, round(quantile_cont(p, 0.5), 6) AS q50, round(quantile_cont(p, 0.9), 6) AS q90, round(corr(p, CAST(src AS DOUBLE)), 6) AS c FROM sp GROUP BY 1")
def a7_score_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country").agg(*(F.round(F.percentile("p", F.lit(x)), 6).alias(n) for n, x in (("q25", 0.25), ("q50", 0.5), ("q90", 0.9))), F.round(F.corr("p", F.col("src").cast("double")), 6).alias("c"))


@q(f"WITH {SP} SELECT country, src, count(*) AS count FROM sp GROUP BY 1, 2")
def a8_value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country", "src").count()


@q(f"WITH {SP} SELECT country, count(*) FILTER (WHERE src = 2) AS s2, count(*) FILTER (WHERE src = 3) AS s3 FROM sp GROUP BY 1")
def a9_pivot_country_src(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country").pivot("src", [2, 3]).count().select("country", F.coalesce("2", F.lit(0)).alias("s2"), F.coalesce("3", F.lit(0)).alias("s3"))


@q(f"WITH {SP} SELECT country, src, round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY country) AS DOUBLE), 6) AS share FROM sp GROUP BY 1, 2")
def a10_share_of_group(spark: SparkSession, sf: str) -> DataFrame:
    n = scored_pairs(spark, sf).groupBy("country", "src").agg(F.count("*").alias("n"))
    return n.select("country", "src", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("country")), 6).alias("share"))


@q(f"WITH {SP} SELECT country, CAST(floor(p * 10) AS BIGINT) AS bin, count(*) AS n FROM sp GROUP BY 1, 2")
def a11_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country", F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"))


@q(f"WITH {SP} SELECT country, round(count(*) FILTER (WHERE p > 0.9) * 1000.0 / CAST(count(DISTINCT s1_id) AS DOUBLE), 6) AS rate FROM sp GROUP BY 1")
def a12_rate_per_1000(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).groupBy("country").agg(F.round(F.count_if(F.col("p") > 0.9) * F.lit(1000.0).cast("double") / F.countDistinct("s1_id"), 6).alias("rate"))


@q(f"WITH {SP} SELECT s1_id, round((sum(CAST(p > 0.5 AS INTEGER)) + 20 * max(prior)) / (count(*) + 20), 6) AS rate FROM (SELECT *, avg(CAST(p > 0.5 AS DOUBLE)) OVER (PARTITION BY country) AS prior FROM sp) GROUP BY 1")
def a13_smoothed_rate(spark: SparkSession, sf: str) -> DataFrame:
    hit = (F.col("p") > 0.5).cast("double")
    sp = scored_pairs(spark, sf).withColumn("prior", F.avg(hit).over(Window.partitionBy("country")))
    return sp.groupBy("s1_id").agg(F.round((F.sum(hit) + 20 * F.max("prior")) / (F.count("*") + 20), 6).alias("rate"))


@q(f"WITH {SP} SELECT country, src, count(*) AS n, round(avg(p), 6) AS mean FROM sp GROUP BY GROUPING SETS ((country, src), (src))")
def a14_grouping_sets_ratio(spark: SparkSession, sf: str) -> DataFrame:
    sp = scored_pairs(spark, sf)
    return sp.groupingSets([["country", "src"], ["src"]], "country", "src").agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"))


@q(f"WITH {SP} SELECT s1_id, s23_id, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) - 1 AS rank FROM sp")
def x1_ordinal_rank(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).select("s1_id", "s23_id", windows.rank0("s23_id", "p", "s1_id").alias("rank"))


@q(f"WITH {SP} SELECT s1_id, s23_id, round(p - max(p) OVER (PARTITION BY s23_id), 6) AS gap FROM sp")
def x2_gap_best(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.round(windows.gap_to_best("s23_id", "p"), 6).alias("gap"))


@q(f"WITH {SP}, r AS (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp) SELECT s1_id, s23_id, round(p - min(CASE WHEN k <= 2 THEN p END) OVER (PARTITION BY s23_id), 6) AS gap FROM r")
def x3_gap_second(spark: SparkSession, sf: str) -> DataFrame:
    sp = scored_pairs(spark, sf).withColumn("second", windows.second_best("s23_id", "p", "s1_id"))
    return sp.select("s1_id", "s23_id", F.round(F.col("p") - F.coalesce("second", "p"), 6).alias("gap"))


@q(f"WITH {SP}, r AS (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp) SELECT s23_id, coalesce(max(CASE WHEN k = 2 THEN p END), 0) AS p2 FROM r GROUP BY 1")
def x4_second_or_zero(spark: SparkSession, sf: str) -> DataFrame:
    top = windows.top_n(scored_pairs(spark, sf), "s23_id", "p", "s1_id", 2)
    return top.groupBy("s23_id").agg(F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("p"))), F.lit(0.0)).alias("p2"))


@q(f"WITH {SP} SELECT s1_id, s23_id, count(*) OVER (PARTITION BY s23_id) AS q_n, count(*) OVER (PARTITION BY s1_id, src) AS s1_src_n FROM sp")
def x5_partition_counts(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.count("*").over(Window.partitionBy("s23_id")).alias("q_n"), F.count("*").over(Window.partitionBy("s1_id", "src")).alias("s1_src_n"))


@q(f"WITH {SP}, m AS (SELECT *, max(p) OVER (PARTITION BY s23_id) AS top FROM sp) SELECT s23_id, count(*) FILTER (WHERE p >= top - 0.02) AS ties FROM m GROUP BY 1")
def x6_tie_count(spark: SparkSession, sf: str) -> DataFrame:
    m = scored_pairs(spark, sf).withColumn("top", F.max("p").over(Window.partitionBy("s23_id")))
    return m.groupBy("s23_id").agg(F.count_if(F.col("p") >= F.col("top") - F.lit(0.02).cast("double")).alias("ties"))


@q(f"WITH {SP} SELECT s1_id, s23_id, round(sum(p) OVER w, 6) AS running, count(*) OVER w AS k FROM sp WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, s23_id ROWS UNBOUNDED PRECEDING)")
def x7_running_sum(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s1_id").orderBy(F.col("p").desc(), "s23_id").rowsBetween(Window.unboundedPreceding, 0)
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.round(F.sum("p").over(w), 6).alias("running"), F.count("*").over(w).alias("k"))


@q(f"WITH {SP} SELECT s1_id, s23_id, round(p - lag(p) OVER (PARTITION BY s1_id ORDER BY p, s23_id), 6) AS step FROM sp")
def x8_lag_gap(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s1_id").orderBy("p", "s23_id")
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.round(F.col("p") - F.lag("p").over(w), 6).alias("step"))


@q(f"WITH {SP} SELECT s1_id, s23_id, p, src, country FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp) WHERE k = 1")
def x9_top1_per_query(spark: SparkSession, sf: str) -> DataFrame:
    return windows.best_of(scored_pairs(spark, sf), ["s23_id"], [F.col("p"), -F.col("s1_id")])


@q(f"WITH {SP} SELECT s1_id, s23_id, p, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, s23_id) AS k FROM sp) WHERE k <= 3")
def x10_top_n(spark: SparkSession, sf: str) -> DataFrame:
    return windows.top_n(scored_pairs(spark, sf), "s1_id", "p", "s23_id", 3).select("s1_id", "s23_id", "p", "rank")


@q(f"WITH {SP} SELECT s1_id, s23_id, max(p) OVER w AS most, min(p) OVER w AS least, round(sum(p) OVER w, 6) AS total FROM sp WINDOW w AS (PARTITION BY s1_id)")
def x11_group_back(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s1_id")
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.max("p").over(w).alias("most"), F.min("p").over(w).alias("least"), F.round(F.sum("p").over(w), 6).alias("total"))


@q(f"WITH {SP} SELECT s1_id, s23_id, (p > 0.8 AND count(*) FILTER (WHERE p > 0.8) OVER (PARTITION BY s23_id) = 1) AS alone FROM sp")
def x12_unique_in_group(spark: SparkSession, sf: str) -> DataFrame:
    hit = F.col("p") > 0.8
    return scored_pairs(spark, sf).select("s1_id", "s23_id", (hit & (F.count_if(hit).over(Window.partitionBy("s23_id")) == 1)).alias("alone"))


@q(f"WITH {SP} SELECT country, s1_id, s23_id, p FROM sp ORDER BY country, p DESC, s1_id, s23_id")
def s1_mixed_sort(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs in order, dealt out by ranges; no country is sorted by one task."""
    return scored_pairs(spark, sf).select("country", "s1_id", "s23_id", "p").orderBy("country", F.col("p").desc(), "s1_id", "s23_id")


@q(f"WITH {SP} SELECT s1_id, s23_id, p FROM sp ORDER BY md5(CAST(s1_id AS VARCHAR) || ':' || CAST(s23_id AS VARCHAR)), s1_id, s23_id LIMIT 500")
def s3_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    h = F.md5(F.concat(F.col("s1_id").cast("string"), F.lit(":"), F.col("s23_id").cast("string")).cast("binary"))
    return scored_pairs(spark, sf).orderBy(h, "s1_id", "s23_id").limit(500).select("s1_id", "s23_id", "p")


@q(f"WITH {SP}, {TP} SELECT s1_id, s23_id FROM sp WHERE p > 0.9 UNION ALL SELECT s1_id, s23_id FROM tp")
def s4_union_all(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).where("p > 0.9").select("s1_id", "s23_id").unionByName(truth_pairs(spark, sf))


@q(f"WITH {SP}, {TP} SELECT s1_id, s23_id FROM sp WHERE p > 0.9 UNION SELECT s1_id, s23_id FROM tp")
def s5_union_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return s4_union_all(spark, sf).distinct()


@q(f"WITH {SP}, {TP} SELECT s1_id, s23_id, p FROM sp WHERE p > 0.9 UNION ALL SELECT s1_id, s23_id, CAST(NULL AS DOUBLE) AS p FROM tp")
def s6_union_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).where("p > 0.9").select("s1_id", "s23_id", "p").unionByName(truth_pairs(spark, sf), allowMissingColumns=True)


@q(f"WITH {SP}, {TP} SELECT s1_id, s23_id, 'both' AS side FROM (SELECT s1_id, s23_id FROM sp WHERE p > 0.5 INTERSECT SELECT s1_id, s23_id FROM tp) UNION ALL SELECT s1_id, s23_id, 'missed' FROM (SELECT s1_id, s23_id FROM tp EXCEPT SELECT s1_id, s23_id FROM sp WHERE p > 0.5)")
def s7_pair_except(spark: SparkSession, sf: str) -> DataFrame:
    sp, tp = scored_pairs(spark, sf).where("p > 0.5").select("s1_id", "s23_id"), truth_pairs(spark, sf).select("s1_id", "s23_id")
    return sp.intersect(tp).withColumn("side", F.lit("both")).unionByName(tp.subtract(sp).withColumn("side", F.lit("missed")))


@q(f"WITH {SP} SELECT DISTINCT s1_id, country FROM sp")
def s8_distinct_subset(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).select("s1_id", "country").dropDuplicates(["s1_id", "country"])


@q(f"WITH {SP}, {TP} SELECT CAST(sp.s23_id AS VARCHAR) || '_dup' || CAST(i AS VARCHAR) AS q_id, sp.s1_id, p FROM sp, (SELECT unnest(range(3)) AS i) r WHERE NOT EXISTS (SELECT 1 FROM tp WHERE tp.s23_id = sp.s23_id)")
def s10_replicate_decoys(spark: SparkSession, sf: str) -> DataFrame:
    decoys = scored_pairs(spark, sf).join(truth_pairs(spark, sf), "s23_id", "left_anti").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return decoys.select(F.concat(F.col("s23_id").cast("string"), F.lit("_dup"), F.col("i").cast("string")).alias("q_id"), "s1_id", "p")


@q(f"WITH {SP} SELECT s1_id, s23_id FROM sp WHERE ('0x' || substr(md5(CAST(s1_id AS VARCHAR)), 1, 8))::BIGINT % 100 >= 30")
def s11_hash_drop(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).where(decide.md5_mod(F.col("s1_id"), 100) >= 30).select("s1_id", "s23_id")


@q(f"WITH {SP} SELECT s1_id, s23_id, CASE WHEN p > 0.9 THEN 'high' WHEN p > 0.5 AND src = 2 THEN 'mid2' WHEN p > 0.5 THEN 'mid3' ELSE 'low' END AS cell, CASE WHEN p < 0.2 THEN -1.0 ELSE p END AS coded FROM sp")
def c1_c2_branches(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    cell = F.when(p > 0.9, "high").when((p > 0.5) & (F.col("src") == 2), "mid2").when(p > 0.5, "mid3").otherwise("low")
    return scored_pairs(spark, sf).select("s1_id", "s23_id", cell.alias("cell"), F.when(p < 0.2, F.lit(-1.0)).otherwise(p).cast("double").alias("coded"))


@q(f"WITH {SP} SELECT s1_id, s23_id, p FROM sp WHERE p >= CASE country WHEN 'India' THEN 0.8 ELSE 0.75 END")
def c3_country_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).where(F.col("p") >= decide.by_country(F.col("country"), decide.THRESHOLDS, decide.DEFAULT_THRESHOLD)).select("s1_id", "s23_id", "p")


@q(f"WITH {SP} SELECT s1_id, s23_id, nullif(country, 'US') AS other, greatest(least(p, 0.9), 0.1) AS clipped, round(ln(1 + p) + sqrt(p) + abs(p - 0.5), 6) AS mixed, greatest(p, p * p) AS most, least(p, 1 - p) AS fewest, coalesce(nullif(country, 'US'), 'home') AS place, least(nullif(p, 0.5), CASE WHEN src = 2 THEN 0.4 END) AS fewest_known, round(coalesce(CASE WHEN src = 2 THEN p END, 0) + coalesce(CASE WHEN country = 'India' THEN p END, 0) + p, 6) AS total FROM sp WHERE p BETWEEN 0.05 AND 0.95")
def c4_c9_scalars(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    return scored_pairs(spark, sf).where(p.between(0.05, 0.95)).select(
        "s1_id", "s23_id", F.nullif(F.col("country"), F.lit("US")).alias("other"), F.greatest(F.least(p, F.lit(0.9)), F.lit(0.1)).alias("clipped"),
        F.round(F.log1p(p) + F.sqrt(p) + F.abs(p - 0.5), 6).alias("mixed"), F.greatest(p, p * p).alias("most"), F.least(p, 1 - p).alias("fewest"),
        F.coalesce(F.nullif(F.col("country"), F.lit("US")), F.lit("home")).alias("place"), F.least(F.nullif(p, F.lit(0.5)), F.when(F.col("src") == 2, 0.4)).alias("fewest_known"),
        F.round(F.coalesce(F.when(F.col("src") == 2, p), F.lit(0.0)) + F.coalesce(F.when(F.col("country") == "India", p), F.lit(0.0)) + p, 6).alias("total"),
    )


@q(f"WITH {SP} SELECT CASE WHEN p <= 0.2 THEN 'a' WHEN p <= 0.5 THEN 'b' WHEN p <= 0.75 THEN 'c' ELSE 'd' END AS band, count(*) AS n, round(avg(p), 6) AS mean FROM sp GROUP BY 1")
def c8_band_cut(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p")
    band = F.when(p <= 0.2, "a").when(p <= 0.5, "b").when(p <= 0.75, "c").otherwise("d")
    return scored_pairs(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean"))


@q(f"WITH {SP} SELECT s1_id, s23_id, round(1 / (1 + exp(-(ln(c / (1 - c)) - 0.7))), 6) AS p2 FROM (SELECT *, greatest(least(p, 0.999), 0.001) AS c FROM sp)")
def c10_logit_shift(spark: SparkSession, sf: str) -> DataFrame:
    c = F.greatest(F.least(F.col("p"), F.lit(0.999)), F.lit(0.001))
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.round(1 / (1 + F.exp(-(F.log(c / (1 - c)) - 0.7))), 6).alias("p2"))


@q("SELECT r_name, n_name, sum(CASE WHEN side = 'c' THEN n ELSE 0 END)::BIGINT AS customers, sum(CASE WHEN side = 's' THEN n ELSE 0 END)::BIGINT AS suppliers FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey AS k, 'c' AS side, count(*) AS n FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, 's', count(*) FROM supplier GROUP BY 1) x ON k = n_nationkey GROUP BY 1, 2")
def e16_structure_counts(spark: SparkSession, sf: str) -> DataFrame:
    sides = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("side", F.lit("c"))
    sides = sides.unionByName(table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).withColumn("side", F.lit("s")))
    grid = table(spark, sf, "region").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(sides, F.col("k") == F.col("n_nationkey"), "left")
    pick = lambda s: F.sum(F.when(F.col("side") == s, F.col("n")).otherwise(0))
    return grid.groupBy("r_name", "n_name").agg(pick("c").alias("customers"), pick("s").alias("suppliers"))


@q(f"WITH {SP}, r AS (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp) SELECT s1_id, s23_id, count(*) OVER (PARTITION BY s23_id) AS q_ncand, k - 1 AS q_rank, round(p - max(p) OVER (PARTITION BY s23_id), 6) AS q_gap_best, round(p - min(CASE WHEN k <= 2 THEN p END) OVER (PARTITION BY s23_id), 6) AS q_gap_2nd, round(p - max(p) OVER (PARTITION BY s1_id), 6) AS s1_gap_best, count(*) OVER (PARTITION BY s1_id) AS s1_nq FROM r")
def p2_context(spark: SparkSession, sf: str) -> DataFrame:
    return windows.context(scored_pairs(spark, sf)).select("s1_id", "s23_id", "q_ncand", "q_rank", "q_gap_best", "q_gap_2nd", "s1_gap_best", "s1_nq")
