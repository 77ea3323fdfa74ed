"""Assignment, thresholds, gating, decoding, metrics, diagnostics and invariants over scored pairs and truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.fixtures import PE, S1, SP, TP, parts_entities, s1_ids, scored_pairs, truth_pairs
from kinloom.operators import decide, metrics, windows
from kinloom.registry import REGISTRY

q = REGISTRY.query
TH = "CASE country WHEN 'India' THEN 0.8 ELSE 0.75 END"
ASSIGNED = f"asg AS (SELECT s1_id, s23_id, p, src, country FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp WHERE p >= {TH}) WHERE k = 1)"


def fsql(pred: str, true: str = "tp", by: str = "", ids: str = "s1") -> str:
    """SQL of the macro F0.5 of pred (s1_id, s23_id) against true over ids."""
    return f"""SELECT {by + ',' if by else ''} count(*) AS n, round(avg(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END), 6) AS f05,
      round(sum(tp) / nullif(sum(n_pred), 0), 6) AS micro_p, round(sum(tp) / nullif(sum(n_true), 0), 6) AS micro_r, round(avg(CASE WHEN n_true = 0 THEN CAST(n_pred = 0 AS DOUBLE) END), 6) AS singleton_acc
    FROM (SELECT i.*, CAST(coalesce(a.n_pred, 0) AS DOUBLE) AS n_pred, CAST(coalesce(b.n_true, 0) AS DOUBLE) AS n_true, CAST(coalesce(c.tp, 0) AS DOUBLE) AS tp FROM {ids} i
      LEFT JOIN (SELECT s1_id, count(DISTINCT s23_id) AS n_pred FROM {pred} GROUP BY 1) a ON a.s1_id = i.s1_id
      LEFT JOIN (SELECT s1_id, count(DISTINCT s23_id) AS n_true FROM {true} GROUP BY 1) b ON b.s1_id = i.s1_id
      LEFT JOIN (SELECT x.s1_id, count(DISTINCT x.s23_id) AS tp FROM {pred} x JOIN {true} y ON x.s1_id = y.s1_id AND x.s23_id = y.s23_id GROUP BY 1) c ON c.s1_id = i.s1_id) {'GROUP BY ' + by if by else ''}"""


S1C = "s1c AS (SELECT p_partkey AS s1_id, CASE p_partkey % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country FROM part)"


def ids_by_country(spark: SparkSession, sf: str) -> DataFrame:
    c = F.when(F.col("s1_id") % 3 == 0, "US").when(F.col("s1_id") % 3 == 1, "India").otherwise("France")
    return s1_ids(spark, sf).withColumn("country", c)


def threshold() -> Column:
    return decide.by_country(F.col("country"), decide.THRESHOLDS, decide.DEFAULT_THRESHOLD)


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    return decide.assign(scored_pairs(spark, sf), threshold())


def measured(spark: SparkSession, sf: str, pred: DataFrame, true: DataFrame | None = None) -> DataFrame:
    return metrics.macro_f05(metrics.record_counts(s1_ids(spark, sf), pred, true or truth_pairs(spark, sf)))


@q(f"WITH {SP}, {ASSIGNED} SELECT * FROM asg")
def m10_assign(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf)


@q(f"WITH {SP}, {TP}, {S1}, {ASSIGNED} {fsql('asg')}")
def e1_macro_f05(spark: SparkSession, sf: str) -> DataFrame:
    return measured(spark, sf, assigned(spark, sf))


@q(f"WITH {SP}, {TP}, {S1C}, {ASSIGNED} {fsql('asg', by='country', ids='s1c')}")
def e1_macro_f05_by_country(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.record_counts(ids_by_country(spark, sf), assigned(spark, sf), truth_pairs(spark, sf))
    return metrics.macro_f05(counts, ["country"])


GRID = [round(0.2 + 0.05 * i, 2) for i in range(16)]


def swept(spark: SparkSession, sf: str) -> DataFrame:
    """F0.5 at every threshold of the grid, in one pass: a query's best pair does not depend on the threshold below its score."""
    best = windows.best_of(scored_pairs(spark, sf), ["s23_id"], [F.col("p"), -F.col("s1_id")])
    pred = best.withColumn("t", F.explode(F.array(*map(F.lit, GRID)))).where(F.col("p") >= F.col("t"))
    return metrics.macro_f05(metrics.record_counts(s1_ids(spark, sf), pred, truth_pairs(spark, sf), grid=("t", GRID)), ["t"])


SWEEP = f"""grid AS (SELECT unnest({GRID}) AS t), best AS (SELECT s1_id, s23_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp) WHERE k = 1),
  pr AS (SELECT t, s1_id, s23_id FROM best, grid WHERE p >= t),
  cnt AS (SELECT s1.s1_id, grid.t, CAST(coalesce(a.n_pred, 0) AS DOUBLE) AS n_pred, CAST(coalesce(a.tp, 0) AS DOUBLE) AS tp, CAST(coalesce(b.n_true, 0) AS DOUBLE) AS n_true FROM s1 CROSS JOIN grid
    LEFT JOIN (SELECT t, pr.s1_id, count(*) AS n_pred, count(tp.s1_id) AS tp FROM pr LEFT JOIN tp ON tp.s1_id = pr.s1_id AND tp.s23_id = pr.s23_id GROUP BY 1, 2) a ON a.s1_id = s1.s1_id AND a.t = grid.t
    LEFT JOIN (SELECT s1_id, count(*) AS n_true FROM tp GROUP BY 1) b ON b.s1_id = s1.s1_id),
  sw AS (SELECT CAST(t AS DOUBLE) AS t, count(*) AS n, round(avg(CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END), 6) AS f05 FROM cnt GROUP BY 1)"""


@q(f"WITH {SP}, {TP}, {S1}, {SWEEP} SELECT t, n, f05 FROM sw")
def e3_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return swept(spark, sf).select(F.col("t").cast("double").alias("t"), "n", "f05")


@q(f"WITH {SP}, {TP}, {S1}, {SWEEP} SELECT t, f05 FROM sw ORDER BY f05 DESC, t LIMIT 1")
def m11_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The first threshold of the grid with the best F0.5."""
    return swept(spark, sf).select(F.col("t").cast("double").alias("t"), "f05").orderBy(F.col("f05").desc(), "t").limit(1)


@q(f"WITH {SP} SELECT s1_id, s23_id, p FROM sp WHERE NOT EXISTS (SELECT 1 FROM sp h WHERE h.s23_id = sp.s23_id AND ('0x' || substr(md5(CAST(h.s1_id AS VARCHAR)), 1, 8))::BIGINT % 10 = 0)")
def m8_leak_free_queries(spark: SparkSession, sf: str) -> DataFrame:
    return decide.leak_free(scored_pairs(spark, sf), decide.md5_mod(F.col("s1_id"), 10) == 0).select("s1_id", "s23_id", "p")


@q(f"WITH {SP}, b AS (SELECT s23_id, arg_max(s1_id, struct_pack(p := p, k := -s1_id)) AS top FROM sp GROUP BY 1) SELECT ('0x' || substr(md5(CAST(top AS VARCHAR)), 1, 8))::BIGINT % 5 AS fold, count(*) AS queries FROM b GROUP BY 1")
def m9_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    best = scored_pairs(spark, sf).groupBy("s23_id").agg(F.max_by("s1_id", F.struct("p", -F.col("s1_id"))).alias("top"))
    return best.groupBy(decide.md5_mod(F.col("top"), 5).alias("fold")).agg(F.count("*").alias("queries"))


@q(f"WITH {SP} SELECT s1_id, s23_id, round((p + (p * p + p) / 2) / 2, 6) AS p2 FROM sp WHERE (p + (p * p + p) / 2) / 2 >= 0.001")
def m12_cascade_cut(spark: SparkSession, sf: str) -> DataFrame:
    mean = (F.col("p") + (F.col("p") * F.col("p") + F.col("p")) / 2) / 2
    return scored_pairs(spark, sf).where(mean >= F.lit(0.001).cast("double")).select("s1_id", "s23_id", F.round(mean, 6).alias("p2"))


@q(f"WITH {SP}, {TP} SELECT sp.s1_id, sp.s23_id, p, CAST(tp.s1_id IS NOT NULL AS BIGINT) AS label FROM sp LEFT JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id WHERE abs(ln(c / (1 - c))) < 2 OR ('0x' || substr(md5(CAST(sp.s23_id AS VARCHAR)), 1, 8))::BIGINT % 4 = 0".replace("FROM sp LEFT", "FROM (SELECT *, greatest(least(p, 0.999), 0.001) AS c FROM sp) sp LEFT"))
def m5_hard_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs in the uncertain band, and a quarter of the easy queries; with labels."""
    c = F.greatest(F.least(F.col("p"), F.lit(0.999)), F.lit(0.001))
    hard = scored_pairs(spark, sf).where((F.abs(F.log(c / (1 - c))) < 2) | (decide.md5_mod(F.col("s23_id"), 4) == 0))
    return hard.join(truth_pairs(spark, sf).withColumn("label", F.lit(1).cast("long")), ["s1_id", "s23_id"], "left").select("s1_id", "s23_id", "p", F.coalesce("label", F.lit(0)).alias("label"))


@q(f"WITH {SP}, {TP} SELECT sp.s1_id, sp.s23_id, CAST(tp.s1_id IS NOT NULL AS BIGINT) AS label FROM sp LEFT JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id")
def m7_label_join(spark: SparkSession, sf: str) -> DataFrame:
    t = truth_pairs(spark, sf).withColumn("label", F.lit(1).cast("long"))
    return scored_pairs(spark, sf).join(t, ["s1_id", "s23_id"], "left").select("s1_id", "s23_id", F.coalesce("label", F.lit(0)).alias("label"))


@q(f"WITH {SP}, {ASSIGNED}, b AS (SELECT s1_id, s23_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp WHERE p >= 0.6) WHERE k = 1) SELECT * FROM b WHERE s23_id NOT IN (SELECT s23_id FROM asg)")
def m19_channel_accept(spark: SparkSession, sf: str) -> DataFrame:
    return decide.gated(scored_pairs(spark, sf), assigned(spark, sf), 0.6).select("s1_id", "s23_id", "p")


@q(f"WITH {SP}, {TP}, {ASSIGNED} SELECT s1_id, s23_id FROM asg UNION ALL SELECT s1_id, s23_id FROM tp WHERE s23_id NOT IN (SELECT s23_id FROM asg) AND s23_id % 7 = 0")
def m21_patch_apply(spark: SparkSession, sf: str) -> DataFrame:
    extra = truth_pairs(spark, sf).where("s23_id % 7 = 0").select("s1_id", "s23_id")
    return decide.patched(assigned(spark, sf).select("s1_id", "s23_id"), extra)


@q(f"WITH {SP}, {ASSIGNED}, b AS (SELECT s1_id, s23_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp WHERE p >= 0.6) WHERE k = 1) SELECT s1_id, s23_id, 'main' AS channel FROM asg UNION ALL SELECT s1_id, s23_id, 'rescue' FROM b WHERE s23_id NOT IN (SELECT s23_id FROM asg)")
def m20_output_assembly(spark: SparkSession, sf: str) -> DataFrame:
    main = assigned(spark, sf)
    rescue = decide.gated(scored_pairs(spark, sf), main, 0.6)
    return main.select("s1_id", "s23_id", F.lit("main").alias("channel")).unionByName(rescue.select("s1_id", "s23_id", F.lit("rescue").alias("channel")))


@q(f"""WITH {SP}, {ASSIGNED}, s AS (SELECT s1_id, s23_id, p, row_number() OVER w AS k, sum(p) OVER w AS run, sum(p) OVER (PARTITION BY s1_id) AS total, exp(sum(ln(greatest(1 - p, 0.000000001))) OVER (PARTITION BY s1_id) - 0.1) AS none
    FROM asg WINDOW w AS (PARTITION BY s1_id ORDER BY p DESC, s23_id ROWS UNBOUNDED PRECEDING)), v AS (SELECT *, round(1.25 * run / (0.25 * (total + 0.1) + k), 9) AS value FROM s),
  b AS (SELECT s1_id, arg_max(k, struct_pack(v := value, k := -k)) AS kb, max(value) AS best, round(max(none), 9) AS none FROM v GROUP BY 1) SELECT v.s1_id, s23_id, p, k FROM v JOIN b ON b.s1_id = v.s1_id WHERE best > b.none AND k <= kb""")
def m22_expected_f_decode(spark: SparkSession, sf: str) -> DataFrame:
    return decide.expected_f_decode(assigned(spark, sf))


@q(f"""WITH {SP}, d AS (SELECT unnest(range(20)) AS draw), u AS (SELECT draw, s1_id, s23_id, p, ('0x' || substr(md5(CAST(draw AS VARCHAR) || ':' || CAST(s23_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 AS u FROM sp, d),
  r AS (SELECT *, sum(p) OVER (PARTITION BY draw, s23_id ORDER BY s1_id ROWS UNBOUNDED PRECEDING) / greatest(sum(p) OVER (PARTITION BY draw, s23_id), 1) AS run FROM u)
  SELECT draw, count(*) AS pairs, sum(CAST(run >= u AND run - p < u AS BIGINT))::BIGINT AS hits FROM r GROUP BY 1""")
def m23_monte_carlo_truth(spark: SparkSession, sf: str) -> DataFrame:
    """A drawn truth for each query and draw, from uniforms that are hashes."""
    draws = scored_pairs(spark, sf).withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    key = F.concat(F.col("draw").cast("string"), F.lit(":"), F.col("s23_id").cast("string"))
    u = decide.md5_mod(key, 1 << 32) / F.lit(4294967296.0).cast("double")
    w = Window.partitionBy("draw", "s23_id")
    run = F.sum("p").over(w.orderBy("s1_id").rowsBetween(Window.unboundedPreceding, 0)) / F.greatest(F.sum("p").over(w), F.lit(1.0))
    drawn = draws.withColumns({"u": u, "run": run})
    return drawn.groupBy("draw").agg(F.count("*").alias("pairs"), F.count_if((F.col("run") >= F.col("u")) & (F.col("run") - F.col("p") < F.col("u"))).alias("hits"))


@q(f"WITH {SP}, {ASSIGNED} SELECT s1_id, s23_id, p FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, s23_id) AS k FROM sp WHERE s23_id NOT IN (SELECT s23_id FROM asg) AND s1_id NOT IN (SELECT s1_id FROM asg)) WHERE k = 1")
def m26_fill_empty_s1(spark: SparkSession, sf: str) -> DataFrame:
    done = assigned(spark, sf)
    free = scored_pairs(spark, sf).join(done.select("s23_id"), "s23_id", "left_anti").join(done.select("s1_id").distinct(), "s1_id", "left_anti")
    return windows.best_of(free.select("s1_id", "s23_id", "p"), ["s1_id"], [F.col("p"), -F.col("s23_id")])


@q(f"WITH {PE}, {SP}, {ASSIGNED} SELECT DISTINCT b.entity_id AS s1_id, asg.s23_id FROM asg JOIN pe a ON a.entity_id = asg.s1_id JOIN pe b ON b.country = a.country AND b.name_core = a.name_core AND b.state = a.state")
def m27_spread_siblings(spark: SparkSession, sf: str) -> DataFrame:
    e, key = parts_entities(spark, sf), ["country", "name_core", "state"]
    seeds = assigned(spark, sf).select("s23_id", F.col("s1_id").alias("seed")).join(e.select(F.col("entity_id").alias("seed"), *key), "seed")
    return seeds.join(e.select(F.col("entity_id").alias("s1_id"), *key), key).select("s1_id", "s23_id").distinct()


@q(f"WITH {SP}, k AS (SELECT *, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS k FROM sp), t AS (SELECT s23_id, max(CASE WHEN k = 1 THEN p END) AS p1, coalesce(max(CASE WHEN k = 2 THEN p END), 0) AS p2, max(CASE WHEN k = 1 THEN s1_id END) AS s1_id FROM k GROUP BY 1) SELECT s1_id, s23_id, CASE WHEN p1 >= 0.9 AND p2 < 0.7 THEN 1 WHEN p1 < 0.3 THEN 0 END AS label FROM t")
def m28_pseudo_labels(spark: SparkSession, sf: str) -> DataFrame:
    t = windows.top_n(scored_pairs(spark, sf), "s23_id", "p", "s1_id", 2).groupBy("s23_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("p"))).alias("p1"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("p"))), F.lit(0.0)).alias("p2"), F.max(F.when(F.col("rank") == 1, F.col("s1_id"))).alias("s1_id")
    )
    return t.select("s1_id", "s23_id", F.when((F.col("p1") >= 0.9) & (F.col("p2") < 0.7), 1).when(F.col("p1") < 0.3, 0).alias("label"))


@q(f"WITH {SP}, {PE} SELECT sp.s1_id, sp.s23_id, sp.p FROM sp JOIN pe ON pe.entity_id = sp.s1_id WHERE p >= CASE WHEN pe.num <= 10 THEN 0.6 ELSE 0.75 END")
def m30_cell_threshold(spark: SparkSession, sf: str) -> DataFrame:
    cells = parts_entities(spark, sf).select(F.col("entity_id").alias("s1_id"), F.when(F.col("num") <= 10, 0.6).otherwise(0.75).alias("th"))
    return scored_pairs(spark, sf).join(cells, "s1_id").where(F.col("p") >= F.col("th")).select("s1_id", "s23_id", "p")


def variants(spark: SparkSession, sf: str) -> list[tuple[str, DataFrame]]:
    a, t = assigned(spark, sf).select("s1_id", "s23_id"), truth_pairs(spark, sf).select("s1_id", "s23_id")
    cand = scored_pairs(spark, sf).select("s1_id", "s23_id")
    return [("as_is", a), ("no_fp", a.join(t, ["s1_id", "s23_id"], "left_semi")), ("all_true", a.unionByName(t).distinct()), ("perfect", cand.join(t, ["s1_id", "s23_id"], "left_semi"))]


@q(f"WITH {SP}, {TP}, {S1}, {ASSIGNED}, nf AS (SELECT asg.s1_id, asg.s23_id FROM asg JOIN tp ON tp.s1_id = asg.s1_id AND tp.s23_id = asg.s23_id), al AS (SELECT s1_id, s23_id FROM asg UNION SELECT s1_id, s23_id FROM tp), pf AS (SELECT sp.s1_id, sp.s23_id FROM sp JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id) " + " UNION ALL ".join(f"SELECT '{n}' AS variant, * FROM ({fsql(t)})" for n, t in (("as_is", "asg"), ("no_fp", "nf"), ("all_true", "al"), ("perfect", "pf"))))
def e4_oracle_variants(spark: SparkSession, sf: str) -> DataFrame:
    out = [measured(spark, sf, pred).withColumn("variant", F.lit(name)) for name, pred in variants(spark, sf)]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


BAND = "CASE WHEN p < 0.8 THEN 'a' WHEN p < 0.9 THEN 'b' ELSE 'c' END"


@q(f"WITH {SP}, {TP}, {ASSIGNED} SELECT {BAND} AS band, count(*) AS n, count(tp.s1_id) AS hits, round(count(tp.s1_id) / CAST(count(*) AS DOUBLE), 6) AS precision FROM asg LEFT JOIN tp ON tp.s1_id = asg.s1_id AND tp.s23_id = asg.s23_id GROUP BY 1")
def e5_band_oracle(spark: SparkSession, sf: str) -> DataFrame:
    band = F.when(F.col("p") < 0.8, "a").when(F.col("p") < 0.9, "b").otherwise("c").alias("band")
    hit = truth_pairs(spark, sf).withColumn("hit", F.lit(1))
    n = assigned(spark, sf).join(hit, ["s1_id", "s23_id"], "left").groupBy(band).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return n.withColumn("precision", F.round(F.col("hits") / F.col("n"), 6))


F_SQL = "CASE WHEN n_pred = 0 AND n_true = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / n_pred) * (tp / n_true) / (0.25 * (tp / n_pred) + tp / n_true) END"


@q(f"""WITH {SP}, {TP}, {S1}, {ASSIGNED}, best AS (SELECT s23_id, max(p) AS top FROM sp GROUP BY 1),
  miss AS MATERIALIZED (SELECT tp.s1_id, tp.s23_id, CASE WHEN sp.p IS NULL THEN 'fn_no_candidate' WHEN sp.p < {TH.replace("country", "sp.country")} THEN 'fn_below' WHEN sp.p < best.top THEN 'fn_outranked' ELSE 'fn_tied' END AS kind FROM tp LEFT JOIN asg ON asg.s1_id = tp.s1_id AND asg.s23_id = tp.s23_id
    LEFT JOIN sp ON sp.s1_id = tp.s1_id AND sp.s23_id = tp.s23_id LEFT JOIN best ON best.s23_id = tp.s23_id WHERE asg.s1_id IS NULL),
  wrong AS MATERIALIZED (SELECT asg.s1_id, asg.s23_id, CASE WHEN t2.s23_id IS NULL THEN 'fp_orphan' ELSE 'fp_wrong' END AS kind FROM asg LEFT JOIN tp ON tp.s1_id = asg.s1_id AND tp.s23_id = asg.s23_id LEFT JOIN tp t2 ON t2.s23_id = asg.s23_id WHERE tp.s1_id IS NULL),
  ks AS (SELECT kind, count(*) AS n FROM (SELECT kind FROM miss UNION ALL SELECT kind FROM wrong) GROUP BY 1 UNION ALL SELECT 'all', (SELECT count(*) FROM miss) + (SELECT count(*) FROM wrong)),
  fixed AS (SELECT kind, s1_id, s23_id FROM miss UNION ALL SELECT 'all', s1_id, s23_id FROM miss),
  gone AS (SELECT fixed.kind, asg.s1_id, asg.s23_id FROM fixed JOIN asg ON asg.s23_id = fixed.s23_id UNION SELECT kind, s1_id, s23_id FROM wrong UNION SELECT 'all', s1_id, s23_id FROM wrong),
  pk AS (SELECT k.kind, asg.s1_id, asg.s23_id FROM asg, (SELECT kind FROM ks UNION ALL SELECT 'base') k WHERE (k.kind, asg.s1_id, asg.s23_id) NOT IN (SELECT kind, s1_id, s23_id FROM gone) UNION ALL SELECT kind, s1_id, s23_id FROM fixed),
  cn AS (SELECT pk.kind, pk.s1_id, CAST(count(*) AS DOUBLE) AS n_pred, CAST(count(tp.s1_id) AS DOUBLE) AS tp FROM pk LEFT JOIN tp ON tp.s1_id = pk.s1_id AND tp.s23_id = pk.s23_id GROUP BY 1, 2), nt AS (SELECT s1_id, CAST(count(*) AS DOUBLE) AS n FROM tp GROUP BY 1),
  fk AS (SELECT kind, avg({F_SQL}) AS f FROM (SELECT k.kind, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp, coalesce(nt.n, 0) AS n_true FROM (SELECT kind FROM ks UNION ALL SELECT 'base') k CROSS JOIN s1 LEFT JOIN cn ON cn.kind = k.kind AND cn.s1_id = s1.s1_id LEFT JOIN nt ON nt.s1_id = s1.s1_id) GROUP BY 1)
  SELECT ks.kind, ks.n, round(f - (SELECT f FROM fk WHERE kind = 'base'), 6) AS gain FROM ks JOIN fk ON fk.kind = ks.kind""")
def e6_loss_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    """Missed and wrong pairs by kind, and how much the mean F0.5 would rise if one kind, or all of them, were mended.

    Mending a missed pair also takes its query from the record that has it. Only the counts of records that a kind touches change, so
    a kind's gain is the sum of their differences; no prediction is made anew.
    """
    sp, tp, a = scored_pairs(spark, sf), truth_pairs(spark, sf), assigned(spark, sf).select("s1_id", "s23_id")
    top = sp.groupBy("s23_id").agg(F.max("p").alias("top"))
    missed = tp.join(a, ["s1_id", "s23_id"], "left_anti").join(sp, ["s1_id", "s23_id"], "left").join(top, "s23_id", "left")
    fn = F.when(F.col("p").isNull(), "fn_no_candidate").when(F.col("p") < threshold(), "fn_below").when(F.col("p") < F.col("top"), "fn_outranked").otherwise("fn_tied")
    missed = missed.select("s1_id", "s23_id", fn.alias("kind"))
    wrong = a.join(tp, ["s1_id", "s23_id"], "left_anti").join(tp.select("s23_id", F.lit(True).alias("has")), "s23_id", "left")
    wrong = wrong.select("s1_id", "s23_id", F.when(F.col("has").isNull(), "fp_orphan").otherwise("fp_wrong").alias("kind"))
    moves = lambda df, hit, pred, n: df.select("s1_id", "kind", F.lit(hit).alias("hit"), F.lit(pred).alias("pred"), F.lit(n).alias("n"))
    taken = a.join(missed.select("s23_id", "kind"), "s23_id")  # where the query of a missed pair is now
    each = moves(missed, 1, 1, 1).unionByName(moves(taken, 0, -1, 0)).unionByName(moves(wrong, 0, -1, 1)).groupBy("s1_id", "kind").agg(F.sum("hit").alias("hit"), F.sum("pred").alias("pred"), F.sum("n").alias("n"))
    counts = metrics.record_counts(s1_ids(spark, sf), a, tp)
    f = lambda hits, preds: metrics.f05(hits, preds, F.col("n_true"))
    rise = f(F.col("tp") + F.col("hit"), F.col("n_pred") + F.col("pred")) - f(F.col("tp"), F.col("n_pred"))
    gains = each.join(counts, "s1_id").groupBy("kind").agg(F.sum("n").alias("n"), F.sum(rise).alias("rise"))
    whole = counts.agg(F.count(F.lit(1)).alias("ids"), F.sum(1 - f(F.col("tp"), F.col("n_pred"))).alias("rise"))
    total = whole.crossJoin(gains.agg(F.sum("n").alias("n"))).select(F.lit("all").alias("kind"), F.coalesce("n", F.lit(0)).alias("n"), "rise")  # a row and a row
    return gains.unionByName(total).crossJoin(F.broadcast(whole.select("ids"))).select("kind", "n", F.round(F.col("rise") / F.col("ids"), 6).alias("gain"))


@q(f"WITH {SP}, {TP} SELECT CAST(floor(p * 10) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CAST(tp.s1_id IS NOT NULL AS DOUBLE)), 6) AS rate FROM sp LEFT JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id GROUP BY 1")
def e7_calibration(spark: SparkSession, sf: str) -> DataFrame:
    labelled = scored_pairs(spark, sf).join(truth_pairs(spark, sf).withColumn("hit", F.lit(1)), ["s1_id", "s23_id"], "left")
    return labelled.groupBy(F.floor(F.col("p") * 10).alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg(F.col("hit").isNotNull().cast("double")), 6).alias("rate"))


@q(f"WITH {SP}, {TP}, {ASSIGNED}, a AS (SELECT country, src, count(*) AS n, count(tp.s1_id) AS hits FROM asg LEFT JOIN tp ON tp.s1_id = asg.s1_id AND tp.s23_id = asg.s23_id WHERE asg.s23_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT country, src, count(*) AS total, count(*) FILTER (WHERE p >= 0.9) AS sure FROM sp WHERE s23_id % 2 = 1 GROUP BY 1, 2) SELECT coalesce(a.country, b.country) AS country, coalesce(a.src, b.src) AS src, n, hits, total, sure, round(sure / CAST(total AS DOUBLE), 6) AS acceptance FROM a FULL JOIN b ON a.country = b.country AND a.src = b.src WHERE coalesce(total, 0) >= 10")
def e9_cell_audit(spark: SparkSession, sf: str) -> DataFrame:
    hit = truth_pairs(spark, sf).withColumn("hit", F.lit(1))
    a = assigned(spark, sf).where("s23_id % 2 = 0").join(hit, ["s1_id", "s23_id"], "left").groupBy("country", "src").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    b = scored_pairs(spark, sf).where("s23_id % 2 = 1").groupBy("country", "src").agg(F.count("*").alias("total"), F.count_if(F.col("p") >= 0.9).alias("sure"))
    return a.join(b, ["country", "src"], "full_outer").where(F.coalesce("total", F.lit(0)) >= 10).withColumn("acceptance", F.round(F.col("sure") / F.col("total"), 6))


@q(f"WITH {SP}, {TP}, h AS (SELECT sp.*, tp.s1_id IS NOT NULL AS hit, ('0x' || substr(md5(CAST(sp.s23_id AS VARCHAR)), 1, 8))::BIGINT % 2 AS half FROM sp LEFT JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id), pick AS (SELECT country, src FROM h WHERE half = 0 GROUP BY 1, 2 HAVING avg(CAST(hit AS DOUBLE)) > (SELECT avg(CAST(hit AS DOUBLE)) FROM h WHERE half = 0)) SELECT country, src, count(*) AS n, round(avg(CAST(hit AS DOUBLE)), 6) AS rate FROM h WHERE half = 1 AND (country, src) IN (SELECT country, src FROM pick) GROUP BY 1, 2")
def e10_split_half(spark: SparkSession, sf: str) -> DataFrame:
    """Cells chosen on one half of the queries, measured on the other."""
    h = scored_pairs(spark, sf).join(truth_pairs(spark, sf).withColumn("hit", F.lit(1)), ["s1_id", "s23_id"], "left").withColumns({"y": F.col("hit").isNotNull().cast("double"), "half": decide.md5_mod(F.col("s23_id"), 2)})
    first = h.where("half = 0").groupingSets([["country", "src"], []], "country", "src").agg(F.avg("y").alias("rate"))
    base = first.where("src IS NULL").select(F.col("rate").alias("base"))
    pick = first.where("src IS NOT NULL").crossJoin(F.broadcast(base)).where("rate > base").select("country", "src")
    return h.where("half = 1").join(pick, ["country", "src"], "left_semi").groupBy("country", "src").agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("rate"))


@q(f"WITH {SP}, {TP}, c AS (SELECT src, count(*) AS n, count(tp.s1_id) AS hits, count(DISTINCT sp.s1_id) AS records FROM sp LEFT JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id WHERE p >= 0.9 GROUP BY 1) SELECT src, n, hits, round((hits - 0.5 * (n - hits)) / records, 6) AS gain FROM c")
def e11_channel_gain(spark: SparkSession, sf: str) -> DataFrame:
    c = scored_pairs(spark, sf).where("p >= 0.9").join(truth_pairs(spark, sf).withColumn("hit", F.lit(1)), ["s1_id", "s23_id"], "left").groupBy("src").agg(F.count("*").alias("n"), F.count("hit").alias("hits"), F.countDistinct("s1_id").alias("records"))
    return c.select("src", "n", "hits", F.round((F.col("hits") - 0.5 * (F.col("n") - F.col("hits"))) / F.col("records"), 6).cast("double").alias("gain"))


#: How often queries without truth come, and the buckets of records of which one is left out.
TIMES, LEFT_OUT = [1, 2, 3], 10


@q(f"""WITH {SP}, {TP}, {S1}, ik AS (SELECT s1_id * 4 + k AS s1_id, k FROM s1, (SELECT unnest(range(4)) AS k) WHERE k > 0 OR ('0x' || substr(md5(CAST(s1_id AS VARCHAR)), 1, 8))::BIGINT % {LEFT_OUT} <> 0),
  x AS (SELECT sp.*, k, r FROM sp, (SELECT unnest(range(4)) AS k) a, (SELECT unnest(range(3)) AS r) b WHERE p >= 0.9 AND (r = 0 OR r < k AND NOT EXISTS (SELECT 1 FROM tp WHERE tp.s23_id = sp.s23_id))), pr AS (SELECT s1_id * 4 + k AS s1_id, s23_id * 4 + r AS s23_id FROM x),
  tr AS (SELECT s1_id * 4 + k AS s1_id, s23_id * 4 AS s23_id FROM tp, (SELECT unnest(range(4)) AS k)) SELECT * REPLACE (CAST(k AS INTEGER) AS k) FROM ({fsql("(SELECT p.* FROM pr p SEMI JOIN ik ON ik.s1_id = p.s1_id)", "(SELECT t.* FROM tr t SEMI JOIN ik ON ik.s1_id = t.s1_id)", "k", "ik")})""")
def e14_density_sim(spark: SparkSession, sf: str) -> DataFrame:
    """The score when queries without truth come once, twice and three times (k), and when a tenth of the records is missing, so that their queries have no truth (k = 0)."""
    sp, tp, ids = scored_pairs(spark, sf).where("p >= 0.9").select("s1_id", "s23_id"), truth_pairs(spark, sf), s1_ids(spark, sf)
    decoy = sp.join(tp.select("s23_id", F.lit(True).alias("has")), "s23_id", "left")
    points = decoy.withColumn("k", F.explode(F.array(*map(F.lit, TIMES)))).withColumn("r", F.explode(F.sequence(F.lit(0), F.when(F.col("has"), 0).otherwise(F.col("k") - 1))))
    pred = points.select("s1_id", (F.col("s23_id") * 4 + F.col("r")).alias("s23_id"), "k")
    dense = metrics.macro_f05(metrics.record_counts(ids, pred, tp.select("s1_id", (F.col("s23_id") * 4).alias("s23_id")), grid=("k", TIMES)), ["k"])
    kept = decide.md5_mod(F.col("s1_id"), LEFT_OUT) != 0
    fewer = metrics.macro_f05(metrics.record_counts(ids.where(kept), sp.where(kept), tp.where(kept)))
    return dense.unionByName(fewer.withColumn("k", F.lit(0)))


@q(f"WITH {SP}, {TP}, g AS (SELECT s23_id, least(count(*), 5) AS size, arg_max(s1_id, struct_pack(p := p, k := -s1_id)) AS top FROM sp GROUP BY 1) SELECT size, count(*) AS n, round(avg(CAST(tp.s1_id = g.top AS DOUBLE)), 6) AS acc FROM g JOIN tp ON tp.s23_id = g.s23_id GROUP BY 1")
def e15_tiebreak_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    g = scored_pairs(spark, sf).groupBy("s23_id").agg(F.least(F.count("*"), F.lit(5).cast("long")).alias("size"), F.max_by("s1_id", F.struct("p", -F.col("s1_id"))).alias("top"))
    return g.join(truth_pairs(spark, sf), "s23_id").groupBy("size").agg(F.count("*").alias("n"), F.round(F.avg((F.col("s1_id") == F.col("top")).cast("double")), 6).alias("acc"))


@q(f"WITH {SP}, {TP}, l AS (SELECT p, CAST(tp.s1_id IS NOT NULL AS INTEGER) AS y FROM sp LEFT JOIN tp ON tp.s1_id = sp.s1_id AND tp.s23_id = sp.s23_id), r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS rk FROM l) SELECT round((sum(CASE WHEN y = 1 THEN rk END) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0) / (CAST(count(*) FILTER (WHERE y = 1) AS DOUBLE) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r")
def e17_auc(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auc(m7_label_join(spark, sf).join(scored_pairs(spark, sf).select("s1_id", "s23_id", "p"), ["s1_id", "s23_id"]), "p", "label")


@q(f"WITH {SP}, {ASSIGNED}, b AS (SELECT s1_id, s23_id, country FROM asg WHERE p >= 0.85 UNION ALL SELECT s1_id, s23_id, country FROM sp WHERE p BETWEEN 0.7 AND 0.72) SELECT coalesce(a.country, b.country) AS country, count(*) FILTER (WHERE b.s1_id IS NULL) AS only_old, count(*) FILTER (WHERE a.s1_id IS NULL) AS only_new FROM asg a FULL JOIN b ON a.s1_id = b.s1_id AND a.s23_id = b.s23_id GROUP BY 1")
def e18_version_diff(spark: SparkSession, sf: str) -> DataFrame:
    key = ["s1_id", "s23_id", "country"]
    old = assigned(spark, sf)
    new = old.where("p >= 0.85").select(*key).unionByName(scored_pairs(spark, sf).where("p BETWEEN 0.7 AND 0.72").select(*key))
    both = old.select(*key, F.lit(1).alias("o")).join(new.select(*key, F.lit(1).alias("n")), key, "full_outer")
    return both.groupBy("country").agg(F.count_if(F.col("n").isNull()).alias("only_old"), F.count_if(F.col("o").isNull()).alias("only_new"))


@q(f"WITH {SP}, {ASSIGNED} SELECT s23_id, count(*) AS n FROM asg GROUP BY 1 HAVING count(*) > 1")
def o1_query_unique(spark: SparkSession, sf: str) -> DataFrame:
    return assigned(spark, sf).groupBy("s23_id").agg(F.count("*").alias("n")).where("n > 1")


@q(f"WITH {SP}, {TP} SELECT s1_id, s23_id FROM tp EXCEPT SELECT s1_id, s23_id FROM sp WHERE p > 0.3")
def o2_subset(spark: SparkSession, sf: str) -> DataFrame:
    """Matches that are no candidates."""
    return truth_pairs(spark, sf).select("s1_id", "s23_id").join(scored_pairs(spark, sf).where("p > 0.3"), ["s1_id", "s23_id"], "left_anti").distinct()


@q(f"WITH {SP}, {TP} SELECT count(*) AS n, count(*) FILTER (WHERE sp.p IS NULL) AS nulls FROM tp LEFT JOIN (SELECT * FROM sp WHERE p > 0.1) sp ON sp.s1_id = tp.s1_id AND sp.s23_id = tp.s23_id")
def o3_null_scores(spark: SparkSession, sf: str) -> DataFrame:
    j = truth_pairs(spark, sf).join(scored_pairs(spark, sf).where("p > 0.1"), ["s1_id", "s23_id"], "left")
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("nulls"))


@q(f"WITH {S1}, {SP} SELECT s1.s1_id, count(sp.s23_id) AS n FROM s1 LEFT JOIN sp ON sp.s1_id = s1.s1_id AND p >= 0.9 GROUP BY 1")
def o4_row_for_each(spark: SparkSession, sf: str) -> DataFrame:
    n = scored_pairs(spark, sf).where("p >= 0.9").groupBy("s1_id").agg(F.count("*").alias("n"))
    return s1_ids(spark, sf).join(n, "s1_id", "left").na.fill(0, ["n"])
