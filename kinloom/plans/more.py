"""Further retrieval views, token roles, profiles and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.fixtures import PE, SP, TP, parts_entities, scored_pairs, table, truth_pairs
from kinloom.functions import arrays
from kinloom.operators import blocking, decide, metrics, windows
from kinloom.plans.retrieval import TOKENS, tfidf_sql, token_diffs
from kinloom.registry import REGISTRY
from kinloom.session import shared_dir

q = REGISTRY.query


WORDS = "va AS (SELECT entity_id AS id, country AS part, side = 1 AS fit, string_split(name_core, ' ') AS terms FROM pe)"


@q()
def b18_minhash_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Approximate neighbours among part names by MinHash; every pair returned is within the distance.

    Each different name is hashed once and records are joined back by name. Terms are numbered in their own order, so runs agree.
    """
    from pyspark.ml.feature import CountVectorizerModel, MinHashLSH

    e = parts_entities(spark, sf).select("entity_id", "side", "name_core")
    names = e.select("name_core").distinct().withColumn("grams", arrays.char_ngrams(F.col("name_core"), 3))
    terms = [r[0] for r in names.select(F.explode("grams").alias("g")).distinct().orderBy("g").collect()]
    vectors = CountVectorizerModel.from_vocabulary(terms, inputCol="grams", outputCol="v").setBinary(True).transform(names)
    model = MinHashLSH(inputCol="v", outputCol="h", numHashTables=4, seed=7).fit(vectors)
    close = model.approxSimilarityJoin(vectors, vectors, 0.5, "d").select(F.col("datasetA.name_core").alias("nq"), F.col("datasetB.name_core").alias("n1"), F.round("d", 6).alias("distance"))
    # few pairs of names, many of records: these follow from arrays of ids, and no pair is shuffled
    side = lambda where, n, ids: blocking.held(e.where(where).withColumnRenamed("name_core", n), [n], "entity_id", F.col("entity_id"), ids)
    met = blocking.class_pairs(close.join(side("side > 1", "nq", "q_ids"), "nq"), side("side = 1", "n1", "s1_ids"), ["n1"], "q_ids")
    # transform is not compiled, so queries come one by one; compiled as one, both explodes would hold all pairs of two arrays at once
    each = met.select(F.explode(F.transform("q_ids", lambda i: i)).alias("q_id"), "s1_ids", "distance")
    return each.select("q_id", F.explode("s1_ids").alias("s1_id"), "distance")


@q(f"WITH {TOKENS}, i AS (SELECT country, tok, count(*) AS n_in, avg(CAST(same AS DOUBLE)) AS in_same FROM dt WHERE side = 'xq' GROUP BY 1, 2), o AS (SELECT country, tok, count(*) AS n_out, avg(CAST(same AS DOUBLE)) AS out_same FROM dt WHERE side = 'x1' GROUP BY 1, 2) SELECT coalesce(i.country, o.country) AS country, coalesce(i.tok, o.tok) AS tok, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, round((coalesce(n_in, 0) + 1) / CAST(coalesce(n_out, 0) + 1 AS DOUBLE), 6) AS in_out, round(in_same, 6) AS in_same, round(out_same, 6) AS out_same FROM i FULL JOIN o ON i.country = o.country AND i.tok = o.tok")
def p19_token_roles(spark: SparkSession, sf: str) -> DataFrame:
    """How often a word comes in and goes out; both roles from one aggregate instead of a full join."""
    side = lambda s: F.when(F.col("side") == s, F.col("same").cast("double"))
    g = token_diffs(spark, sf).groupBy("country", "tok").agg(F.count(side("xq")).alias("n_in"), F.count(side("x1")).alias("n_out"), F.round(F.avg(side("xq")), 6).alias("in_same"), F.round(F.avg(side("x1")), 6).alias("out_same"))
    return g.withColumn("in_out", F.round((F.col("n_in") + 1) / (F.col("n_out") + 1), 6))


@q(f"WITH {SP} SELECT s1_id, s23_id, round(p - max(p) OVER w, 6) AS gap, count(*) OVER w AS n_c, count(*) FILTER (WHERE p >= 0.9) OVER w AS n_high, CAST(country = 'India' AS INTEGER) AS is_in FROM sp WINDOW w AS (PARTITION BY s23_id)")
def p16_p17_rescue_context(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s23_id")
    return scored_pairs(spark, sf).select("s1_id", "s23_id", F.round(windows.gap_to_best("s23_id", "p"), 6).alias("gap"), F.count("*").over(w).alias("n_c"), F.count_if(F.col("p") >= 0.9).over(w).alias("n_high"), (F.col("country") == "India").cast("int").alias("is_in"))


@q(f"WITH {SP}, {TP} SELECT l.s1_id, l.s23_id, l.p AS p_left, r.p AS p_right, r.src AS src_right FROM sp l JOIN sp r ON l.s23_id = r.s23_id AND l.s1_id + 1 = r.s1_id")
def j9_j10_suffixes(spark: SparkSession, sf: str) -> DataFrame:
    """A self-join whose columns are told apart by name, and a key join where frames would be zipped."""
    sp = scored_pairs(spark, sf)
    left = sp.select("s1_id", "s23_id", F.col("p").alias("p_left"))
    return left.join(sp.select((F.col("s1_id") - 1).alias("s1_id"), "s23_id", F.col("p").alias("p_right"), F.col("src").alias("src_right")), ["s1_id", "s23_id"])


@q(f"WITH {PE} SELECT entity_id, len(list_filter(string_split(name_core, ' '), lambda t: length(t) > 5))::BIGINT AS long_words, string_split(name_core, ' ')[1] AS first, string_split(name_core, ' ')[-1] AS last, array_to_string(list_transform(string_split(name_core, ' '), lambda t: upper(t)), '-') AS upper_words FROM pe")
def l1_l13_list_ops(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("name_core", " ")
    return parts_entities(spark, sf).select("entity_id", F.size(F.filter(w, lambda t: F.length(t) > 5)).cast("long").alias("long_words"), F.get(w, F.lit(0)).alias("first"), F.element_at(w, -1).alias("last"), F.array_join(F.transform(w, lambda t: F.upper(t)), "-").alias("upper_words"))


@q(f"WITH {SP} SELECT CAST(floor(p * 20) AS BIGINT) AS bin, count(*) AS n, sum(count(*)) OVER (ORDER BY CAST(floor(p * 20) AS BIGINT))::BIGINT AS below FROM sp GROUP BY 1")
def a16_bincount(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by bin and their running sum; the window runs over the few bins only."""
    n = scored_pairs(spark, sf).groupBy(F.floor(F.col("p") * 20).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("below", F.sum("n").over(Window.orderBy("bin")))


@q(f"WITH {TP}, {SP} SELECT tp.s1_id, count(*) AS n_true, count(sp.p) AS covered FROM tp LEFT JOIN sp ON sp.s1_id = tp.s1_id AND sp.s23_id = tp.s23_id GROUP BY 1 HAVING count(*) >= 3")
def io5_pairs_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Truth through id lists and back, then checked against candidates."""
    from kinloom.sources.tables import explode_ids, id_lists

    t = truth_pairs(spark, sf)
    back = explode_ids(id_lists(t.select("s1_id").distinct(), t, "s1_id", "s23_id", "ids"), "s1_id", "ids", "m").select("s1_id", F.col("m").cast("long").alias("s23_id"))
    return back.join(scored_pairs(spark, sf).select("s1_id", "s23_id", "p"), ["s1_id", "s23_id"], "left").groupBy("s1_id").agg(F.count("*").alias("n_true"), F.count("p").alias("covered")).where("n_true >= 3")


@q(f"WITH {SP}, {TP} SELECT sp.s1_id, sp.s23_id, p FROM sp JOIN (SELECT DISTINCT s1_id FROM tp WHERE s23_id % 50 = 0) x ON x.s1_id = sp.s1_id")
def io7_semi_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Only the rows whose ids another table names."""
    return scored_pairs(spark, sf).join(truth_pairs(spark, sf).where("s23_id % 50 = 0").select("s1_id"), "s1_id", "left_semi").select("s1_id", "s23_id", "p")


@q("SELECT vec_id, CAST(label AS INTEGER) AS label, CAST(len(embedding) AS BIGINT) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm FROM embeddings")
def io12_vector_store(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors written to a store in the shared folder and read back from it, with their lengths."""
    from kinloom.sources.tables import write_vectors

    path, rows = f"{shared_dir(spark)}/kinloom/vectors-{uuid.uuid4().hex[:12]}", table(spark, sf, "embeddings")
    write_vectors(rows, path, "vec_id", "embedding")
    v = F.transform("embedding", lambda x: x.cast("double"))
    stored = spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("dim"), F.round(F.sqrt(F.aggregate(v, F.lit(0.0).cast("double"), lambda s, x: s + x * x)), 4).alias("norm"))
    return stored.join(rows.select("vec_id", F.col("label").cast("int").alias("label")), "vec_id")


@q(f"WITH {PE} SELECT CAST(entity_id AS VARCHAR) AS entity_id, name_core AS business_name, CASE WHEN num > 25 THEN '' ELSE addr END AS business_address, country FROM pe")
def io1_tsv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Records through an unquoted TSV file in the shared folder and back; empty fields stay empty strings."""
    from kinloom.sources.tables import read_tsv, write_tsv

    path = f"{shared_dir(spark)}/kinloom/tsv-{uuid.uuid4().hex[:12]}"
    addr = F.when(F.col("num") > 25, "").otherwise(F.col("addr"))
    write_tsv(parts_entities(spark, sf).select(F.col("entity_id").cast("string").alias("entity_id"), F.col("name_core").alias("business_name"), addr.alias("business_address"), "country"), path)
    return read_tsv(spark, path)


@q("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 45 AND l_returnflag = 'R'")
def io6_pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns of a wide table; the filters reach the scan."""
    return table(spark, sf, "lineitem").where("l_quantity >= 45 AND l_returnflag = 'R'").select("l_orderkey", "l_partkey")


SIDE_COUNTS = {"name_n": ["name_core"], "state_n": ["state"], "name_state_n": ["name_core", "state"], "addr_n": ["addr"]}


@q(f"""WITH {PE}, c AS (SELECT entity_id, CASE side WHEN 1 THEN 's1' ELSE 'q' || CAST(side AS VARCHAR) END AS src, side = 1 AS ref, country, name_core, state, addr, num FROM pe)
  SELECT entity_id, src, length(name_core)::BIGINT AS name_len, len(string_split(name_core, ' '))::BIGINT AS name_words, CAST(num AS VARCHAR) AS nums, {", ".join(f"count(*) OVER (PARTITION BY ref, country, {', '.join(by)}) AS {n}" for n, by in SIDE_COUNTS.items())} FROM c""")
def io8_load_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Both sides with their source, each record's lengths and numbers, and how many records of its side share its name, state, both or address."""
    e = parts_entities(spark, sf)
    derived = ["entity_id", "src", F.length("name_core").cast("long").alias("name_len"), F.size(F.split("name_core", " ")).cast("long").alias("name_words"), F.col("num").cast("string").alias("nums"), "country", "name_core", "state", "addr"]

    def side(rows: DataFrame) -> DataFrame:
        return rows.select(*derived).withColumns({n: F.count(F.lit(1)).over(Window.partitionBy("country", *by)) for n, by in SIDE_COUNTS.items()}).drop("country", "name_core", "state", "addr")

    return side(e.where("side > 1").withColumn("src", F.concat(F.lit("q"), F.col("side").cast("string")))).unionByName(side(e.where("side = 1").withColumn("src", F.lit("s1"))))


@q(f"WITH {SP} SELECT s1_id, string_agg(CAST(s23_id AS VARCHAR), ',' ORDER BY s23_id) AS members FROM sp WHERE p >= 0.8 GROUP BY 1")
def a6_string_join(spark: SparkSession, sf: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("s23_id")), lambda x: x.cast("string"))
    return scored_pairs(spark, sf).where("p >= 0.8").groupBy("s1_id").agg(F.array_join(ids, ",").alias("members"))


@q(f"WITH {SP} SELECT s1_id, s23_id, p FROM sp ORDER BY p DESC, s1_id, s23_id LIMIT 100 OFFSET 50")
def s2_slice(spark: SparkSession, sf: str) -> DataFrame:
    return scored_pairs(spark, sf).orderBy(F.col("p").desc(), "s1_id", "s23_id").offset(50).limit(100).select("s1_id", "s23_id", "p")


@q(f"WITH {SP} SELECT country, count(*) AS n, CASE country WHEN 'India' THEN 0.8 ELSE 0.75 END::DOUBLE AS th, count(*) FILTER (WHERE p >= CASE country WHEN 'India' THEN 0.8 ELSE 0.75 END) AS accepted FROM sp GROUP BY 1")
def m13_country_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    th = decide.by_country(F.col("country"), decide.THRESHOLDS, decide.DEFAULT_THRESHOLD)
    return scored_pairs(spark, sf).groupBy("country").agg(F.count("*").alias("n"), F.max(th).alias("th"), F.count_if(F.col("p") >= th).alias("accepted"))


@q("SELECT CAST(tp AS BIGINT) AS tp, CAST(np AS BIGINT) AS np, CAST(nt AS BIGINT) AS nt, round(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * (tp / CAST(np AS DOUBLE)) * (tp / CAST(nt AS DOUBLE)) / (0.25 * (tp / CAST(np AS DOUBLE)) + tp / CAST(nt AS DOUBLE)) END, 6)::DOUBLE AS f FROM (SELECT unnest(range(5)) AS tp) a, (SELECT unnest(range(5)) AS np) b, (SELECT unnest(range(5)) AS nt) c WHERE tp <= np AND tp <= nt")
def e2_scalar_f05(spark: SparkSession, sf: str) -> DataFrame:
    five = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    grid = spark.range(1).select(five.alias("tp")).withColumn("np", five).withColumn("nt", five).where("tp <= np AND tp <= nt")
    return grid.withColumn("f", F.round(metrics.f05(F.col("tp"), F.col("np"), F.col("nt")), 6))


@q(f"WITH {PE}, {WORDS}, {tfidf_sql('va', 1, 1.0)} SELECT q_id, s1_id, rank FROM rk WHERE rank < 3")
def b3_b4_ranked_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """0-based ranks of word retrieval for all countries at once."""
    e = parts_entities(spark, sf).select(F.col("entity_id").alias("id"), F.col("country").alias("part"), (F.col("side") == 1).alias("is_ref"), "name_core")
    weights = blocking.text_weights(e, "name_core", lambda c: F.split(c, " "), 1, 1.0)
    return blocking.of_queries(e, "name_core", blocking.text_top_k(e, "name_core", weights, 3, 0.01)).select("q_id", "s1_id", "rank")
