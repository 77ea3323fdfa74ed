"""Blocking and pair features on documents, parts and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.fixtures import PE, SP, parts_entities, scored_pairs, table
from kinloom.functions import arrays
from kinloom.operators import blocking, windows
from kinloom.plans.texts import PAIRS, entity_pairs
from kinloom.registry import REGISTRY

q = REGISTRY.query
DE = "de AS (SELECT doc_id AS id, lang AS part, doc_id % 3 = 0 AS fit, regexp_extract_all(lower(text), '[a-z]+') AS terms FROM documents)"


def doc_entities(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("part"), (F.col("doc_id") % 3 == 0).alias("is_ref"), terms.alias("terms"))


def tfidf_sql(view: str, least: int = 2, share: float = 0.02) -> str:
    """SQL of the weights over view (id, part, fit, terms)."""
    return f"""tf AS (SELECT part, id, fit, term, count(*) AS tf FROM (SELECT part, id, fit, unnest(terms) AS term FROM {view}) GROUP BY 1, 2, 3, 4), nn AS (SELECT part, count(*) AS n FROM {view} WHERE fit GROUP BY 1),
      df AS (SELECT tf.part, term, count(*) AS df, any_value(n) AS n FROM tf JOIN nn ON nn.part = tf.part WHERE fit GROUP BY 1, 2 HAVING count(*) >= {least} AND count(*) <= greatest({least}, {share} * any_value(n))),
      rw AS (SELECT tf.part, id, fit, tf.term, (1 + ln(tf)) * (ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1) AS raw FROM tf JOIN df ON df.part = tf.part AND df.term = tf.term),
      wt AS (SELECT part, id, fit, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY part, id)) AS w FROM rw),
      sims AS (SELECT a.id AS q_id, b.id AS s1_id, round(sum(a.w * b.w), 6) AS sim FROM wt a JOIN wt b ON a.part = b.part AND a.term = b.term WHERE NOT a.fit AND b.fit GROUP BY 1, 2),
      rk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, s1_id) - 1 AS rank FROM sims WHERE sim > 0.01)"""


def doc_weights(spark: SparkSession, sf: str) -> DataFrame:
    return blocking.tfidf(doc_entities(spark, sf), F.col("is_ref"), "part", "id", "terms")


@q(f"WITH {DE}, {tfidf_sql('de')} SELECT part, id, term, round(w, 6) AS w FROM wt")
def b1_tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    return doc_weights(spark, sf).select("part", "id", "term", F.round("w", 6).alias("w"))


@q(f"WITH {DE}, {tfidf_sql('de')} SELECT q_id, s1_id, sim, rank FROM rk WHERE rank < 5")
def b2_tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """B2 to B4: all languages in one plan; the language is part of the join key."""
    return blocking.sparse_top_k(doc_weights(spark, sf), "part", "id", 5, 0.01)


def grams_sql(col: str, n: int) -> str:
    """SQL of arrays.char_ngrams."""
    return f"flatten(list_transform(list_filter(string_split({col}, ' '), lambda t: t <> ''), lambda w: list_transform(range(1, greatest(length(w) + 3 - {n}, 1) + 1), lambda i: substr(' ' || w || ' ', i, {n}))))"


GRAMS = grams_sql("name_core", 3)


@q(f"WITH {PE}, ge AS (SELECT entity_id AS id, country AS part, side = 1 AS fit, {GRAMS} AS terms FROM pe), {tfidf_sql('ge', 2, 0.5)} SELECT q_id, s1_id, sim, rank FROM rk WHERE rank < 10")
def b8_char3_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = parts_entities(spark, sf).select(F.col("entity_id").alias("id"), F.col("country").alias("part"), (F.col("side") == 1).alias("is_ref"), "name_core")
    weights = blocking.text_weights(e, "name_core", lambda c: arrays.char_ngrams(c, 3), 2, 0.5)
    return blocking.of_queries(e, "name_core", blocking.text_top_k(e, "name_core", weights, 10, 0.01))


VE = "ve AS (SELECT vec_id, CAST(label AS INTEGER) AS label, vec_id % 3 = 0 AS fit, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), ds AS (SELECT a.vec_id AS q_id, b.vec_id AS s1_id, round(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 6) AS sim FROM ve a, ve b WHERE NOT a.fit AND b.fit), dk AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, s1_id) - 1 AS rank FROM ds)"


def vector_top(spark: SparkSession, sf: str, k: int) -> DataFrame:
    v = table(spark, sf, "embeddings")
    s = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("s1_id"), F.col("embedding").alias("sv"))
    o = v.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("q_id"), F.col("embedding").alias("qv"))
    return blocking.dense_top_k(o, s, k)


@q(f"WITH {VE} SELECT q_id, s1_id, sim, rank FROM dk WHERE rank < 10")
def b5_vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector_top(spark, sf, 10)


@q(f"WITH {VE}, a AS (SELECT * FROM dk WHERE rank < 3), b AS (SELECT q.vec_id AS q_id, min(s.vec_id) AS s1_id FROM ve q JOIN ve s ON q.label = s.label WHERE NOT q.fit AND s.fit GROUP BY 1) SELECT coalesce(a.q_id, b.q_id) AS q_id, coalesce(a.s1_id, b.s1_id) AS s1_id, sim, rank, CAST(b.q_id IS NOT NULL AS INTEGER) AS by_label FROM a FULL JOIN b ON a.q_id = b.q_id AND a.s1_id = b.s1_id")
def b6_channel_union(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    first = v.where("vec_id % 3 = 0").groupBy("label").agg(F.min("vec_id").alias("s1_id"))
    b = v.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("q_id"), "label").join(first, "label").select("q_id", "s1_id", F.lit(1).alias("l"))
    return blocking.channel_union(vector_top(spark, sf, 3), b, ["q_id", "s1_id"]).select("q_id", "s1_id", "sim", "rank", F.coalesce("l", F.lit(0)).alias("by_label"))


@q(f"WITH {DE}, {tfidf_sql('de')}, p AS (SELECT DISTINCT q_id, s1_id FROM rk WHERE rank < 2) SELECT p.q_id, p.s1_id, round(coalesce(sum(a.w * b.w), 0), 6) AS sim FROM p LEFT JOIN wt a ON a.id = p.q_id LEFT JOIN wt b ON b.id = p.s1_id AND b.term = a.term GROUP BY 1, 2")
def b10_rowdot(spark: SparkSession, sf: str) -> DataFrame:
    """Exact similarity of given pairs."""
    vectors = blocking.doc_vectors(doc_weights(spark, sf), "id")
    return blocking.vector_dots(blocking.vectors_top_k(vectors, "id", 2, 0.01), vectors, "id")


@q(f"WITH {SP}, r AS (SELECT s1_id, s23_id, row_number() OVER (PARTITION BY s23_id ORDER BY p DESC, s1_id) AS a, row_number() OVER (PARTITION BY s23_id ORDER BY s1_id) AS b, row_number() OVER (PARTITION BY s23_id ORDER BY p, s1_id) AS c FROM sp) SELECT s1_id, s23_id FROM r WHERE a <= 2 OR b <= 1 OR c <= 1")
def b11_rank_disjunction(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s23_id")
    r = scored_pairs(spark, sf).withColumns({"a": F.row_number().over(w.orderBy(F.col("p").desc(), "s1_id")), "b": F.row_number().over(w.orderBy("s1_id")), "c": F.row_number().over(w.orderBy("p", "s1_id"))})
    return r.where("a <= 2 OR b <= 1 OR c <= 1").select("s1_id", "s23_id")


@q(f"WITH {PE} SELECT s.entity_id AS s1_id, q.entity_id AS q_id FROM pe s JOIN pe q ON s.country = q.country AND s.name_core = q.name_core AND s.state = q.state WHERE s.side = 1 AND q.side > 1")
def b13_exact_key_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e, key = parts_entities(spark, sf), ["country", "name_core", "state"]
    return e.where("side = 1").select(*key, F.col("entity_id").alias("s1_id")).join(e.where("side > 1").select(*key, F.col("entity_id").alias("q_id")), key).select("s1_id", "q_id")


@q(f"WITH {PE}, a AS (SELECT s.entity_id AS s1_id, q.entity_id AS q_id, s.country FROM pe s JOIN pe q ON s.country = q.country AND s.addr = q.addr WHERE s.side = 1 AND q.side > 1 AND NOT (s.name_core = q.name_core AND s.state = q.state)) SELECT country, count(*) AS n, round(quantile_cont(k, 0.5), 6) AS median_block, round(quantile_cont(k, 0.9), 6) AS block_90, round(quantile_cont(k, 0.99), 6) AS block_99 FROM (SELECT *, count(*) OVER (PARTITION BY s1_id) AS k FROM a) GROUP BY 1")
def b14_address_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs with the same address that are not among the candidates (those of the name key), and how large the blocks are."""
    e = parts_entities(spark, sf)
    s = e.where("side = 1").select("country", "addr", F.col("entity_id").alias("s1_id"))
    a = s.join(e.where("side > 1").select("country", "addr", F.col("entity_id").alias("q_id")), ["country", "addr"]).join(b13_exact_key_candidates(spark, sf), ["s1_id", "q_id"], "left_anti")
    k = a.withColumn("k", F.count("*").over(Window.partitionBy("s1_id")))
    sizes = {"median_block": 0.5, "block_90": 0.9, "block_99": 0.99}
    return k.groupBy("country").agg(F.count("*").alias("n"), *(F.round(F.percentile("k", F.lit(share)), 6).alias(name) for name, share in sizes.items()))


@q(f"WITH {PE}, c AS (SELECT s.entity_id AS s1_id, q.entity_id AS q_id, count(*) OVER (PARTITION BY q.entity_id) AS n FROM pe s JOIN pe q ON s.country = q.country AND s.num = q.num WHERE s.side = 1 AND q.side > 1 AND len(list_intersect(string_split(s.name_core, ' '), string_split(q.name_core, ' '))) / CAST(len(list_distinct(list_concat(string_split(s.name_core, ' '), string_split(q.name_core, ' ')))) AS DOUBLE) >= 0.3) SELECT s1_id, q_id FROM c WHERE n = 1")
def b15_rule_join(spark: SparkSession, sf: str) -> DataFrame:
    e, key = parts_entities(spark, sf), ["country", "num"]
    j = e.where("side = 1").select(*key, F.col("entity_id").alias("s1_id"), F.split("name_core", " ").alias("a")).join(e.where("side > 1").select(*key, F.col("entity_id").alias("q_id"), F.split("name_core", " ").alias("b")), key)
    close = j.where(arrays.jaccard(F.col("a"), F.col("b")) >= 0.3)
    return close.withColumn("n", F.count("*").over(Window.partitionBy("q_id"))).where("n = 1").select("s1_id", "q_id")


@q(f"WITH {PE}, m AS (SELECT q.entity_id AS q_id, q.name_core, q.country, min(s.entity_id) AS s1_id FROM pe s JOIN pe q ON s.country = q.country AND s.name_core = q.name_core AND s.state = q.state WHERE s.side = 1 AND q.side > 1 GROUP BY 1, 2, 3), l AS (SELECT q.entity_id AS q_id, m.s1_id FROM pe q JOIN m ON m.country = q.country AND m.name_core = q.name_core AND m.q_id <> q.entity_id WHERE q.side > 1 AND q.entity_id NOT IN (SELECT q_id FROM m)) SELECT q_id, min(s1_id) AS s1_id FROM l GROUP BY 1 HAVING count(DISTINCT s1_id) = 1")
def b16_transitive(spark: SparkSession, sf: str) -> DataFrame:
    """Queries that share a key with matched queries of one reference record only."""
    e, key = parts_entities(spark, sf), ["country", "name_core", "state"]
    s = e.where("side = 1").groupBy(*key).agg(F.min("entity_id").alias("s1_id"))
    o = e.where("side > 1").select(*key, F.col("entity_id").alias("q_id"))
    m = o.join(s, key).select("q_id", "country", "name_core", "s1_id")
    rest = o.join(m.select("q_id"), "q_id", "left_anti").select("q_id", "country", "name_core")
    return rest.join(m.drop("q_id"), ["country", "name_core"]).groupBy("q_id").agg(F.min("s1_id").alias("s1_id"), F.max("s1_id").alias("most")).where("s1_id = most").drop("most")


@q(f"WITH {VE}, t AS (SELECT q.vec_id AS q_id, min(s.vec_id) AS s1_id FROM ve q JOIN ve s ON q.label = s.label WHERE NOT q.fit AND s.fit GROUP BY 1) SELECT count(*) AS n, round(avg(CAST(coalesce(rank, 999) < 1 AS DOUBLE)), 6) AS recall_1, round(avg(CAST(coalesce(rank, 999) < 5 AS DOUBLE)), 6) AS recall_5, round(avg(CAST(coalesce(rank, 999) < 10 AS DOUBLE)), 6) AS recall_10 FROM t LEFT JOIN (SELECT * FROM dk WHERE rank < 10) c ON c.q_id = t.q_id AND c.s1_id = t.s1_id")
def b17_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "embeddings")
    first = v.where("vec_id % 3 = 0").groupBy("label").agg(F.min("vec_id").alias("s1_id"))
    t = v.where("vec_id % 3 <> 0").select(F.col("vec_id").alias("q_id"), "label").join(first, "label").select("q_id", "s1_id")
    return blocking.recall_at(vector_top(spark, sf, 10), t, ["q_id", "s1_id"], [1, 5, 10])


@q(f"WITH {SP}, c AS (SELECT s1_id, s23_id, CASE WHEN src = 2 THEN p END AS tf, CASE WHEN s1_id % 2 = 0 THEN p END AS emb FROM sp) SELECT s1_id, s23_id, coalesce(tf, 0) AS tf_sim, coalesce(emb, 0) AS emb_sim, CASE WHEN emb IS NULL THEN 99 ELSE row_number() OVER (PARTITION BY s23_id ORDER BY emb DESC NULLS LAST, s1_id) - 1 END AS emb_rank, round(coalesce(emb, 0) - max(coalesce(emb, 0)) OVER (PARTITION BY s23_id), 6) AS emb_gap FROM c")
def p1_blocking_feats(spark: SparkSession, sf: str) -> DataFrame:
    c = scored_pairs(spark, sf).withColumns({"tf": F.when(F.col("src") == 2, F.col("p")), "emb": F.when(F.col("s1_id") % 2 == 0, F.col("p"))})
    c = c.withColumns({"tf_sim": F.coalesce("tf", F.lit(0.0)), "emb_sim": F.coalesce("emb", F.lit(0.0)), "emb_rank": F.coalesce(windows.rank0("s23_id", "emb", "s1_id"), F.lit(99).cast("long"))})
    return c.select("s1_id", "s23_id", "tf_sim", "emb_sim", "emb_rank", F.round(windows.gap_to_best("s23_id", "emb_sim"), 6).alias("emb_gap"))


@q(f"WITH {PE}, a AS (SELECT country, name_core, count(*) AS s1_name_cnt FROM pe WHERE side = 1 GROUP BY 1, 2), b AS (SELECT country, name_core, state, count(*) AS c FROM pe WHERE side = 1 GROUP BY 1, 2, 3) SELECT q.entity_id AS q_id, coalesce(s1_name_cnt, 0) AS s1_name_cnt, coalesce(c, 0) AS s1_name_state_cnt, CAST(s1_name_cnt IS NOT NULL AS INTEGER) AS q_name_in_s1 FROM pe q LEFT JOIN a ON a.country = q.country AND a.name_core = q.name_core LEFT JOIN b ON b.country = q.country AND b.name_core = q.name_core AND b.state = q.state WHERE q.side > 1")
def p6_rarity(spark: SparkSession, sf: str) -> DataFrame:
    e = parts_entities(spark, sf)
    b = e.where("side = 1").groupBy("country", "name_core", "state").agg(F.count("*").alias("c"))
    a = b.groupBy("country", "name_core").agg(F.sum("c").alias("s1_name_cnt"))
    j = e.where("side > 1").join(a, ["country", "name_core"], "left").join(b, ["country", "name_core", "state"], "left")
    return j.select(F.col("entity_id").alias("q_id"), F.coalesce("s1_name_cnt", F.lit(0)).alias("s1_name_cnt"), F.coalesce("c", F.lit(0)).alias("s1_name_state_cnt"), F.col("s1_name_cnt").isNotNull().cast("int").alias("q_name_in_s1"))


TOKENS = f"{PAIRS}, dt AS (SELECT country, 'xq' AS side, unnest(list_distinct(list_filter(string_split(nq, ' '), lambda t: NOT list_contains(string_split(n1, ' '), t)))) AS tok, s1_id, q_id, k1 = kq AS same FROM pr UNION ALL SELECT country, 'x1', unnest(list_distinct(list_filter(string_split(n1, ' '), lambda t: NOT list_contains(string_split(nq, ' '), t)))), s1_id, q_id, k1 = kq FROM pr)"


def token_diffs(spark: SparkSession, sf: str) -> DataFrame:
    """(country, s1_id, q_id, same, side, tok): the words that only the query (xq) or only the record (x1) has, and whether the numbers agree."""
    pairs = entity_pairs(spark, sf).withColumn("same", F.col("k1") == F.col("kq"))
    a, b = F.split("n1", " "), F.split("nq", " ")
    sides = F.array(F.struct(F.lit("xq").alias("side"), F.array_except(b, a).alias("toks")), F.struct(F.lit("x1").alias("side"), F.array_except(a, b).alias("toks")))
    return pairs.select("country", "s1_id", "q_id", "same", F.explode(sides).alias("x")).select("country", "s1_id", "q_id", "same", "x.side", F.explode("x.toks").alias("tok"))


@q(f"WITH {SP}, h AS (SELECT *, CASE WHEN p BETWEEN 0.2 AND 0.8 THEN p END AS ce FROM sp) SELECT s1_id, s23_id, ce, CASE WHEN ce IS NOT NULL THEN row_number() OVER (PARTITION BY s23_id ORDER BY ce DESC NULLS LAST, s1_id) - 1 END AS ce_rank, round(ce - max(ce) OVER (PARTITION BY s23_id), 6) AS ce_gap FROM h")
def p13_null_rank(spark: SparkSession, sf: str) -> DataFrame:
    h = scored_pairs(spark, sf).withColumn("ce", F.when(F.col("p").between(0.2, 0.8), F.col("p")))
    return h.select("s1_id", "s23_id", "ce", windows.rank0("s23_id", "ce", "s1_id").alias("ce_rank"), F.round(windows.gap_to_best("s23_id", "ce"), 6).alias("ce_gap"))


@q(f"WITH {SP}, a AS (SELECT s1_id, s23_id, p AS la FROM sp WHERE s23_id % 3 <> 0), b AS (SELECT s1_id, s23_id, p * p AS lb FROM sp WHERE s23_id % 3 <> 1) SELECT coalesce(a.s1_id, b.s1_id) AS s1_id, coalesce(a.s23_id, b.s23_id) AS s23_id, round(CASE WHEN la IS NOT NULL AND lb IS NOT NULL THEN (la + lb) / 2 ELSE coalesce(la, lb) END, 6) AS ce FROM a FULL JOIN b ON a.s1_id = b.s1_id AND a.s23_id = b.s23_id")
def p14_out_of_fold(spark: SparkSession, sf: str) -> DataFrame:
    """The score of the fold that did not see the query; the mean of both for queries neither saw."""
    sp = scored_pairs(spark, sf)
    a, b = sp.where("s23_id % 3 <> 0").select("s1_id", "s23_id", F.col("p").alias("la")), sp.where("s23_id % 3 <> 1").select("s1_id", "s23_id", (F.col("p") * F.col("p")).alias("lb"))
    both = F.when(F.col("la").isNotNull() & F.col("lb").isNotNull(), (F.col("la") + F.col("lb")) / 2).otherwise(F.coalesce("la", "lb"))
    return a.join(b, ["s1_id", "s23_id"], "full_outer").select("s1_id", "s23_id", F.round(both, 6).alias("ce"))


@q(f"WITH {TOKENS}, g AS (SELECT country, tok, count(*) FILTER (WHERE same) AS eq, count(*) FILTER (WHERE NOT same) AS up FROM dt WHERE side = 'xq' GROUP BY 1, 2), r AS (SELECT country, quantile_cont(eq / CAST(greatest(up, 1) AS DOUBLE), 0.25) AS r FROM g GROUP BY 1) SELECT g.country, tok, round(greatest(least(1 - r * up / greatest(eq, 1), 1), 0), 6) AS share FROM g JOIN r ON r.country = g.country")
def p20_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """The share of true pairs among those that add a word, from how often decoys would keep the number."""
    g = token_diffs(spark, sf).where("side = 'xq'").groupBy("country", "tok").agg(F.count_if("same").alias("eq"), F.count_if(~F.col("same")).alias("up"))
    r = g.groupBy("country").agg(F.percentile(F.col("eq") / F.greatest("up", F.lit(1)), F.lit(0.25)).alias("r"))
    share = F.greatest(F.least(1 - F.col("r") * F.col("up") / F.greatest("eq", F.lit(1)), F.lit(1.0)), F.lit(0.0))
    return g.join(F.broadcast(r), "country").select("country", "tok", F.round(share, 6).alias("share"))


@q(f"WITH {TOKENS} SELECT country, side, tok, n, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY country, side ORDER BY n DESC, tok) AS k FROM (SELECT country, side, tok, count(*) AS n FROM dt GROUP BY 1, 2, 3)) WHERE k <= 5")
def e19_token_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    n = token_diffs(spark, sf).groupBy("country", "side", "tok").agg(F.count("*").alias("n"))
    return windows.top_n(n, ["country", "side"], "n", "tok", 5)