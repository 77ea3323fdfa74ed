"""Plans that must not grow with the square of a group: what they compare once, and that they give all rows."""

from __future__ import annotations

from helpers import DATA

SF = f"{DATA}/sf0.001"


def test_joint_top(spark, monkeypatch):
    """The best by two views together and by either, with their ranks among all candidates, as ranking every pair gives them; in blocks of few queries."""
    from pyspark.sql import functions as F

    from kinloom.operators import blocking, windows

    monkeypatch.setattr(blocking, "ASKED", 5)
    a, b = F.concat(F.lit("a"), (F.col("id") % 4).cast("string")), F.concat(F.lit("b"), (F.col("id") % 7).cast("string"))
    docs = spark.range(120).select("id", (F.col("id") % 2).cast("string").alias("place"), (F.floor(F.col("id") / 2) % 3 == 0).alias("fit"), a.alias("a"), b.alias("b"))
    pairs = docs.where("NOT fit").withColumnRenamed("id", "q_id").alias("q").join(docs.where("fit").withColumnRenamed("id", "s1_id").alias("s"), "place")
    score = lambda c, m: F.when(F.xxhash64(f"q.{c}", f"s.{c}") % m == 0, 0.0).otherwise(F.round(F.pmod(F.xxhash64(f"q.{c}", f"s.{c}"), F.lit(97)) / 97, 6))
    pairs = pairs.withColumns({"sa": score("a", 2), "sb": score("b", 3)})
    sims = {c: pairs.where(F.col(f"s{c}") > 0.01).select("place", F.col(f"q.{c}").alias("text_q"), F.col(f"s.{c}").alias("text"), F.col(f"s{c}").alias("sim")).distinct() for c in "ab"}
    every = pairs.select("q_id", "s1_id", *(F.when(F.col(c) > 0.01, F.col(c)).otherwise(0.0).alias(c) for c in ("sa", "sb"))).where("sa > 0 OR sb > 0").withColumn("comb", F.round(F.col("sa") + F.col("sb"), 6))
    want = every.withColumns({f"rk_{c}": windows.rank0("q_id", c, "s1_id") + 1 for c in ("comb", "sa", "sb")}).where("rk_comb <= 4 OR rk_sa <= 2 OR rk_sb <= 2")
    assert want.groupBy("q_id").count().agg(F.max("count")).first()[0] > 4
    got = blocking.joint_top(docs, sims, 4, 2)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(want.select("q_id", "s1_id", "sa", "sb", "comb", "rk_comb", "rk_sa", "rk_sb"))


def test_records_keep_empty_fields(spark, tmp_path):
    """Names and addresses are normalised once for each different text, and a record without them, or without a country, stays."""
    from pyspark.sql import functions as F

    from kinloom.plans import records

    part = spark.read.parquet(f"{SF}/part.parquet")
    for c in ("p_name", "p_brand"):
        part = part.withColumn(c, F.when(F.col("p_partkey") % 50 != len(c), F.col(c)))
    part.write.parquet(f"{tmp_path}/part.parquet")
    raw, names = records.raw_records(spark, str(tmp_path)), records.state_names(spark, str(tmp_path)).groupBy("country").agg(F.map_from_entries(F.collect_list(F.struct("comp", "state"))).alias("states"))
    cols = records.text.name_parts(F.col("business_name")) | records.text.address_parts(F.col("business_address"), F.col("states"))
    want = raw.join(names, "country", "left").select("entity_id", *(c.alias(n) for n, c in cols.items()))
    rows = lambda df: sorted(map(tuple, df.select(sorted(want.columns)).collect()), key=repr)
    assert rows(records.records(spark, str(tmp_path))) == rows(want) and len(rows(want)) == part.count()


def test_shift_cap_finds_best_pairs_once(spark):
    """The cap reads its cells four times; the search over all pairs behind them must not run again each time."""
    from kinloom.plans import records

    assert "MapInArrow" not in records.m15_shift_cap(spark, SF)._jdf.queryExecution().toString()


def rows(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def explodes(df) -> bool:
    """Whether pairs follow from arrays, after the last exchange."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "Generate explode" in plan[: plan.find("Exchange")]


def test_number_pairs_by_class(spark, monkeypatch):
    from pyspark.sql import functions as F

    from kinloom.operators import blocking, features
    from kinloom.plans import records

    monkeypatch.setattr(blocking, "HELD", 3)
    got = records.p5_number_pair_feats(spark, SF)
    want = records.record_pairs(spark, SF).select("s1_id", "q_id", *(F.round(c, 6).alias(n) for n, c in features.number_features("u1", "uq").items()))
    assert rows(got, *want.columns) == rows(want, *want.columns) != [] and explodes(got)


def test_siblings_by_group(spark, monkeypatch):
    """Counted by group, as by pair; also with empty names and unknown numbers."""
    from pyspark.sql import functions as F

    from kinloom.operators import blocking, features

    monkeypatch.setattr(blocking, "HELD", 2)
    k = F.col("id")
    name = lambda *parts: F.when(k % 11 == 0, "").otherwise(F.concat_ws(" ", *(F.concat(F.lit(c), (k % m).cast("string")) for c, m in parts)))
    s = spark.range(30).select((k % 2).alias("g"), k.alias("s1_id"), name(("a", 3), ("b", 2)).alias("n1"))
    o = spark.range(100, 160).select((k % 3).alias("g"), k.alias("q_id"), name(("a", 4), ("b", 3)).alias("nq"), F.when(k % 5 > 0, F.concat((k % 3).cast("string"), F.lit(" 7"))).alias("uq"))
    want = features.sibling_features(s.join(o, "g"))
    got = features.group_siblings(s, o, ["g"])
    assert rows(got, *want.columns) == rows(want, *want.columns) != [] and explodes(got)


def test_ratios_by_class(spark, monkeypatch):
    from kinloom.functions import similarity as S
    from kinloom.operators import blocking
    from kinloom.plans import texts

    monkeypatch.setattr(blocking, "HELD", 2)
    got = texts.f1_f7_indel_ratios(spark, SF)
    order = lambda t: " ".join(sorted(t.split(" ")))
    scores = lambda a, b: [S.ratio(a, b), S.partial_ratio(a, b), S.ratio(order(a), order(b)), S.token_set_ratio(a, b), S.ratio(a.replace(" ", ""), b.replace(" ", ""))]
    want = {(r.s1_id, r.q_id): scores(r.n1, r.nq) for r in texts.entity_pairs(spark, SF).collect()}
    found = rows(got, "s1_id", "q_id", "ratio", "partial", "token_sort", "token_set", "no_space")
    assert len(found) == len(want) > 0 and all(abs(x - y) < 1e-5 for r in found for x, y in zip(r[2:], want[r[:2]], strict=True)) and explodes(got)


def test_minhash_pairs_follow_from_arrays(spark):
    from kinloom.plans import more

    assert explodes(more.b18_minhash_candidates(spark, SF))


def test_minhash_pairs_of_one_query_at_a_time(spark):
    """The two explodes are not compiled as one, which would hold all pairs of two arrays at once; no pair comes twice."""
    from kinloom.plans import more

    got = more.b18_minhash_candidates(spark, SF)
    found = got.collect()
    lines = [x.strip(" :+-") for x in got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n") if "Generate explode" in x and "_ids" in x]
    assert len(lines) >= 2 and lines[0].startswith("*(") and not lines[1].startswith("*(")
    assert len(found) == len({(r.q_id, r.s1_id) for r in found}) > 0


def test_profile_by_group(spark, monkeypatch):
    from kinloom.operators import blocking
    from kinloom.plans import rescue

    monkeypatch.setattr(blocking, "HELD", 2)
    got = rescue.p18_profile(spark, SF)
    pairs, met = rescue.member_pairs(spark, SF)
    count = {(r.s1_id, r.q_id): r["count"] for r in met.groupBy("s1_id", "q_id").count().collect()}
    assert {(r.s1_id, r.q_id): r.cl_n for r in got.collect()} == {(r.s1_id, r.q_id): count.get((r.s1_id, r.q_id), 0) for r in pairs.select("s1_id", "q_id").collect()} and explodes(got)


def test_similar_documents_without_a_shuffle_of_pairs(spark):
    """In shards of few documents, with repeated rows, ids in two parts and terms that are missing: as a join of postings gives it, and after the weights no pair is shuffled."""
    from pyspark.sql import functions as F

    from kinloom.operators import blocking, windows
    from kinloom.plans import retrieval

    k = F.col("id")
    terms = F.when(k % 13 > 0, F.array(F.lit("a"), *(F.concat(F.lit(c), (k % m).cast("string")) for c, m in (("b", 3), ("c", 5))), F.when(k % 7 > 0, F.lit("d"))))
    docs = spark.range(80).select(k, F.when(k % 4 > 0, "x").otherwise("y").alias("part"), (k % 3 == 0).alias("is_ref"), terms.alias("terms"))
    docs = docs.unionByName(docs.where("id % 5 = 0")).unionByName(docs.where("id < 20").withColumn("part", F.lit("y"))).unionByName(docs.where("id = 3").withColumn("part", F.lit(None).cast("string")))
    weights = blocking.tfidf(docs, F.col("is_ref"), "part", "id", "terms", 2, 0.9)
    sims = blocking.cosines(weights, "part", "id", 0.01, ["q_id", "s1_id"])
    best = sims.withColumn("rank", windows.rank0("q_id", "sim", "s1_id")).where("rank < 4")
    cols = ["q_id", "s1_id", "sim", "rank"]
    assert rows(blocking.sparse_top_k(weights, "part", "id", 4, 0.01, postings=7), *cols) == rows(best, *cols) != []
    vectors = blocking.doc_vectors(weights, "id")
    one = best.where("q_id >= 20 AND s1_id >= 20")
    assert rows(blocking.vector_dots(one, vectors, "id"), *cols[:3]) == rows(one, *cols[:3]) != []
    assert "Exchange" not in retrieval.b2_tfidf_topk(spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_profile_scores_by_block(spark, monkeypatch):
    """In small blocks, as joining every pair with the record's members and grouping gives them, to the last place; no pair is shuffled."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from kinloom.functions import similarity
    from kinloom.operators import blocking, members
    from kinloom.plans import rescue

    for of, name, value in ((blocking, "HELD", 3), (members, "BLOCK", 20), (members, "CELLS", 200), (members, "SPREAD", 100), (members, "KEPT", 9)):
        monkeypatch.setattr(of, name, value)
    got = rescue.p18_profile_scores(spark, SF)
    (pairs, met), by_q = rescue.member_pairs(spark, SF), Window.partitionBy("q_id")
    score = lambda name, a, b: similarity.scorer(name)(F.col(a), F.col(b))
    s = met.select("s1_id", "q_id", score("token_set_ratio", "nq", "nm").alias("nt"), score("ratio", "nq", "nm").alias("nr"), score("token_set_ratio", "aq", "am").alias("at"))
    g = s.groupBy("s1_id", "q_id").agg(F.max("nt").alias("cl_ntset_max"), F.avg("nt").alias("cl_ntset_mean"), F.max("nr").alias("cl_nratio_max"), F.max("at").alias("cl_atset_max"), F.max(F.col("nr") * F.col("at") / 100).alias("cl_na_max"))
    names = [c for c in g.columns if c.startswith("cl_")]
    f = pairs.select("s1_id", "q_id").join(g, ["s1_id", "q_id"], "left").na.fill(-1, names)
    gap = lambda c: F.round(F.col(c) - F.max(c).over(by_q), 6)
    want = f.select("s1_id", "q_id", *(F.round(c, 6).alias(c) for c in names), gap("cl_nratio_max").alias("cl_nratio_gap"), gap("cl_na_max").alias("cl_na_gap"))
    assert got.columns == want.columns and rows(got, *want.columns) == rows(want, *want.columns) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate posexplode" in plan[: plan.find("Exchange")]


def test_scores_all_by_all():
    """Texts without words, with equal words, with letters of one side, and longer than a machine word, as one by one; halves are rounded by digits."""
    import numpy as np
    from kinloom.functions import similarity
    from kinloom.operators import members

    texts = ["", " ", "a", "b a", "a  b", "b a c", "é x", "x" * 64, "y" + "x" * 64, "ab " * 40, "ab " * 40 + "c", "c d e", "abc abd"]
    for many, one in ((similarity.ratios, similarity.ratio), (similarity.token_set_ratios, similarity.token_set_ratio)):
        assert many(texts, texts[::-1]).tolist() == [[one(a, b) for b in texts[::-1]] for a in texts]
        known = members.Remembered(many)
        for xs, ys in ((texts[:5], texts[3:9]), (texts[4:], texts)):
            assert known(xs, ys).tolist() == [[one(a, b) for b in ys] for a in xs]
    assert members.rounded(np.array([0.1953125, -0.1953125, 0.0, 100.0, 1.0000005])).tolist() == [0.195313, -0.195313, 0.0, 100.0, 1.000001]


def test_profile_scores_of_repeated_keys(spark, tmp_path):
    """A record or query that comes twice gives its pairs again, and is no member of its own record's either copy."""
    from kinloom.plans import rescue
    from pyspark.sql import functions as F

    part = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 24").withColumns({"p_brand": F.lit("Brand#1"), "p_type": F.lit("SMALL")})
    got = {}
    for name, again in (("one", 0), ("two", 12)):
        part.unionByName(part.where(F.col("p_partkey") < again)).coalesce(1).write.parquet(f"{tmp_path}/{name}/part.parquet")
        got[name] = rescue.p18_profile_scores(spark, f"{tmp_path}/{name}").collect()
    copies = lambda k: 2 if k < 12 else 1
    assert sorted(map(tuple, got["two"])) == sorted(tuple(r) for r in got["one"] for _ in range(copies(r.s1_id) * copies(r.q_id))) and len(got["one"]) == 8 * 16
