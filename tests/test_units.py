"""Literal cases and properties of functions, metrics, sources and models."""

from __future__ import annotations

import numpy as np
import pytest
from helpers import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinloom.functions import similarity as sim
from kinloom.functions import text
from kinloom.operators import metrics, windows
from kinloom.plans import models, more
from kinloom.sources import tables

SF = f"{DATA}/sf0.001"
WORDS = st.text(alphabet="abc ", max_size=12)


@given(WORDS, WORDS)
@settings(max_examples=200, deadline=None)
def test_scorers(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sim.lcs_length(a, b) == table[-1][-1]
    for f in (sim.ratio, sim.partial_ratio, sim.jaro_winkler):
        assert f(a, a) in (1.0, 100.0) and abs(f(a, b) - f(b, a)) < 1e-9 and 0 <= f(a, b) <= 100
    assert sim.token_set_ratio(a, b) == sim.token_set_ratio(b, a)


def test_scorer_cases():
    assert round(sim.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert sim.ratio("", "") == 100 and sim.partial_ratio("bc", "abcd") == 100 and sim.token_set_ratio("a b", "b a c") == 100
    kinds = [("12", "21"), ("12", "13"), ("12", "123"), ("123", "13"), ("100", "95"), ("1", "77"), ("", "1"), ("5", "5")]
    assert [sim.number_edit(*k) for k in kinds] == ["transposed", "substituted", "inserted", "dropped", "near", "far", "missing", "same"]


def test_names_and_addresses(spark):
    cases = {"The Acme Co.": ("the acme co", "acme", "co", ""), "Smith & Sons L.L.C.": ("smith and sons llc", "smith sons", "llc", ""), "Foo Inc dba Bar Shop": ("foo inc bar shop", "foo bar shop", "inc", "bar shop"), "Limited": ("limited", "limited", "limited", ""), "": ("", "", "", "")}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "name string")
    got = {r.name: (r.name_full, r.name_core, r.legal, r.name_alt) for r in df.select("name", *(c.alias(n) for n, c in text.name_parts(F.col("name")).items())).collect()}
    assert {k: got[k] for k in cases} == cases and got[None] == ("", "", "", "")
    df = spark.createDataFrame([("007 Main St., null, Springfield",), ("",), (None,)], "addr string")
    rows = df.select(*(c.alias(n) for n, c in text.address_parts(F.col("addr")).items())).collect()
    assert (rows[0].addr_full, rows[0].nums, rows[0].alpha_comps, rows[0].addr_empty) == ("7 main street springfield", "7", "springfield", 0)
    assert all((r.addr_full, r.nums, r.addr_empty) == ("", "", 1) for r in rows[1:])


def test_metric_example(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "s1_id string")
    pred = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "z"), ("c", "q"), ("a", "x")], "s1_id string, s23_id string")
    true = spark.createDataFrame([("a", "x"), ("a", "z")], "s1_id string, s23_id string")
    counts = metrics.record_counts(ids, pred, true)
    got = {r.s1_id: round(r.f, 4) for r in counts.select("s1_id", metrics.f05(F.col("tp"), F.col("n_pred"), F.col("n_true")).alias("f")).collect()}
    assert got == {"a": 0.7143, "b": 1.0, "c": 0.0}
    m = metrics.macro_f05(counts).first()
    assert (m.n, m.singleton_acc) == (3, 0.5)


def test_sources(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\n1\tThe "Q\t\tUS\n2\t\t"x", y\tFR\n')
    rows = [tuple(r) for r in tables.read_tsv(spark, str(path)).orderBy("entity_id").collect()]
    assert rows == [("1", 'The "Q', "", "US"), ("2", "", '"x", y', "FR")]
    for _ in range(2):
        assert tables.cached_source(spark, str(path), str(tmp_path / "cache")).count() == 2
    pairs = spark.createDataFrame([(1, 9), (1, 10), (1, 9), (3, 4)], "s1 long, m long")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "s1 long")
    lists = tables.id_lists(keys, pairs, "s1", "m", "ids")
    assert {r.s1: r.ids for r in lists.collect()} == {1: "10,9", 2: "", 3: "4"}
    assert sorted((r.s1, r.m) for r in tables.explode_ids(lists, "s1", "ids", "m").collect()) == [(1, "10"), (1, "9"), (3, "4")]
    assert tables.semi_scan(spark, f"{SF}/part.parquet", spark.createDataFrame([(5,)], "p_partkey long"), "p_partkey", ["p_name"]).count() == 1


def test_windows_edges(spark):
    df = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.5), (1, 3, None), (2, 1, 0.1)], "g int, k int, x double")
    got = {(r.g, r.k): (r.r, r.s) for r in df.select("g", "k", windows.rank0("g", "x", "k").alias("r"), windows.second_best("g", "x", "k").alias("s")).collect()}
    assert got == {(1, 1): (0, 0.5), (1, 2): (1, 0.5), (1, 3): (None, 0.5), (2, 1): (0, None)}
    assert [(r.g, r.k) for r in windows.best_of(df.where("x IS NOT NULL"), ["g"], [F.col("x"), -F.col("k")]).orderBy("g").collect()] == [(1, 1), (2, 1)]


@pytest.mark.parametrize("name", ["m2_stage1_model", "m3_bagged", "m4_pair_classifier", "m9_out_of_fold"])
def test_models_learn(spark, name):
    rows = getattr(models, name)(spark, SF).collect()
    pos, neg = ([r.p_model for r in rows if r.label == y] for y in (1, 0))
    assert all(0 <= r.p_model <= 1 for r in rows)
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) > 0.6


def test_prune_and_draws(spark):
    kept = models.m1_prune(spark, SF).groupBy("s23_id").count().agg(F.max("count")).first()[0]
    assert 1 <= kept <= 6
    assert all(0 <= r.value <= 1 and r.k >= 0 for r in models.m24_sampled_sets(spark, SF).collect())
    assert {r.country for r in models.m25_count_matched_shift(spark, SF).collect()} == {"US", "India", "France"}


def test_sampled_sets(spark, monkeypatch):
    """Sets are as large as the record allows, pairs below the least score are misses, and blocks change nothing but the draws."""
    k, value = models.best_set(1, np.full(50, 0.99))
    assert k == 50 and value > 0.97
    assert models.best_set(2, np.full(6, 0.29))[0] > 0
    alone, among = (models.best_set(3, np.array([0.7, *[0.04] * n])) for n in (0, 100))
    assert alone[0] == 1 and among[1] < 0.8 * alone[1]
    p = np.round(np.random.default_rng(4).random(300), 3)
    whole = models.best_set(5, p)
    monkeypatch.setattr(models, "DRAWN", 7)
    parts = models.best_set(5, p)
    assert abs(whole[0] - parts[0]) <= 15 and abs(whole[1] - parts[1]) < 0.02
    listed = np.sort(p[p >= 0.05])[::-1]
    rng = np.random.default_rng(6)
    hit = rng.random((4000, len(listed))) < listed
    true = hit.sum(axis=1) + rng.poisson(p[p < 0.05].sum(), 4000)
    f = (1.25 * np.cumsum(hit, axis=1) / (0.25 * true[:, None] + np.arange(1, len(listed) + 1))).mean(axis=0)
    assert abs(whole[1] - f.max()) < 0.02
    rows = {r.s1_id: r.k for r in models.m24_sampled_sets(spark, SF).collect()}
    assert len(rows) == models.scored_pairs(spark, SF).select("s1_id").distinct().count() and max(rows.values()) > 20


def test_minhash_candidates(spark):
    """Over all records, against brute force: equal names always meet, others mostly, and distances are exact."""
    rows = more.parts_entities(spark, SF).select("entity_id", "side", "name_core").collect()
    grams = {r.name_core: {f" {w} "[i : i + 3] for w in r.name_core.split(" ") for i in range(max(1, len(w)))} for r in rows}
    apart = {(a, b): 1 - len(x & y) / len(x | y) for a, x in grams.items() for b, y in grams.items()}
    want = {(q.entity_id, s.entity_id): d for q in rows if q.side > 1 for s in rows if s.side == 1 and (d := apart[q.name_core, s.name_core]) <= 0.5}
    found = more.b18_minhash_candidates(spark, SF).collect()
    got = {(r.q_id, r.s1_id): r.distance for r in found}
    assert len(found) == len(got) and all(abs(d - want[k]) < 1e-5 for k, d in got.items())
    assert {k for k, d in want.items() if d == 0} <= set(got) and len(got) >= 0.8 * len(want)


def test_hot_terms_and_blocks(spark):
    """Dealing a hot term's postings to several keys, or vectors to several blocks, changes no result."""
    from pyspark.sql import functions as F

    from kinloom.operators import blocking

    docs = spark.range(60).select(F.col("id"), F.lit("x").alias("part"), (F.col("id") % 3 == 0).alias("is_ref"), F.array(F.lit("hot"), F.lit("hot"), (F.col("id") % 7).cast("string")).alias("terms"))
    weights = blocking.tfidf(docs, F.col("is_ref"), "part", "id", "terms", 1, 1.0)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(blocking.sparse_top_k(weights, "part", "id", 4, 0.01, postings=3)) == rows(blocking.sparse_top_k(weights, "part", "id", 4, 0.01)) != []
    vectors = docs.select("id", "is_ref", F.concat_ws("", (F.col("id") % 2).cast("string")).alias("part"), F.array(F.sin("id"), F.cos("id")).alias("v"))
    q, s = vectors.where("NOT is_ref").select("part", F.col("id").alias("q_id"), F.col("v").alias("qv")), vectors.where("is_ref").select("part", F.col("id").alias("s1_id"), F.col("v").alias("sv"))
    for part in (None, "part"):
        assert rows(blocking.dense_top_k(q, s, 3, part=part, block=7)) == rows(blocking.dense_top_k(q, s, 3, part=part)) != []


def test_member_profile_scores(spark):
    """The profile's scorers against plain Python over the same pairs."""
    from helpers import DATA

    from kinloom.functions import similarity
    from kinloom.plans import rescue

    sf = f"{DATA}/sf0.001"
    pairs, met = (df.collect() for df in rescue.member_pairs(spark, sf))
    want = {(r.s1_id, r.q_id): [-1.0, -1.0, -1.0] for r in pairs}
    for key in {(r.s1_id, r.q_id) for r in met}:
        own = [r for r in met if (r.s1_id, r.q_id) == key]
        sets = [similarity.token_set_ratio(r.nq, r.nm) for r in own]
        want[key] = [max(sets), sum(sets) / len(sets), max(similarity.ratio(r.nq, r.nm) * similarity.token_set_ratio(r.aq, r.am) / 100 for r in own)]
    got = {(r.s1_id, r.q_id): [r.cl_ntset_max, r.cl_ntset_mean, r.cl_na_max] for r in rescue.p18_profile_scores(spark, sf).collect()}
    assert met and got.keys() == want.keys()
    assert all(abs(a - b) < 1e-5 for k in want for a, b in zip(got[k], want[k], strict=True))


def test_count_matched(spark):
    """At the shift found the scores' sum is what was wanted, also for wants that need large shifts."""
    import numpy as np
    from pyspark.sql import functions as F

    from kinloom.plans import models

    rng = np.random.default_rng(3)
    p = {"a": rng.random(400), "b": rng.random(50) * 0.01, "c": np.array([0.5])}
    scored = spark.createDataFrame([(g, float(x)) for g, xs in p.items() for x in xs], "country string, p double")
    want = spark.createDataFrame([("a", 37), ("b", 45), ("d", 3)], "country string, want long")
    found = {r.country: r["shift"] for r in models.count_matched(scored, want, "country").collect()}
    for g, n in (("a", 37), ("b", 45)):
        c = np.clip(p[g], 0.001, 0.999)
        assert abs((1 / (1 + np.exp(-(np.log(c / (1 - c)) + found[g])))).sum() - n) < 0.01
    assert models.count_matched(scored, want.where(F.lit(False)), "country").count() == 0


def test_view_scores(spark):
    """Ratios, ranks, gaps and ties of name-only candidates against plain Python."""
    from helpers import DATA

    from kinloom.functions import similarity
    from kinloom.plans import rescue

    sf = f"{DATA}/sf0.001"
    names = {(r.q_id, r.s1_id): (r.n1, r.nq, r.s_c + r.s_k + r.s_w) for r in rescue.view_pairs(*rescue.name_views(spark, sf)).collect()}
    got = {(r.q_id, r.s1_id): r for r in rescue.p17_view_scores(spark, sf).collect()}
    assert names and got.keys() == names.keys()
    for (q, s), r in got.items():
        own = {k: got[k] for k in got if k[0] == q}
        ratio = similarity.ratio(*names[q, s][:2])
        assert abs(r.r - ratio) < 1e-5 and abs(r.ts - similarity.token_set_ratio(*names[q, s][:2])) < 1e-5 and abs(r.comb - names[q, s][2] - ratio / 100) < 1e-5
        order = sorted(own, key=lambda k: (-own[k].comb, k[1]))
        assert r.rk_comb == order.index((q, s)) + 1 and abs(r.comb_gap - (r.comb - own[order[0]].comb)) < 1e-5
        assert abs(r.comb_gap2 - (r.comb - own[order[min(1, len(order) - 1)]].comb)) < 1e-5 or len(order) == 1
        assert r.r_ntie == sum(o.r >= max(x.r for x in own.values()) - 3 for o in own.values())


def test_copies_meet_once(spark):
    """Comparing different texts once finds what comparing all documents does, and the shared words of copies stay few."""
    from pyspark.sql import functions as F

    from kinloom.operators import blocking

    words = F.concat_ws(" ", F.lit("hot"), (F.col("id") % 7).cast("string"), F.when(F.col("id") % 5 == 0, "rare"))
    docs = spark.range(200).select(F.col("id"), F.when(F.col("id") % 11 == 0, "b").otherwise("a").alias("part"), (F.col("id") % 3 == 0).alias("is_ref"), words.alias("name"))
    split = lambda c: F.split(c, " ")
    plain = blocking.sparse_top_k(blocking.tfidf(docs.withColumn("terms", split("name")), F.col("is_ref"), "part", "id", "terms", 1, 1.0), "part", "id", 4, 0.01)
    weights = blocking.text_weights(docs, "name", split, 1, 1.0)
    found = blocking.of_queries(docs, "name", blocking.text_top_k(docs, "name", weights, 4, 0.01))
    rows = lambda df: sorted(map(tuple, df.select("q_id", "s1_id", "sim", "rank").collect()))
    assert rows(found) == rows(plain) != []
    assert weights.select("part", "text").distinct().count() <= 28


def test_best_pairs_by_block(spark, monkeypatch):
    """Each query's best pairs, found block by block from ids alone, are those of all pairs with all their fields."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from kinloom.plans import records

    monkeypatch.setattr(records, "BLOCK", 7)
    for on, k in ((records.NEAR, 1), (records.NAMED, 2)):
        pairs = records.record_pairs(spark, SF, on, "cell")
        place = F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("p").desc(), "s1_id"))
        want = pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")
        got = records.best_record_pairs(spark, SF, on, "cell", k)
        key = sorted(want.columns)
        assert sorted(got.columns) == key
        rows = lambda df: sorted(map(tuple, df.select(*key).collect()), key=repr)
        assert rows(got) == rows(want) != []
