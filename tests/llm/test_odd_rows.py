"""Pipeline stages and classifiers on nulls, repeats, blank and long texts, conflicting labels, clashing columns and empty tables."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from kinloom.llm import decontamination, ngram_join, subword, toxicity
from kinloom.llm.common import table

SF = f"{DATA}/sf0.001"


def odd(spark):
    docs = table(spark, SF, "documents")
    text = docs.where("text IS NOT NULL").orderBy("doc_id").first().text
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    rows = [(None, text), (900001, text), (900001, text), (900002, None), (900003, ""), (900004, " \t\n"), (900005, " ".join(f"w{i}" for i in range(60_000)) + " " + text), (900006, f"before {item} after")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.lit(0).cast("long")})
    return frame.withColumns({c: F.lit(7) for c in ("gone", "gone_key", "set_key", "key", "__key", "score", "predicted", "id")})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], odd(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        assert sum(r.length for r in rows) == sum({(r.doc_id, r.doc_tokens, r.start, r.sequence_id, r.offset): r.length for r in rows}.values())
        assert sum(r.doc_id == 900001 and r.start == 0 for r in rows) == 2 and sum(r.doc_id == 900002 for r in rows) == 1
        return
    assert out.columns == docs.columns
    kept = [r.doc_id for r in rows]
    if name == "near_copies":
        assert sorted(kept, key=str) == [900001, 900002, 900003, 900004, 900005, 900006]
    if name == "decontamination":
        assert 900006 not in kept and kept.count(900001) == 2 and {None, 900002, 900003, 900004, 900005} <= set(kept)


def test_bound_holds_with_repeats_and_conflicts(spark):
    """Rows that repeat an id, and ids with both labels, neither break the bound nor decide the model."""
    rng = np.random.default_rng(1)
    words = lambda bad: " ".join(rng.choice(["awful", "vile"] if bad else ["nice", "calm"], 12))
    rows = [(i, words(i % 2)) for i in range(40)] + [(1, f"vile {k}") for k in range(300)] + [(2, "nice calm")] * 200
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(3, 0), (5, 1), (5, 1), (None, 1), (7, None), (8, 4)], "doc_id long, toxic int")
    seen = []
    train, how = subword.train, subword.Training(rows_a_class=5, epochs=3)
    subword.train = lambda rows, *a: seen.append(len(rows)) or train(rows, *a)
    try:
        first = subword.fit(docs, labels, toxicity.BAG, how, label_col="toxic")
        again = subword.fit(docs.repartition(7), labels.repartition(3), toxicity.BAG, how, label_col="toxic")
    finally:
        subword.train = train
    assert np.array_equal(first[0], again[0]) and first[1] == again[1]
    tiny = subword.fit(docs, labels, toxicity.BAG, subword.Training(rows_a_class=5, megabytes=0, epochs=1), label_col="toxic")
    assert not tiny[0].any()  # no bag fits: the classes' share alone
    scores = {r.doc_id: r.score for r in subword.score(docs.where("doc_id > 2"), first, toxicity.BAG, ["doc_id"]).collect()}
    assert np.mean([scores[i] for i in scores if i % 2]) > np.mean([scores[i] for i in scores if i % 2 == 0])


def test_remote_side_joins(spark):
    """The same rows stay when no list is broadcast."""
    docs = odd(spark)
    items = table(spark, SF, "benchmark")
    key = lambda df: sorted((str(r.doc_id), len(r.text or "")) for r in df.collect())
    assert key(decontamination.without_leaks(docs, items, broadcast_rows=0)) == key(decontamination.without_leaks(docs, items))
    assert key(ngram_join.one_of_each(docs, ngram_join.Likeness(), broadcast_ids=0)) == key(ngram_join.one_of_each(docs, ngram_join.Likeness()))


def test_short_batches(spark):
    """What Python gets at once while a table is written is bounded, and the session's setting comes back."""
    import pyarrow as pa

    from kinloom.llm import common

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    rows = common.materialize(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long"), "sizes").collect()
    assert sum(r.n for r in rows) == 5000 and max(r.n for r in rows) <= common.ROWS_A_BATCH
    assert spark.conf.get(key) == own


def test_added_tokens():
    """Special tokens are found without the tokenizer's model, as the model gives them."""
    from tokenizers import Tokenizer

    from kinloom.llm import packing
    from kinloom.llm.queries import vocabulary

    path = vocabulary()[0]
    assert packing.added_tokens(path) == [t.content for t in Tokenizer.from_file(path).get_added_tokens_decoder().values()]


def test_lopsided_input_is_dealt_out(spark, tmp_path, monkeypatch):
    """A table in one row group goes to several tasks, no row is lost or doubled, and small or even tables stay as they are."""
    from kinloom.llm import common

    rows = [(k % 90, f"text {k % 90}" if k % 7 else None) for k in range(100)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    parts = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts(common.dealt(docs)) == parts(docs) == 1 and common.dealt(docs.limit(0)).count() == 0
    monkeypatch.setattr(common, "ROWS_A_TASK", 20)
    monkeypatch.setattr(common, "LOPSIDED", 0.5)
    key = lambda df: sorted(map(str, df.collect()))
    assert parts(common.dealt(docs)) > 1 and key(common.dealt(docs)) == key(docs)
    stage = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert parts(stage) > 1
