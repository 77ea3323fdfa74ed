"""Each stage on the rows that the one before kept."""

from __future__ import annotations

import corpus_pipeline
from helpers import DATA
from test_join_lm import brute

from kinloom.llm import ngram_join
from kinloom.llm.common import table

SF = f"{DATA}/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), None if name == "packing" else before.schema)
        if name != "packing":
            assert docs.columns == before.columns
            kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    all_ids = {r.doc_id for r in table(spark, SF, "documents").collect()}
    after = {d for d, _ in kept["toxicity"]}
    assert sum(labels[d].toxic for d in after if d in labels) < sum(r.toxic for r in labels.values())
    assert len(after) > 0.8 * len(all_ids)
    groups = {c for _, n, c in brute(kept["quality"], ngram_join.Likeness()) if n}
    assert {d for d, _ in kept["near_copies"]} == groups | {d for d, t in kept["quality"] if not (t or "").split()}
    items = [r.text.lower().split() for r in table(spark, SF, "benchmark").collect()]
    grams = {tuple(w[i : i + 13]) for w in items for i in range(len(w) - 12)}
    for d, t in kept["near_copies"]:
        w = (t or "").lower().split()
        if any(tuple(w[i : i + 13]) in grams for i in range(len(w) - 12)):
            assert d not in {x for x, _ in kept["decontamination"]}
    assert {r.doc_id for r in docs.collect()} == {d for d, _ in kept["decontamination"]}
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.select("doc_id").distinct().collect()} == {d for d, _ in kept["decontamination"]}
