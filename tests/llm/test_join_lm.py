"""The n-gram join and the language model against brute force."""

from __future__ import annotations

import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from kinloom.llm import ngram_join, ngram_lm
from kinloom.llm.common import table
from kinloom.llm.queries import QUERIES

SF = f"{DATA}/sf0.001"


def brute(rows, how):
    """(id, shingles, component) of all rows, by all pairs that share a shingle."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + how.width]) for i in range(max(1, len(w) - how.width + 1))} if w else set()

    sets, parent, having = [shingles(t) for _, t in rows], list(range(len(rows))), collections.defaultdict(list)

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        common = collections.Counter(j for g in s for j in having[g])
        for j, k in common.items():
            if how.den * k >= how.num * (len(s) + len(sets[j]) - k):
                parent[top(i)] = top(j)
        for g in s:
            having[g].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


def made():
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    worn = lambda: " ".join(w if rng.random() > rng.choice([0, 0.01, 0.02, 0.03]) else f"z{rng.randrange(9)}" for w in base[: rng.randrange(100, 121)])
    rows = [(i, worn()) for i in range(250)] + [(1000 + i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(0, 12)))) for i in range(150)]
    return rows + [(5000, None), (5001, ""), (5001, " \n"), (None, "a b"), (None, "a b"), (7000, "a b"), (5003, "A b"), (5003, "A b")]


@pytest.mark.parametrize("how, block", [(ngram_join.Likeness(3, 90, 100), 2000), (ngram_join.Likeness(5, 4, 5), 40)])
def test_join(spark, monkeypatch, how, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rows = made()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, label int").withColumns({c: F.lit(1) for c in ("gone", "gone_key", "__key", "set_key", "id", "a b")})
    want = brute(rows, how)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs, how).collect()), key=str) == want
    kept = ngram_join.one_of_each(docs, how, broadcast_ids=0 if block == 40 else ngram_join.BROADCAST_IDS).collect()
    groups = {c for _, n, c in want if n}
    assert len(kept) == len(groups) + sum(n == 0 for _, n, _ in want) and set(kept[0].asDict()) == set(docs.columns)
    assert {r.doc_id for r in kept} == groups | {d for d, n, _ in want if not n}


def test_join_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_join"](spark, SF).collect()), key=str)
    assert got == brute(rows, ngram_join.Likeness(3, 90, 100))
    empty = table(spark, SF, "documents").limit(0)
    assert ngram_join.linked_components(empty, ngram_join.Likeness()).count() == 0 and ngram_join.one_of_each(empty, ngram_join.Likeness()).count() == 0


def test_segments_hold_what_links():
    """Sets that link share a segment that stands for both, and sets of a few shingles or more have no empty one among these."""
    rng = np.random.default_rng(2)
    for how in (ngram_join.Likeness(3, 90, 100), ngram_join.Likeness(5, 4, 5), ngram_join.Likeness(5, 7, 10)):
        for n in [*range(1, 60), 200, 333, 1000]:
            a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
            for extra in range(0, n // 2 + 2):
                b = np.unique(np.concatenate([a[: len(a) - extra // 2], rng.integers(0, 1 << 64, (extra + 1) // 2, np.uint64)]))
                if len(b) and ngram_join._linked(a, b, how):
                    assert set(ngram_join.signatures(a, how).tolist()) & set(ngram_join.signatures(b, how).tolist())
    for share in ((1, 2), (6, 10), (5, 4)):
        with pytest.raises(ValueError):
            ngram_join.Likeness(5, *share)


def test_unrelated_sets_do_not_meet():
    rng = np.random.default_rng(3)
    for how in (ngram_join.Likeness(3, 90, 100), ngram_join.Likeness()):
        found = collections.Counter(x for n in rng.integers(8, 400, 3000) for x in set(ngram_join.signatures(np.unique(rng.integers(0, 1 << 64, n, np.uint64)), how).tolist()))
        assert sum(c > 1 for c in found.values()) < 5


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, span in ((0, 1), (1, 5), (1, 1 << 60), (1000, 1200), (20_000, 1 << 62), (3, 1 << 63), (5000, 5000)):
        keys = np.unique(np.concatenate([rng.integers(0, span, n // 2, np.uint64), rng.integers(0, min(span, 3000), n - n // 2, np.uint64)])) if n else np.zeros(0, np.uint64)
        coded = ngram_lm.ef_encode(keys)
        asked = np.concatenate([keys, rng.integers(0, span, 3000, np.uint64), np.array([0, span - 1, (1 << 64) - 1], np.uint64)])
        place = {int(k): i for i, k in enumerate(keys)}
        assert ngram_lm.ef_find(coded, asked).tolist() == [place.get(int(k), -1) for k in asked]


def test_lm_query(spark):
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    words = {d: [*t.encode().lower().split(), None] for d, t in texts.items()}
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = collections.Counter(w for d, ws in words.items() if not out(d) for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in QUERIES["op2_lm_score"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, ws in words.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, out(d))
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score <= 0
    held = [r for d, r in got.items() if out(d)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def plain_model(texts):
    """The model by dictionaries and without rounding: log10 probabilities of a text's tokens."""
    grams = [collections.Counter() for _ in range(3)]
    for t in texts:
        w = [*t.lower().split(), None]
        for n in range(3):
            grams[n].update(tuple(w[i : i + n + 1]) for i in range(len(w) - n))
    d = [ngram_lm._discount(sum(c == 1 for c in g.values()), sum(c == 2 for c in g.values())) for g in grams]
    total, kinds = sum(grams[0].values()), len(grams[0])
    after = [collections.Counter(), collections.Counter()]
    mass = [collections.Counter(), collections.Counter()]
    for n in (1, 2):
        for g, c in grams[n].items():
            after[n - 1][g[:-1]] += c
            mass[n - 1][g[:-1]] += d[n]

    def p(gram):
        if len(gram) == 1:
            c = grams[0][gram]
            return (c - d[0]) / total if c else d[0] * kinds / total
        n, context = len(gram) - 1, gram[:-1]
        below = p(gram[1:])
        if not after[n - 1][context]:
            return below
        return max(grams[n][gram] - d[n], 0) / after[n - 1][context] * (grams[n][gram] > 0) + mass[n - 1][context] / after[n - 1][context] * below

    return lambda t: [math.log10(p(tuple(w[max(0, i - 2) : i + 1]))) for w in [[*t.lower().split(), None]] for i in range(len(w))]


def logs(model, texts):
    reader = ngram_lm.Reader(model)
    numbers, ends = reader.read(pa.array(texts))
    return np.split(ngram_lm.log10_probabilities(reader, numbers), ends[:-1])


@pytest.mark.parametrize("hot", [1 << 40, 40])
def test_lm_against_plain_model(spark, monkeypatch, hot):
    """Each token's log10 probability is that of the plain model but for rounding: half a step, 0.02 on average, in each of up to two weights and a probability. hot: most words are dealt out."""
    rng = random.Random(4)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(300)] + ["a b " * 50] * 2
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 1 << 40 if hot > 1000 else 900)
    monkeypatch.setattr(ngram_lm, "HOT_TOKENS", hot)
    model = ngram_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert (len(model.hot) > 20) == (model.shards > 1) == (hot == 40)
    plain = plain_model(texts)
    asked = [*texts, "zz w1 w1 zz", "w1 zz w1 w1 w1", "b a b"]
    for text, got in zip(asked, logs(model, asked), strict=True):
        want = plain(text)
        assert (got <= 0).all()
        # shards discount by their own counts
        assert len(got) == len(want) and np.abs(got - want).max() < (0.08 if hot > 1000 else 0.6)


def test_lm_sums_to_one_and_edges(spark, monkeypatch):
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 40)
    rows = [(1, "a b a b c a b d a b a b c", 0), (2, None, 0), (3, "", 0), (4, "A B a  \n b c", 0), (4, "A B a  \n b c", 0), (None, "e f", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    model = ngram_lm.train(docs)
    vocabulary = [*"abcdef", "unknown"]
    for context in ("a b", "b a", "x a", "a x", "x y", "e f", "c a"):
        got = logs(model, [f"{context} {w}" for w in vocabulary] + [context])
        assert abs(sum(10 ** x[2] for x in got) - 1) < 0.03
    out = ngram_lm.score(docs, model, ["doc_id", "score"]).collect()
    assert len(out) == len(rows) and all(np.isfinite(r.score) and r.score < 0 for r in out)
    assert ngram_lm.score(docs.limit(0), model, ["doc_id"]).count() == 0
    blank = ngram_lm.score(docs, ngram_lm.train(docs.limit(0)), ["doc_id"]).collect()
    assert all(r.score == 0 and r.n_known == 0 and r.base_score == 0 for r in blank)


def test_lm_long_text_and_full_memory(spark, monkeypatch):
    """A text beyond a batch and more words than a task remembers: the same scores."""
    rng = random.Random(8)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(n)) for n in (20_000, 5, 400, 0, 9000)] + [" \t\x0b ", None, "\x1f\x85 a\u2003b A"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    want = {r.doc_id: r.score for r in ngram_lm.score(docs, ngram_lm.train(docs), ["doc_id"]).collect()}
    monkeypatch.setattr(ngram_lm, "BATCH_TOKENS", 500)
    monkeypatch.setattr(ngram_lm, "HELD", 700)
    got = {r.doc_id: r.score for r in ngram_lm.score(docs, ngram_lm.train(docs), ["doc_id"]).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_lm_counts_every_trigram(spark, monkeypatch):
    """Trigrams seen once are in the model and make their last word likelier than its bigram does."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 40)
    texts = ["a b c", "x b d", "x b d", "y b d", "y b d e", "p q r s t"]
    model = ngram_lm.train(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    want = {(*w[i : i + 3],) for t in texts for w in [[*t.split(), None]] for i in range(len(w) - 2)}
    assert sum(len(model.level("trigrams", s)["p"]) for s in model.trigrams) == len(want)
    known, unknown = logs(model, ["a b c", "x b c"])
    assert known[2] > unknown[2] + 0.3
