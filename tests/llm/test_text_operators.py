"""Fingerprints, decontamination, classifiers, extraction and packing against brute force on small tables."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F

from kinloom.llm import decontamination, fingerprints, html_text, packing, quality, subword, toxicity
from kinloom.llm.common import table
from kinloom.llm.queries import QUERIES, vocabulary

SF = f"{DATA}/sf0.001"
ODD = [(1, None, "a"), (2, "", "b"), (3, "one  two\n three", "c"), (4, "w " * 30_000, "d"), (5, "x y z " * 9, "e"), (5, "x y z " * 9, "e"), (None, "no id at all here now", "f"), (7, " \t\n", "g"), (8, "é<|endoftext|> \n \n É ", "h")]
SCHEMA = "doc_id long, text string, score string"


def shingles(text, n=5):
    w = [x.decode() for x in text.lower().encode().split()]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(spark):
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    got = {r.doc_id: r for r in QUERIES["op5_fingerprints"](spark, SF).collect()}
    assert got.keys() == texts.keys()
    off = []
    for i, d in enumerate(ids):
        text, after = texts[d], texts[ids[(i + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        off += [r.near_edited - alike(shingles(text), shingles(edited)), r.near_next - alike(shingles(text), shingles(after))]
        exact = len(shingles(text) | shingles(edited)) < fingerprints.K
        assert not exact or abs(off[-2]) < 1e-9
    assert np.sqrt(np.mean(np.square(off))) < 0.045 and max(map(abs, off)) < 0.2
    same = {}
    for d, t in texts.items():
        assert same.setdefault(t, got[d].fingerprint) == got[d].fingerprint


def test_fingerprint_buckets(spark, monkeypatch):
    """Many small buckets give what one gives; nulls, repeats and one row work."""
    docs = spark.createDataFrame([(int(i) ** 2 - 50, f"text {i} with some words in it {i % 3}") for i in range(40)] + [(a, b) for a, b, _ in ODD], "doc_id long, text string")
    key = ["doc_id", "edited_sha256", "near_next"]
    one = sorted(map(str, fingerprints.fingerprint_pairs(docs).select(key).collect()))
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 4)
    assert sorted(map(str, fingerprints.fingerprint_pairs(docs).select(key).collect())) == one and len(one) == 40 + len(ODD)
    monkeypatch.setattr(fingerprints, "ROWS_A_BUCKET", 2)
    for buckets, parts in ((3, 6), (1, 9), (4, 2)):  # more rows than the buckets take are cut further
        monkeypatch.setattr(fingerprints, "BUCKETS", buckets)
        monkeypatch.setattr(fingerprints, "PARTS", parts)
        assert sorted(map(str, fingerprints.fingerprint_pairs(docs).select(key).collect())) == one
    single = fingerprints.fingerprint_pairs(docs.where("doc_id = 3")).first()
    assert single.near_next == 1.0
    assert fingerprints.fingerprint_pairs(docs.limit(0)).count() == 0


def test_sketch_merge(spark):
    rows = [(k, i, f"{k} {i} " * (i + 1)) for k in "ab" for i in range(9)] + [("c", 0, "")]
    parts = spark.createDataFrame(rows, "k string, i int, text string").withColumn("s", fingerprints.sketch(F.split("text", " "), 16))
    got = {r.k: r.s for r in fingerprints.merge_sketches(parts, ["k"], "s", 16).collect()}
    for k in "abc":
        assert got[k] == sorted({h for r in parts.collect() if r.k == k for h in r.s})[:16]


def test_decontamination(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    grams = {}
    for r in items.collect():
        w = r.text.lower().encode().split()
        for i in range(len(w) - 12):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(r.item_id)
    want = set()
    for r in docs.collect():
        w = (r.text or "").lower().encode().split()
        for i in range(len(w) - 12):
            want |= {(r.doc_id, k) for k in grams.get(tuple(w[i : i + 13]), ())}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 2


@pytest.mark.parametrize("width", [0, decontamination.BROADCAST_ROWS])
def test_decontamination_edits(spark, width):
    rng = np.random.default_rng(3)
    item = [f"w{i}" for i in range(40)]
    worn = [w if i % 6 else "changed" for i, w in enumerate(item)]
    rows = [(1, " ".join(["pre"] * 5 + item), 0), (2, " ".join(worn + ["post"]), 0), (3, " ".join(rng.permutation(item)), 0), (4, None, 0), (5, "", 0), (6, "a B c", 0), (6, "a B c", 0), (None, " ".join(item[:20]), 0), (8, " ".join(item[:9]), 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, "A b  C")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs, items, broadcast_rows=width).collect()}
    assert set(got) == {(1, 1), (2, 1), (None, 1), (6, 4)}
    assert (got[1, 1].doc_start, got[1, 1].doc_end, got[1, 1].matched) == (5, 45, 40)
    assert got[2, 1].matched >= 30
    assert decontamination.leaks(docs.limit(0), items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in decontamination.without_leaks(docs, items).collect()) == ["3", "4", "5", "8"]


def test_bags_do_not_depend_on_neighbours():
    texts = ["", None, "a", "The thing the thing thing", "é" * 50, " x ", "word " * 3000]
    for bag in (toxicity.BAG, quality.BAG):
        for piece in (64, subword.PIECE):
            subword.PIECE, was = piece, subword.PIECE
            try:
                sums = {}
                for first, owner, buckets in subword.bags(texts, bag):
                    for o, b in zip(owner, buckets):
                        sums.setdefault(first + int(o), {}).setdefault(int(b), 0)
                        sums[first + int(o)][int(b)] += 1
                for i, t in enumerate(texts):
                    b, c = subword.counted(t, bag)
                    assert sums.get(i, {}) == dict(zip(b.tolist(), c.tolist()))
            finally:
                subword.PIECE = was


@pytest.mark.parametrize("module, column, query", [(toxicity, "toxic", "op4_toxicity"), (quality, "quality", "op6_quality")])
def test_classifiers(spark, module, column, query):
    sf = f"{DATA}/sf0.01"
    got = QUERIES[query](spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").collect()
    assert len(got) == table(spark, sf, "documents").count()
    fold = lambda i: zlib.crc32(str(i).encode()) % (3 if column == "toxic" else 5) == (1 if column == "toxic" else 0)
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= module.THRESHOLD) for r in got)
    pos, neg = ([r.score for r in got if r.held_out and r[column] == y] for y in (1, 0))
    assert np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg]) > 0.7
    small = subword.Training(rows_a_class=20, epochs=2)
    odd = spark.createDataFrame(ODD, SCHEMA)
    labels = table(spark, sf, "labels")
    out = module.scores(odd, labels, ["doc_id", "score"], column, training=small).collect()  # no labelled texts: the ids are others
    assert len(out) == len(ODD) and out[0].asDict().keys() == {"doc_id", "score", "predicted"}
    assert module.scores(odd, labels.limit(0), ["doc_id"], column).select("score").distinct().collect()[0].score == 0.5
    assert module.scores(odd.limit(0), labels, ["doc_id"], column, training=small).count() == 0


def overlaps(doc, item):
    """Whether some stretch of some diagonal has 13 words or more (or the whole of a shorter item), 80 % of them equal."""
    least = min(13, len(item))
    for d in range(least - len(item), len(doc) - least + 1):
        low, high = max(0, -d), min(len(item), len(doc) - d)
        same = [0]
        for p in range(low, high):
            same.append(same[-1] + (doc[p + d] == item[p]))
        if any(5 * (same[j] - same[i]) >= 4 * (j - i) for i in range(len(same)) for j in range(i + least, len(same))):
            return True
    return False


def changed(rng, item, places):
    """The item with new words at places, between others."""
    return [f"x{rng.integers(9)}" for _ in range(rng.integers(3))] + [f"y{i}" if i in places else w for i, w in enumerate(item)] + [f"z{i}" for i in range(rng.integers(3))]


def compare_leaks(spark, docs, items):
    want = {(i, k) for i, d in enumerate(docs) for k, item in enumerate(items) if overlaps(d, item)}
    frames = [spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], f"{name} long, text string") for rows, name in ((docs, "doc_id"), (items, "item_id"))]
    got = {(r.doc_id, r.item_id): r for r in decontamination.leaks(*frames).collect()}
    assert want and set(got) == want and len(want) < len(docs) * len(items)
    for (i, k), r in got.items():
        pairs = list(zip(docs[i][r.doc_start : r.doc_end], items[k][r.item_start : r.item_end], strict=True))
        assert len(pairs) >= min(13, len(items[k])) and sum(a == b for a, b in pairs) == r.matched >= 0.8 * len(pairs)


def test_decontamination_substitutions(spark):
    """Substitutions near the edges and anywhere in items of 13 to 25 words, against brute force."""
    rng = np.random.default_rng(5)
    items = [[f"w{n}_{i}" for i in range(n)] for n in (13, 14, 17, 18, 20, 25)]
    docs = [changed(rng, item, set(rng.choice(len(item), k, replace=False).tolist())) for item in items for k in range(len(item) // 5 + 2) for _ in range(4)]
    docs += [changed(rng, item, places) for item in items for places in ({0}, {1}, {len(item) - 1}, {len(item) - 2}, {1, len(item) - 2})]
    compare_leaks(spark, docs, items)


@pytest.mark.parametrize("n", range(1, 26))
def test_decontamination_seeds(n):
    """Whichever words of n differ, as many as the share allows, some mask gets around them; longer stretches hold one of these."""
    from itertools import combinations

    masks = [*decontamination.MASKS, *(decontamination._short_masks(n) if n < decontamination.MIN_WORDS else [])]
    places = [{at + j for j, c in enumerate(m) if c == "1"} for m in masks for at in range(n - len(m) + 1)]
    assert all(any(p.isdisjoint(differ) for p in places) for differ in combinations(range(n), n // 5))


def test_decontamination_short_items(spark):
    """Items of 5 to 12 words, with every set of words changed that the share allows, and one word more."""
    from itertools import combinations

    rng = np.random.default_rng(6)
    items = [[f"w{n}_{i}" for i in range(n)] for n in range(5, 13)]
    docs = [changed(rng, item, set(differ)) for item in items for k in range(len(item) // 5 + 2) for differ in list(combinations(range(len(item)), k))[: 66 if k <= len(item) // 5 else 3]]
    compare_leaks(spark, docs, items)


PAGE = '<html><head><title>t</title></head><body><nav><ul><li>menu</ul></nav><div class="side-bar sidebar"><p>side</p></div><div class="post-{0}"><h1>Head &amp; line</h1><p>One <b>two</b>three<br>four<p>five<ul><li>six<li>seven</ul><div class="ad x">ad</div><form>f</form><section class="comments"><p>reader</p></section><script>var a="</p>";</script></div><footer>&copy; foot</footer></body></html>'


def test_html(spark):
    rows = [(i, f"http://H.org/{i}", PAGE.replace("{0}", str(i)), "z") for i in range(6)]
    rows += [(10, None, None, "z"), (11, "", "", "z"), (12, "http://h.org/a?b", "<p>bare text", "z"), (13, "x", "<" * 2000 + "<p><b>&#233;t&eacute", "z"), (14, "x", "<div>" * 3000 + "deep", "z"), (0, "http://H.org/0", PAGE, "z")]
    got = {}
    for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect():
        got.setdefault(r.page_id, []).append(r)
        assert r.n_chars == len(r.text)
    assert len(got[0]) == 2 and all(got[i][0].text == "Head & line One twothree four five six seven" for i in range(6))
    assert [got[i][0].text for i in (10, 11, 12, 14)] == ["", "", "bare text", "deep"] and got[13][0].text.endswith("été")
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_marks():
    """Names made of marks and neutral words are left out; names that only contain a mark are the page's own."""
    page = lambda name: html_text.Page(f'<div><p>text<div class="{name}">block</div></div>').blocks
    for name in ("ad", "related-posts", "x sidebar-left", "cookie_notice", "comment-list item", "shareButtons share"):
        assert [t for _, t in page(name)] == ["text"]
    for name in ("related-work", "social-policy", "form-factor", "search-results", "rail-transport", "copyright-law", "story", ""):
        assert [t for _, t in page(name)] == ["text", "block"]


def test_html_nesting_time():
    """Deep nesting and end tags without a start take time in proportion to the page."""
    import time

    def took(n):
        source = "<div>" * n + "x" + "</section></p></table>" * n + "<li>y" + "<tr>" * n
        began = time.process_time()
        assert [t for _, t in html_text.Page(source).blocks] == ["x", "y"]
        return time.process_time() - began

    took(500)
    assert took(16_000) < 20 * max(took(2_000), 0.02)


@pytest.mark.parametrize("broadcast", [0, html_text.BROADCAST_ROWS])
def test_html_many_templates(spark, monkeypatch, broadcast):
    """On a host of 30 templates the vote for each holds, also on its pages whose own best container is another one."""
    monkeypatch.setattr(html_text, "BROADCAST_ROWS", broadcast)
    names = [a + b for a in "abcdef" for b in "klmno"]
    page = '<html><body><div class="t{0}"><p>main text of {0}</div><div class="more{0}"><p>{1}</div></body></html>'
    rows = [(i * 10 + j, None if i % 2 else "odd", page.format(n, "x" if j < 3 else "a much longer text than the main text has")) for i, n in enumerate(names) for j in range(4)]
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = {i * 10 + j: f"main text of {n}" for i, n in enumerate(names) for j in range(4)}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_html_pages(spark):
    for r in QUERIES["op7_html_text"](spark, SF).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        import html
        import re

        inner = r.html.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        inner = re.sub(r"</?b>", "", inner)
        assert r.text == " ".join(" ".join(html.unescape(b).split()) for b in re.split(r"<[^>]*>", inner) if b.strip())


def check_packing(rows, texts, encode):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for group in by_sequence.values():
        at = 0
        for r in sorted(group, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SEQUENCE
    for doc_id, text in texts:
        ids = np.array([*encode(text or ""), 1], np.uint32)
        pieces = by_doc[doc_id, len(ids)]
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        assert sum(r.length for r in pieces) == len(ids) * sum(1 for d, t in texts if (d, t) == (doc_id, text))
    return by_sequence


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary()[0])
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    texts = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    whole = check_packing(QUERIES["op3_packing"](spark, SF).collect(), texts, encode)
    used = [sum(r.length for r in g) for g in whole.values()]
    assert sum(map(packing.padded, used)) / sum(used) < 1.06
    odd = spark.createDataFrame(ODD, SCHEMA)
    for how in (vocabulary(), vocabulary()[:1]):
        check_packing(packing.pack(odd, *how).collect(), [(a, b) for a, b, _ in ODD], encode)
    assert packing.pack(odd.limit(0), *vocabulary()).count() == 0


def test_plan_covers_demand():
    rng = np.random.default_rng(5)
    for n in (1, 30, 3000):
        demand = {}
        for c in rng.integers(1, 257, n):
            demand[int(c)] = demand.get(int(c), 0) + 1
        held = {}
        for pattern, k in packing.plan(demand):
            assert sum(c * m for c, m in pattern.items()) <= packing.CLASSES
            for c, m in pattern.items():
                held[c] = held.get(c, 0) + m * k
        assert held == demand
    assert packing.plan({}) == []
