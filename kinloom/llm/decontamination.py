"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A seed is a mask over a run of words that ignores some of its positions, so a hit survives substitutions there. All masks are hashed
at every word of the documents and of the benchmark; equal hashes give (document, item, diagonal) candidates, and on each diagonal
the words are compared one by one around the hits.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import lower_words, materialize

#: Fixed masks: 1 looks at a word, 0 ignores it. One of them fits wherever 8 words or more have the share (by enumeration; tested).
MASKS = ("1101011", "11001101", "11111")
#: An overlap counts from so many words (all of a shorter item), of which this share is equal.
MIN_WORDS, MIN_SHARE = 13, 0.8
#: Rows of a join's smaller side up to which it is broadcast (under 50 bytes each); beyond, both sides are shuffled.
BROADCAST_ROWS = 500_000


def _share() -> Fraction:
    return Fraction(MIN_SHARE).limit_denominator(1000)


def _short_masks(n: int) -> list[str]:
    """Masks over all of an item of n words: one for each largest set of words that may differ and that no fixed mask gets around."""
    masks = ("".join("0" if i in differ else "1" for i in range(n)) for differ in combinations(range(n), n - ceil(_share() * n)))
    return [whole for whole in masks if not any(all(c <= w for c, w in zip(mask, whole[at:], strict=False)) for mask in MASKS for at in range(n - len(mask) + 1))]


def _seeds(rows: DataFrame, id_col: str, words: str, short: list[str], whole: bool) -> DataFrame:
    """(id, at, seed) for each mask at each word where it fits; whole: short masks are for all words of a row or none.

    Words are exploded first and masks look ahead in the array, so that all of this is compiled code and not a function called for each word.
    """
    at, n = F.col("at"), F.size(words)
    found = []
    for k, mask in enumerate([*MASKS, *short]):
        looks = [F.get(F.col(words), at + j) for j, c in enumerate(mask) if c == "1"]
        fits = (at == 0) & (n == len(mask)) if whole and k >= len(MASKS) else at <= n - len(mask)
        found.append(F.when(fits, F.xxhash64(F.lit(k), *looks)))
    each = rows.select(id_col, words, F.posexplode(words).alias("at", "word"))
    return each.select(id_col, "at", F.explode(F.array(*found)).alias("seed")).where(F.col("seed").isNotNull())


def _best_run(doc: Column, item: Column, diagonal: Column) -> Column:
    """The stretch of a diagonal with the largest sum among those of enough words, where equal words count 1 and others -share / (1 - share).

    Both are scaled to whole numbers, so a stretch has the share just if its sum is not negative; best is negative if no stretch has it.
    """
    low, high = F.greatest(F.lit(0), -diagonal), F.least(F.size(item), F.size(doc) - diagonal) - 1
    least = F.least(F.lit(MIN_WORDS), F.size(item))
    share = _share()
    equal = lambda p: (F.get(doc, p + diagonal) == F.get(item, p)).cast("int")
    total = lambda same, words: share.denominator * same - share.numerator * words
    # same: equal words so far; from_same: those before the last start that leaves enough words; low_*: the start of the least sum up to there.
    zero = F.struct(*(F.lit(v).cast("int").alias(n) for n, v in (("same", 0), ("from_same", 0), ("low", None), ("low_at", 0), ("low_same", 0), ("best", -1), ("best_start", 0), ("best_end", 0), ("best_same", 0))))

    def step(s: Column, p: Column) -> Column:
        start = p + 1 - least
        same = s["same"] + equal(p)
        from_same = F.when(start > low, s["from_same"] + equal(start - 1)).otherwise(s["from_same"])
        at_start = total(from_same, start - low)
        lower = (start >= low) & (s["low"].isNull() | (at_start <= s["low"]))
        pick_low = lambda new, old: F.when(lower, new).otherwise(old)
        now = total(same, p + 1 - low) - pick_low(at_start, s["low"])
        better = now > s["best"]
        pick = lambda new, old: F.when(better, new).otherwise(old)
        return F.struct(
            same.alias("same"), from_same.alias("from_same"), pick_low(at_start, s["low"]).alias("low"), pick_low(start, s["low_at"]).alias("low_at"), pick_low(from_same, s["low_same"]).alias("low_same"),
            pick(now, s["best"]).alias("best"), pick(pick_low(start, s["low_at"]), s["best_start"]).alias("best_start"), pick(p + 1, s["best_end"]).alias("best_end"),
            pick(same - pick_low(from_same, s["low_same"]), s["best_same"]).alias("best_same"),
        )

    return F.aggregate(F.when(high + 1 - low >= least, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>")), zero, step)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each document and benchmark item that overlap: the ids, key, the words [doc_start, doc_end) and [item_start, item_end) of the overlap with most equal words, and matched.

    An overlap has MIN_WORDS words or more (or all words of a shorter item), MIN_SHARE of them equal; texts are lower-cased and words
    stand between ASCII white space. Null and empty texts on either side overlap with nothing. Documents are told apart by key, a
    hash of id and text, so a null id is kept and repeated rows give one row. Other columns are dropped.
    """
    hashes = lambda c: F.transform(lower_words(c), lambda w: F.xxhash64(w))
    texts = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("key"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_col), F.col(item_text)).alias("item_key"), hashes(F.col(item_text)).alias("item_words"))
    items = items.where(F.size("item_words") > 0).dropDuplicates(["item_key"])
    lengths = [r[0] for r in items.where(F.size("item_words") < MIN_WORDS).select(F.size("item_words")).distinct().collect()]  # a few numbers
    short = [mask for n in sorted(lengths) for mask in _short_masks(n)]
    targets = _seeds(items, "item_key", "item_words", short, True).withColumnRenamed("at", "item_at")
    if targets.count() <= broadcast_rows:
        targets = F.broadcast(targets)
    seeds = _seeds(texts.select("key", hashes(F.col("text")).alias("h")), "key", "h", short, False)
    hits = materialize(seeds.join(targets, "seed").groupBy("key", "item_key").agg(F.collect_set(F.col("at") - F.col("item_at")).alias("diagonals")), "hits")
    found = hits.select("key").distinct()
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    near = texts.join(found, "key", "left_semi").dropDuplicates(["key"]).select("doc", "key", hashes(F.col("text")).alias("h"))
    aligned = hits.join(near, "key").join(items, "item_key").withColumn("d", F.explode("diagonals")).withColumn("run", _best_run(F.col("h"), F.col("item_words"), F.col("d")))
    words = F.col("run.best_end") - F.col("run.best_start")
    best = aligned.where(F.col("run.best") >= 0).groupBy("key", "item_key").agg(F.max(F.struct(F.col("run.best_same").alias("matched"), (-F.col("d")).alias("d"), words.alias("words"), F.col("run.best_start").alias("start"), "doc", "item")).alias("b"))
    return best.select(
        F.col("b.doc").alias(id_col), F.col("b.item").alias(item_col), "key", (F.col("b.start") - F.col("b.d")).cast("long").alias("doc_start"), (F.col("b.start") - F.col("b.d") + F.col("b.words")).cast("long").alias("doc_end"),
        F.col("b.start").cast("long").alias("item_start"), (F.col("b.start") + F.col("b.words")).cast("long").alias("item_end"), F.col("b.matched").cast("long").alias("matched"),
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The documents that overlap with no benchmark item, as they came, with all their columns."""
    bad = materialize(leaks(docs.select(id_col, text_col), benchmark, id_col, text_col, broadcast_rows=broadcast_rows).select("key").distinct(), "leaks")
    if bad.count() <= broadcast_rows:
        bad = F.broadcast(bad)
    return docs.join(bad, F.xxhash64(docs[id_col], docs[text_col]) == bad["key"], "left_anti")
