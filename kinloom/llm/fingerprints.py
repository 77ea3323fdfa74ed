"""Document fingerprints: bottom-k sketches of word-shingle hashes, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of parts merge into
the sketch of the whole; two of them estimate resemblance and containment, and one the number of distinct shingles. Sketches of
fewer than k hashes hold all of them, and what is estimated from such is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import lower_words

#: Hashes kept; the standard error of a resemblance r is sqrt(r * (1 - r) / K), 0.044 at most.
K, WIDTH = 128, 5
#: Buckets of neighbouring ids, one for about each ROWS_A_BUCKET rows: up to BUCKETS by a compiled search, each cut into up to PARTS beyond.
BUCKETS, ROWS_A_BUCKET, PARTS = 1024, 1000, 64


def shingle_hashes(words: Column, width: int = WIDTH) -> Column:
    """A hash for each run of width words; a shorter text is one shingle as a whole, one without words has none."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    n = F.size(words)
    run = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(n - width, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(width))))
    # get() past the end is null, which xxhash64 skips: short texts hash all their words
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.element_at(F.transform(F.array(hashes), run), 1))


def sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(words, width))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; two empty sets are alike (1), an empty and another are not (0)."""
    # the one-element array binds the union's size and largest hash, which would else be made anew for each hash
    ends = F.transform(F.array(merged(a, b, k)), lambda both: F.struct(F.size(both).alias("n"), F.array_max(both).alias("top")))
    share = lambda end: F.when(end["n"] == 0, F.lit(1.0)).otherwise(F.size(F.filter(F.array_intersect(a, b), lambda h: h <= end["top"])) / end["n"])
    return F.element_at(F.transform(ends, share), 1)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated size of the shingle set: exact below k, else from how far up the k-th smallest hash lies."""
    unit = (F.array_max(a).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / unit)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 where a is empty."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(share, F.lit(1.0)))


def text_of(a: Column) -> Column:
    """A sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


#: Groups that merge_sketches deals a key's hashes to.
SALTS = 64


def merge_sketches(parts: DataFrame, keys: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch for each key. A hot key's hashes are first ranked in SALTS groups by hash, and of a task's only the k least of a group move."""
    salted = parts.select(*keys, F.explode(sketch_col).alias("hash")).withColumn("salt", F.pmod("hash", F.lit(SALTS)))
    few = salted.withColumn("rank", F.dense_rank().over(Window.partitionBy(*keys, "salt").orderBy("hash"))).where(F.col("rank") <= k)
    hashes = few.select(*keys, "salt", "hash").distinct().drop("salt")
    least = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("rank") <= k)
    filled = least.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(sketch_col))
    empty = parts.select(*keys).distinct()
    same = [empty[c].eqNullSafe(filled[c]) for c in keys]
    return empty.join(filled, same, "left").select(*(empty[c] for c in keys), F.coalesce(filled[sketch_col], F.array().cast("array<bigint>")).alias(sketch_col))


def _parts(rows: DataFrame, place: Column, n: int) -> DataFrame:
    """(bucket, cuts): up to n - 1 ids at which a bucket is cut further; at most BUCKETS rows of PARTS numbers. Ids alone are read."""
    shares = [i / n for i in range(1, n)]
    return rows.where(F.col("id").isNotNull()).groupBy(place.alias("bucket")).agg(F.array_distinct(F.percentile_approx("id", shares, 100 * n)).alias("cuts"))


def _bucket(id_col: Column, bounds: list[int], first: int = 0) -> Column:
    """Which of the ranges that end at bounds (inclusive) an id lies in, by a search tree that is compiled."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(id_col <= bounds[mid], _bucket(id_col, bounds[:mid], first)).otherwise(_bucket(id_col, bounds[mid + 1 :], first + mid + 1))


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness and that to the next document.

    The edited text's last floor(n_chars / 2) code points are the first as many of the next document, by descending id, after the
    last the first. Null ids come last, rows of one id in the order of their texts, repeated rows one after another. Null and empty
    texts have no shingles and an empty fingerprint. Other columns are dropped.

    Neighbours meet without a global sort: ids are cut at approximate quantiles into buckets, each bucket also gets the rows of the
    largest id of the bucket below it (of the whole, for the lowest), and a window runs within each bucket. Texts are shuffled once.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    seen = rows.agg(F.count(F.lit(1)), F.max("id"), F.percentile_approx("id", shares, 10 * BUCKETS)).first()
    n, largest, quantiles = seen[0], seen[1], sorted(set(seen[2] or []))
    step = max(1, -(-len(quantiles) // max(1, min(BUCKETS, n // ROWS_A_BUCKET))))
    bounds = [q for q in quantiles[step - 1 :: step] if q != largest] if n // ROWS_A_BUCKET > 1 else []
    parts = min(PARTS, -(-n // (BUCKETS * ROWS_A_BUCKET)))
    coarse = F.when(F.col("id").isNull(), 0).otherwise(_bucket(F.col("id"), bounds))
    last = F.col("id").eqNullSafe(largest)
    if parts > 1:
        # place: PARTS for each bucket, then how many of its cuts lie below the id; a part's largest id is a cut or a bucket's bound
        cuts = F.broadcast(_parts(rows, coarse, parts).withColumnRenamed("bucket", "coarse"))
        rows = rows.withColumn("coarse", coarse).join(cuts, "coarse", "left")
        within = F.when(F.col("id").isNull(), 0).otherwise(F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("id"))), F.lit(0)))
        rows = rows.select("id", "text", (F.col("coarse") * PARTS + within).alias("place"), F.coalesce(F.array_contains("cuts", F.col("id")), F.lit(False)).alias("cut"))
    else:
        rows = rows.select("id", "text", coarse.alias("place"), F.lit(False).alias("cut"))
    own = rows.select("id", "text", F.col("place").alias("bucket"), F.lit(False).alias("guest"))
    edge = F.col("id").isin(bounds) if bounds else F.lit(False)
    ends = rows.where(last | edge | F.col("cut"))
    # above a bucket's bound the next bucket begins, above a cut the next part of the bucket
    above = F.when(last, 0).when(edge, (F.floor(F.col("place") / PARTS) + 1) * PARTS if parts > 1 else F.col("place") + 1).otherwise(F.col("place") + 1)
    guests = ends.select("id", "text", above.cast("int").alias("bucket"), F.lit(True).alias("guest"))
    # the same rows in each bucket are together from here on: the window below needs no further shuffle
    dealt = own.unionByName(guests).repartition("bucket").withColumn("words", lower_words(F.col("text"))).withColumn("sketch", sketch(F.col("words"), k, width)).drop("words")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), "text")
    paired = dealt.withColumns({"next_text": F.lead("text").over(order), "next_sketch": F.lead("sketch").over(order)}).where(~F.col("guest"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    scored = paired.withColumn("edited", edited).withColumn("words", lower_words(F.col("edited"))).withColumn("edited_sketch", sketch(F.col("words"), k, width))
    return scored.select(
        F.col("id").alias(id_col), F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        text_of(F.col("sketch")).alias("fingerprint"), text_of(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("distinct_estimate"), containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
    )
