"""Text classifiers over bags of hashed character n-grams and words: learned embeddings, averaged, under a linear softmax.

Each n-gram (a word's ends count as a character) and, if asked, each word and each run of words has an embedding, found by its hash. A document's vector is the mean
of them, and a softmax layer over it gives the label. Embeddings and layer are trained together by stochastic gradient descent in
numpy, in one task, on a bounded sample of labelled rows. The mean and the layer are linear, so that for scoring an embedding shrinks to one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import give_back, map_batches, materialize, schema_of

_PRIME, _MIX = np.uint32(16777619), np.uint32(2654435769)
#: Code points worked on at once: what fits a core's cache; longer texts go through in pieces of this size.
PIECE = 1 << 17


@dataclass(frozen=True)
class Bag:
    """What a text's bag holds: character n-grams of these sizes, n-grams of up to so many words, case folded or not; hashed to 2 ** bits embeddings."""

    sizes: tuple[int, ...] = (3, 4, 5)
    words: int = 0
    fold: bool = True
    bits: int = 17


@dataclass(frozen=True)
class Training:
    """rows_a_class bounds the labelled rows of each class that are learned from, and megabytes the bags of all; the loss weighs classes as they are in all labels."""

    rows_a_class: int = 3000
    megabytes: int = 64
    width: int = 8
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7


def _space(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def _features(codes: np.ndarray, bag: Bag, at: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the features that begin in codes[at:end]; codes has white space at both ends."""
    n_max = max(bag.sizes)
    part = codes[at : min(len(codes), end + n_max - 1)]
    space = _space(part)
    count = end - at
    shift = np.uint32(32 - bag.bits)
    h = part[:count] * _PRIME
    solid = np.ones(count, bool)  # no white space inside so far
    for n in range(2, n_max + 1):
        m = min(count, len(part) - n + 1)
        if m <= 0:
            return
        h = (h[:m] ^ part[n - 1 : n - 1 + m]) * _PRIME
        if n > 2:
            solid = solid[:m] & ~space[n - 2 : n - 2 + m]
        else:
            solid = ~(space[:m] & space[1 : 1 + m])
        if n in bag.sizes:
            keep = np.flatnonzero(solid)
            g = h[keep]
            yield keep + at, (((g ^ (g >> np.uint32(15))) * _MIX) >> shift)


def _word_features(codes: np.ndarray, bag: Bag, owner) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text numbers, buckets) of the n-grams of words, which do not reach from text to text."""
    space = _space(codes)
    begins = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(begins):
        return
    place = np.arange(len(codes), dtype=np.uint32)
    start = np.zeros(len(codes), np.uint32)
    start[begins] = begins
    start = np.maximum.accumulate(start)
    mixed = (codes + _PRIME) * ((place - start + np.uint32(1)) * _MIX | np.uint32(1))
    mixed ^= mixed >> np.uint32(13)
    mixed[space] = 0
    word = np.add.reduceat(mixed * _PRIME, begins, dtype=np.uint32)
    whose, h = owner(begins), word
    for n in range(1, bag.words + 1):
        inside = whose[n - 1 :] == whose[: len(whose) - n + 1]
        if n > 1:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX + word[n - 1 :]
        yield whose[n - 1 :][inside], (((h ^ (h >> np.uint32(16))) * _MIX) >> np.uint32(32 - bag.bits))[inside]


def bags(texts: list[str | None], bag: Bag) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text numbers from there, buckets), a few texts at a time and a few features of them; a null text is empty."""
    i = 0
    while i < len(texts):
        group, total = [], 0
        while i + len(group) < len(texts) and (not group or total < PIECE):
            t = texts[i + len(group)] or ""
            t = t.lower() if bag.fold else t
            group.append(t)
            total += len(t) + 2
        codes = np.frombuffer("".join(f" {t} " for t in group).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum([0, *(len(t) + 2 for t in group)])
        owner = lambda at, starts=starts: np.searchsorted(starts, at, "right") - 1
        for a in range(0, len(codes), PIECE):
            for at, buckets in _features(codes, bag, a, min(len(codes), a + PIECE)):
                yield i, owner(at), buckets
        if bag.words:
            for whose, buckets in _word_features(codes, bag, owner):
                yield i, whose, buckets
        i += len(group)


def counted(text: str | None, bag: Bag) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct buckets and their counts."""
    found = [b for _, _, b in bags([text], bag)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def train(rows: list[tuple[np.ndarray, np.ndarray, int, float]], bag: Bag, how: Training) -> tuple[np.ndarray, float]:
    """Learn from (buckets, counts, label, weight) rows; return the number each embedding shrinks to, and the bias."""
    rng = np.random.default_rng(how.seed)
    table = rng.uniform(-0.5 / how.width, 0.5 / how.width, (1 << bag.bits, how.width)).astype(np.float32)
    layer = rng.normal(0, 0.5, (how.width, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen, layer_seen, bias_seen = np.full(1 << bag.bits, 1e-8, np.float32), np.full(layer.shape, 1e-3, np.float32), np.full(2, 1e-3, np.float32)
    for epoch in range(how.epochs):
        rate = np.float32(how.rate * (1 - epoch / how.epochs))
        for k in rng.permutation(len(rows)):
            # made anew each time: the rows are most of what the driver holds
            buckets, counts, y, weight = rows[k]
            buckets, share = buckets.astype(np.int64), (counts / max(1, counts.sum())).astype(np.float32)
            rows_of = table[buckets]
            mean = share @ rows_of
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            p *= np.float32(weight)
            back = layer @ p
            # AdaGrad, one scale for each embedding: rare n-grams move as far as frequent ones
            seen[buckets] += (share * share) * np.float32(back @ back)
            table[buckets] = rows_of - (rate * share / np.sqrt(seen[buckets]))[:, None] * back
            g = np.outer(mean, p)
            layer_seen += g * g
            layer -= rate * g / np.sqrt(layer_seen)
            bias_seen += p * p
            bias -= rate * p / np.sqrt(bias_seen)
    return (table @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, bag: Bag, how: Training, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> tuple[np.ndarray, float]:
    """Learn from labels (id, label 0 or 1; others and nulls are ignored) of docs.

    An id with both labels is not learned from; equal rows of docs are one, and different texts of one id are rows of their own. Of each class the rows_a_class
    rows of least id hash are taken, ties by id and text hash, so the sample depends on ids and texts alone. Their texts are counted where they lie. Distinct
    buckets and counts, 6 bytes each, of the first rows that megabytes hold, a row of each class by turns, go to one task, which learns; the driver gets numbers
    and the finished model. Without rows of both classes every score is 0 or 1, as the class that there is says, or 0.5 if there is none.
    """
    both = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    clean = both.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    sizes = {r["y"]: r["count"] for r in clean.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return np.zeros(1 << bag.bits, np.float32), (30.0 if 1 in sizes else -30.0) if sizes else 0.0
    first = lambda df, *more: [df.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", *more).limit(how.rows_a_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    mark = F.xxhash64("text")
    # the ids first, at most 2 * rows_a_class of them, then as many of their rows
    chosen = F.broadcast(DataFrame.unionByName(*first(clean)))
    # written, so that the texts are read once for both classes, not by two tasks side by side
    rows = materialize(texts.join(chosen, "id").select("id", "y", mark.alias("mark")).distinct(), "marked")
    rows = F.broadcast(materialize(DataFrame.unionByName(*first(rows, "mark")), "labelled"))

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for i in range(batch.num_rows):
                b, c = counted(batch["text"][i].as_py(), bag)
                one = batch.slice(i, 1)
                # counts of 65,535 and more are so many
                data = b.astype(np.uint32).tobytes() + np.minimum(c, 65535).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([one["id"], one["mark"], one["y"], pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], ["id", "mark", "y", "size", "data"])

        return step

    named = texts.withColumn("mark", mark).join(rows, ["id", "mark"]).select("id", "mark", "y", "text")
    kind = clean.schema["id"].dataType.simpleString()
    counted_rows = map_batches(named, make, f"id {kind}, mark long, y int, size long, data binary").groupBy("id", "mark").agg(*(F.first(c).alias(c) for c in ("y", "size", "data")))
    kept = materialize(counted_rows.withColumn("place", F.xxhash64("id")), "bags")
    order: dict[int, list] = {0: [], 1: []}
    for r in kept.select("place", "id", "mark", "y", "size").orderBy("place", "id", "mark").collect():  # 2 * rows_a_class rows
        order[r["y"]].append(r)
    turns = sorted((i, y) for y in (0, 1) for i in range(len(order[y])))
    fits = np.cumsum([order[y][i]["size"] for i, y in turns]) <= how.megabytes << 20
    taken = {y: sum(1 for (_, x), ok in zip(turns, fits, strict=True) if ok and x == y) for y in (0, 1)}
    if not all(taken.values()):
        return np.zeros(1 << bag.bits, np.float32), float(np.log(sizes[1] / sizes[0]))
    weight = {y: (sizes[y] / sum(sizes.values())) / (taken[y] / sum(taken.values())) for y in (0, 1)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for place, i, mark, y, data in zip(*(batch[c].to_pylist() for c in ("place", "id", "mark", "y", "data")), strict=True):
                n = len(data) // 6
                rows.append(((place, i, mark), (np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint16, n, 4 * n), y, weight[y])))
        if rows:
            # the order of learning follows from ids and texts
            values, bias = train([x for _, x in sorted(rows, key=lambda r: r[0])], bag, how)
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()], pa.binary()), pa.array([bias], pa.float64())], ["values", "bias"])
        rows.clear()
        give_back()

    # at most megabytes of bags go to one task, and 4 << bits bytes come from it
    ends = {y: order[y][n - 1] for y, n in taken.items()}
    upto = [(F.col("y") == y) & (F.struct("place", "id", "mark") <= F.struct(F.lit(e["place"]).alias("place"), F.lit(e["id"]).alias("id"), F.lit(e["mark"]).alias("mark"))) for y, e in ends.items()]
    learned = kept.where(upto[0] | upto[1]).select("place", "id", "mark", "y", "data").repartition(1).mapInArrow(learn, "values binary, bias double").collect()[0]  # not first(), which would leave the worker amid its rows
    return np.frombuffer(learned["values"], np.float32), learned["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], bag: Bag, columns: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The named columns of docs and the probability of label 1, from whole texts; a text without features gets what the bias alone says."""
    values = docs.sparkSession.sparkContext.broadcast(model[0])  # 4 << bits bytes
    bias = model[1]
    kept = [c for c in columns if c != score_col]
    schema = f"{schema_of(docs.select(*kept))}, `{score_col}` double"
    source = docs.select(*kept, *([] if text_col in kept else [text_col]))

    def make():
        v = values.value

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n = batch.num_rows
            total, count = np.zeros(n), np.zeros(n)
            for first, owner, buckets in bags(batch[text_col].to_pylist(), bag):
                some = np.bincount(owner, v[buckets])
                total[first : first + len(some)] += some
                some = np.bincount(owner)
                count[first : first + len(some)] += some
            z = total / np.maximum(count, 1) + bias
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*kept, score_col])

        return step

    return map_batches(source, make, schema)
