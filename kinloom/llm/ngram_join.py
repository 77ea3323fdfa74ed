"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, bit counts as an upper bound, exact sorted-array intersection.

Equal sets are one class from the start. Two linked sets of sizes a <= b differ in at most d = (a + b) * (1 - t) / (1 + t) shingles. The sizes
are cut into bands; a tile holds what a band's sets can link with, and splits shingles by hash into m > d segments, of which linked sets share
m - d whole. Ordered by what they hold, most shingles first, the first d + 1 segments of either set then have a shared one among them, so only these
stand for a set and the emptiest, which unrelated sets share, do not. Sets meet in a tile through a segment's hash, never all with all. There,
bitmaps bound the overlap from above: each bit in which two differ is a shingle in one of them only. What passes is intersected exactly.

A segment's sets first compare with one of them, the one that meets most others, and components form; only sets still apart are compared among
each other. Groups of copies therefore cost a comparison for each, not for each pair. Sets are compared by 64-bit hashes of shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import map_batches, materialize, schema_of, unused

#: Upper bound of a band's sizes over its lower bound.
BAND = 1.4
#: Segments of a tile: this many times those that stand for a set, and so many more; and the least similarity that leaves no empty one among these.
SPARE, MORE, LEAST_SHARE = 1.25, 6, 0.7
#: Bits of a bitmap: a power of two, this many for each shingle at least, and so many at least.
BITS_A_SHINGLE, LEAST_BITS = 4, 1024
#: Sets of a segment that one task compares with each other; larger segments are dealt out as pairs of such blocks.
BLOCK = 2000
#: Ids up to which a list is broadcast (16 bytes each); beyond, both sides are shuffled.
BROADCAST_IDS = 500_000
#: Words whose hashes a task remembers, and keys whose signatures it has given out.
CACHE = 200_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Likeness:
    """Sets of shingles of width words link when den * |intersection| >= num * |union|."""

    width: int = 5
    num: int = 4
    den: int = 5

    def __post_init__(self) -> None:
        if not LEAST_SHARE * self.den <= self.num <= self.den or self.width < 1:
            raise ValueError(f"links need a similarity from {LEAST_SHARE} to 1 and a width of a word at least")

    def differing(self, a: int, b: int) -> int:
        """In how many shingles linked sets of these sizes differ at most."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _B
    h = (h ^ (h >> np.uint64(27))) * _C
    return h ^ (h >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < CACHE:  # the frequent ones come first
            self[word] = h
        return h


def shingle_set(text: str | None, width: int, words: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles: A-Z lower-cased, words between ASCII white space; fewer words than width are one shingle."""
    split = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    with np.errstate(over="ignore"):
        n = len(h) - width + 1
        if n < 1:
            out = np.full(1, len(h), np.uint64)
            for x in h:
                out = _mix(out * _A + x)
            return out
        out = np.full(n, width, np.uint64)
        for i in range(width):
            out = _mix(out * _A + h[i : i + n])
    return np.unique(out)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Each hash sets the bit of its lowest bits; larger sets have more bits, so that they do not fill up."""
    size = max(LEAST_BITS, 1 << (BITS_A_SHINGLE * len(hashes) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    bits[(hashes & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def _folded(bitmaps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with fewer words."""
    return np.bitwise_or.reduce(bitmaps.reshape(len(bitmaps), -1, words), axis=1)


def bands(most: int) -> list[int]:
    """The bands' lower bounds, up to one above most."""
    found = [1]
    while found[-1] <= most:
        found.append(max(found[-1] + 1, int(np.ceil(found[-1] * BAND))))
    return found


def tiles(n: int, how: Likeness) -> list[tuple[int, int, int]]:
    """(tile, segments, how many of them stand for it) where a set of n shingles is: its own band's tile, and those of bands below that its partners reach.

    A tile is of the smaller set's band. Its segments follow from the band; those that stand for a set are one more than it and a partner there can differ in.
    """
    lows = bands(n)
    found = []
    for k in range(len(lows) - 2, -1, -1):
        upper = lows[k + 1] - 1
        if n > upper and how.num * n > how.den * upper:
            break
        most = how.differing(upper, upper * how.den // how.num) + 1
        own = how.differing(n, n * how.den // how.num if n <= upper else upper) + 1
        found.append((k, int(np.ceil(most * SPARE)) + MORE, own))
    return found


def signatures(hashes: np.ndarray, how: Likeness) -> np.ndarray:
    """Numbers for the segments that stand for a set in each of its tiles: equal where the sets' parts in the segment are equal."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_mix(hashes + _A), out=sums[1:])
        found = []
        for tile, m, own in tiles(len(hashes), how):
            # the hashes are sorted, so a segment is a run of them
            place = ((hashes >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            edges = np.searchsorted(place, np.arange(m + 1, dtype=np.uint64))
            part, count = sums[edges[1:]] - sums[edges[:-1]], np.diff(edges)
            all_ = _mix(_mix(part * _A + count.astype(np.uint64)) + np.arange(m, dtype=np.uint64) * _B + np.full(1, tile, np.uint64) * _C)
            found.append(all_[np.lexsort((all_, -count))[:own]])
    return np.concatenate(found)


def _linked(a: np.ndarray, b: np.ndarray, how: Likeness) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[at] == a).sum())
    return how.den * common >= how.num * (len(a) + len(b) - common)


def _may_link(na: np.ndarray, nb: np.ndarray, differing: np.ndarray, how: Likeness) -> np.ndarray:
    """Whether the overlap that sizes and differing bits allow is enough."""
    common = np.minimum(np.minimum(na, nb), (na + nb - differing) // 2)
    return how.den * common >= how.num * (na + nb - common)


def _key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _described(docs: DataFrame, how: Likeness) -> DataFrame:
    """(id, key, n, signatures) for each row; the key stands for the set (0 shingles: null). A task gives a key's signatures once."""

    def make():
        words, given = _Words(), set()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keys, sizes, found = [], [], []
            for text in batch["text"]:
                s = shingle_set(text.as_py(), how.width, words)
                key = _key(s) if len(s) else None
                keys.append(key)
                sizes.append(len(s))
                fresh = key is not None and key not in given
                if fresh:
                    if len(given) > CACHE:
                        given.clear()
                    given.add(key)
                found.append(signatures(s, how).view(np.int64) if fresh else [])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "key", "n", "signatures"])

        return step

    return map_batches(docs, make, "id long, key long, n long, signatures array<long>")


def _bitmaps(docs: DataFrame, how: Likeness) -> DataFrame:
    """(key, n, bits) for each row with shingles."""

    def make():
        words = _Words()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            rows = [s for s in (shingle_set(t.as_py(), how.width, words) for t in batch["text"]) if len(s)]
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in rows], pa.int64()), pa.array([len(s) for s in rows], pa.int64()), pa.array([bitmap(s).tobytes() for s in rows], pa.binary())], ["key", "n", "bits"])

        return step

    return map_batches(docs.select("text"), make, "key long, n long, bits binary")


def _sets(docs: DataFrame, how: Likeness) -> DataFrame:
    """(key, hashes) for each row with shingles."""

    def make():
        words = _Words()

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for text in batch["text"]:
                if len(s := shingle_set(text.as_py(), how.width, words)):
                    yield pa.RecordBatch.from_arrays([pa.array([_key(s)], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["key", "hashes"])

        return step

    return map_batches(docs.select("text"), make, "key long, hashes binary")


def _differing(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits each pair of bitmaps differs, at the smaller one's size."""
    out = np.zeros(len(a), np.int64)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        shapes.setdefault((len(x) // 8, len(y) // 8), []).append(i)
    for (x, y), rows in shapes.items():
        left = np.frombuffer(b"".join([a[i] for i in rows]), np.uint64).reshape(-1, x)
        right = np.frombuffer(b"".join([b[i] for i in rows]), np.uint64).reshape(-1, y)
        out[rows] = np.bitwise_count(_folded(left, min(x, y)) ^ _folded(right, min(x, y))).sum(axis=1, dtype=np.int64)
    return out


def _both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    one = pairs.join(table.select(F.col("key").alias("a"), *columns), "a")
    return one.join(table.select(F.col("key").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns)), "b")


def _bounded(pairs: DataFrame, bitmaps: DataFrame, how: Likeness) -> DataFrame:
    """The (a, b) pairs of keys whose sizes and bitmaps allow a link."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            n, m = (batch[c].to_numpy(zero_copy_only=False) for c in ("n", "n_b"))
            keep = _may_link(n, m, _differing(batch["bits"].to_pylist(), batch["bits_b"].to_pylist()), how)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep))

        return step

    return map_batches(_both(pairs, bitmaps, "n", "bits").select("a", "b", "n", "n_b", "bits", "bits_b"), make, "a long, b long")


def _confirmed(pairs: DataFrame, rows: DataFrame, ids: DataFrame, how: Likeness, broadcast_ids: int) -> DataFrame:
    """The (a, b) pairs that link by their whole sets; only the sets that pairs name are made and moved."""

    def make():
        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            keep = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), how) for x, y in zip(batch["hashes"], batch["hashes_b"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return step

    named = materialize(ids.join(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "key", "left_semi"), "named")
    sets = materialize(_sets(_texts_of(rows, named, broadcast_ids), how).join(named.select("key"), "key", "left_semi").dropDuplicates(["key"]), "sets")
    return map_batches(_both(pairs, sets, "hashes").select("a", "b", "hashes", "hashes_b"), make, "a long, b long")


def _texts_of(rows: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """The rows that have one of the ids."""
    chosen = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    return rows.join(chosen.select(F.col("id").alias("chosen")).distinct(), F.col("id").eqNullSafe(F.col("chosen")), "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(key, label): the least key that the (a, b) links reach, by minimum labels and pointer jumping; nodes without links have no row."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "key").select("key", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        top = labels.select(F.col("key").alias("label"), F.col("label").alias("further"))
        jumped = moved.join(top, "label", "left").select("key", F.least("label", F.coalesce("further", "label")).alias("label"), F.col("was"))
        done = materialize(jumped, "labels")
        labels = done.select("key", "label")
        if done.where("label <> was").isEmpty():
            return labels


def _apart(members: DataFrame, how: Likeness) -> DataFrame:
    """(a, b): pairs in a segment (sig, block pair) that have different labels and whose sizes and bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pairs(t: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            key, n, label, own = (t[c].to_numpy(zero_copy_only=False) for c in ("key", "n", "label", "own"))
            raw = t["bits"].to_pylist()
            words = min(map(len, raw)) // 8
            bits = np.concatenate([_folded(np.frombuffer(x, np.uint64)[None], words) for x in raw])
            left, right = np.flatnonzero(own <= 0), np.flatnonzero(own >= 0)  # own: -1 left block, 1 right block, 0 both
            for i in left:
                j = right[(label[right] != label[i]) & ((own[i] != 0) | (right > i))]
                if len(j):
                    near = j[_may_link(n[i], n[j], np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1, dtype=np.int64), how)]
                    if len(near):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(key[i], key[near])), pa.array(np.maximum(key[i], key[near]))], ["a", "b"])

        def tile(b: pa.RecordBatch, i: int) -> tuple:
            return b["sig"][i].as_py(), b["left"][i].as_py(), b["right"][i].as_py()

        for batch in batches:
            at = 0
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in ("sig", "left", "right"):
                v = batch[c].to_numpy(zero_copy_only=False)
                change |= v[1:] != v[:-1]
            for end in [*(np.flatnonzero(change) + 1).tolist(), batch.num_rows]:
                part = batch.slice(at, end - at)
                if not part.num_rows:
                    continue
                if held and tile(held[0], 0) != tile(part, 0):
                    yield from pairs(pa.concat_batches(held))
                    held = []
                held.append(part)
                at = end
        if held:
            yield from pairs(pa.concat_batches(held))

    blocks = F.floor((F.row_number().over(Window.partitionBy("sig").orderBy("n", "key")) - 1) / BLOCK).cast("int")
    dealt = members.withColumn("block", blocks).withColumn("blocks", F.floor((F.count(F.lit(1)).over(Window.partitionBy("sig")) - 1) / BLOCK).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), "blocks")))
    own = F.when(F.col("block") < F.col("other"), -1).when(F.col("block") > F.col("other"), 1).otherwise(0)
    tiled = dealt.select("sig", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), own.alias("own"), "key", "n", "label", "bits")
    return tiled.repartition("sig", "left", "right").sortWithinPartitions("sig", "left", "right").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, how: Likeness, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """One row per input row: id, key (of its set, null without shingles), n_shingles, label (least key that links reach, null without shingles).

    Null, empty and blank texts have no shingles and link with nothing. Null ids and repeated rows are kept; other columns are dropped. Every link between
    different sets that exists is found; no bound on partners, candidates or group sizes is set.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    described = materialize(_described(rows, how), "described")
    spread = described.select("key", "n", F.explode("signatures").alias("sig"))
    by_sig = Window.partitionBy("sig")
    met = spread.withColumns({"least": F.min("key").over(by_sig), "most": F.max("key").over(by_sig)}).where(F.col("least") < F.col("most")).dropDuplicates(["sig", "key"])
    members = materialize(met.withColumn("size", F.count(F.lit(1)).over(by_sig)).select("sig", "key", "n", "size"), "members")
    weights = members.groupBy("key").agg(F.sum("size").alias("weight"))
    wanted = described.join(weights.select("key"), "key", "left_semi").groupBy("key").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("first")).select("key", F.col("first.id").alias("id"))
    ids = materialize(wanted, "wanted")
    bitmaps = materialize(_bitmaps(_texts_of(rows, ids, broadcast_ids), how).join(ids.select("key"), "key", "left_semi").dropDuplicates(["key"]), "bitmaps")
    ranked = members.join(weights, "key").withColumn("pivot", F.max(F.struct("weight", "key", "n")).over(by_sig))
    sized = (how.den * F.least("n", "pivot.n") >= how.num * F.greatest("n", "pivot.n")) & (F.col("key") != F.col("pivot.key"))
    first = ranked.where(sized).select(F.least("key", "pivot.key").alias("a"), F.greatest("key", "pivot.key").alias("b")).distinct()
    near = materialize(_bounded(first, bitmaps, how), "near")
    links = materialize(_confirmed(near, rows, ids, how, broadcast_ids), "links")
    labels = components(links)
    # segments whose sets are not yet one component: all that are apart are compared
    labelled = members.where("size > 2").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    open_ = labelled.withColumns({"least": F.min("label").over(by_sig), "most": F.max("label").over(by_sig)}).where(F.col("least") < F.col("most"))
    more = _apart(open_.join(bitmaps.select("key", "bits"), "key").select("sig", "key", "n", "label", "bits"), how).distinct()
    apart = materialize(more, "apart")
    second = materialize(_confirmed(apart, rows, ids, how, broadcast_ids), "links") if not apart.isEmpty() else None
    if second is not None and not second.isEmpty():
        labels = components(links.unionByName(second))
    return described.join(labels, "key", "left").select(F.col("id").alias(id_col), "key", F.col("n").alias("n_shingles"), F.coalesce("label", "key").alias("label"))


def linked_components(docs: DataFrame, how: Likeness, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id that links reach; its own id without shingles)."""
    rows = classes(docs, how, id_col, text_col)
    least = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(id_col).alias("least"))
    return rows.join(least, "label", "left").select(id_col, "n_shingles", F.when(F.col("label").isNull(), F.col(id_col)).otherwise(F.col("least")).alias("component_id"))


def one_of_each(docs: DataFrame, how: Likeness, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """docs with one row of each component, that of the least id (nulls last); rows without shingles all stay, and so do all other columns, whatever their names."""
    rows = materialize(classes(docs.select(id_col, text_col), how, id_col, text_col).withColumnRenamed(id_col, "id"), "classes")
    rank = F.struct(F.col("id").isNull().alias("no_id"), "id", "key")
    best = rows.where(F.col("label").isNotNull()).groupBy("label").agg(F.min(rank).alias("best"))
    judged = rows.where(F.col("label").isNotNull()).join(best, "label")
    gone_id, gone_key, set_key = (unused(docs.columns, c) for c in ("gone", "gone_key", "set_key"))
    out = judged.where(~(F.col("id").eqNullSafe(F.col("best.id")) & (F.col("key") == F.col("best.key")))).select(F.col("id").alias(gone_id), F.col("key").alias(gone_key)).distinct()
    twice = judged.groupBy("id", "key").count().where("count > 1").select(F.col("id").alias(gone_id)).distinct()
    out, twice = materialize(out, "gone"), materialize(twice, "twice")

    def with_key(batch_docs: DataFrame) -> DataFrame:
        columns = batch_docs.columns

        def make():
            words = _Words()

            def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
                found = [shingle_set(t.as_py(), how.width, words) for t in batch[text_col]]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_key(s) if len(s) else None for s in found], pa.int64())], [*columns, set_key])

            return step

        return map_batches(batch_docs, make, f"{schema_of(batch_docs)}, {set_key} long")

    gone = F.broadcast(out) if out.count() <= broadcast_ids else out
    # rows whose id has no row to drop pass without their sets being made again
    suspects = out.select(gone_id).unionByName(twice).distinct()
    suspects = F.broadcast(suspects) if suspects.count() <= broadcast_ids else suspects
    same_id = F.col(id_col).cast("long").eqNullSafe(F.col(gone_id))
    clear, doubtful = docs.join(suspects, same_id, "left_anti"), docs.join(suspects, same_id, "left_semi")
    kept = with_key(doubtful).join(gone, same_id & F.col(set_key).eqNullSafe(F.col(gone_key)), "left_anti")
    if not twice.isEmpty():
        kept = kept.where(F.col(set_key).isNotNull()).dropDuplicates([id_col, set_key]).unionByName(kept.where(F.col(set_key).isNull()))
    return clear.unionByName(kept.drop(set_key))
