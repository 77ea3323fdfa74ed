"""Packing documents into fixed-length sequences as a cutting-stock problem solved by column generation.

A document's token ids are cut into full sequences and a remainder. The remainders' lengths, rounded up to units, form a histogram of a
few hundred classes. A linear program over patterns (how many pieces of each class share a sequence) covers it with the fewest sequences;
a knapsack dynamic program finds the pattern that the current prices favour most, until none is worth adding. Pattern counts are rounded
down, first-fit-decreasing patterns take what is left, and each class's ranked pieces fill its slots.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import map_batches, materialize

SEQUENCE, UNIT, END_ID = 2048, 8, 1
CLASSES = SEQUENCE // UNIT
#: The linear program ends at this share above its lower bound, or after so many columns; what is packed is right at any point.
GAP, COLUMNS = 2e-4, 3000
#: Rows that one task ranks, about.
ROWS_A_RANK = 200_000
#: Chunks whose ids a task remembers.
CACHE = 150_000
_TWO_SPACES = re.compile(r"\s\s")


def added_tokens(vocabulary: str) -> list[str]:
    """The texts of the added tokens of a tokenizers file, without its model."""
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    key = '"added_tokens"'
    tokens, _ = json.JSONDecoder().raw_decode(text[text.index(key) + len(key) :].lstrip(" \t\r\n:"))
    return [t["content"] for t in tokens]


def encoder(vocabulary: str, ranks: str | None = None, pattern: str | None = None) -> Callable[[list[str]], list[bytes]]:
    """From texts to their ids as little-endian unsigned 32-bit numbers, as tokenizers gives them with add_special_tokens=False.

    With ranks (the same vocabulary for tiktoken) and its pattern, texts are cut before single spaces, where the pattern always begins a new
    word; each distinct chunk is encoded once and remembered. Texts with runs of white space or special tokens go through tokenizers whole,
    whose model is read when the first of them comes: it would take 40 MB of every worker.
    """

    @lru_cache(1)
    def whole():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(vocabulary)

    pack = lambda ids: np.array(ids, np.uint32).tobytes()
    if ranks is None:
        return lambda texts: [pack(e.ids) for e in whole().encode_batch(texts, add_special_tokens=False)]
    import tiktoken

    specials = added_tokens(vocabulary)

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary

    class Chunks(dict):
        def __missing__(self, chunk: str) -> bytes:
            ids = pack(quick(" " + chunk))
            if len(self) < CACHE:  # the frequent ones come first
                self[chunk] = ids
            return ids

    known = Chunks()

    def encode(text: str) -> bytes:
        if _TWO_SPACES.search(text) or any(s in text for s in specials):
            return pack(whole().encode(text, add_special_tokens=False).ids)
        first, *rest = text.split(" ")
        return pack(quick(first)) + b"".join([known[c] for c in rest])

    return lambda texts: [encode(t) for t in texts]


def cut(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, doc_tokens, crcs): for each row its tokens with the end and the checksums of its full pieces and, if any, its remainder."""

    def make():
        encode = encoder(vocabulary, ranks, pattern)
        end, size = np.array([END_ID], np.uint32).tobytes(), 4 * SEQUENCE

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            tokens, crcs = [], []
            for text in batch["text"]:
                ids = encode([text.as_py()])[0] + end
                tokens.append(len(ids) // 4)
                crcs.append([zlib.crc32(ids[i : i + size]) for i in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], ["id", "doc_tokens", "crcs"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, make, "id long, doc_tokens long, crcs array<long>")


def price(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """The knapsack: which sizes, as often as wanted, give the most value within room; by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        n = np.searchsorted(sizes, c, "right")
        if n:
            v = best[c - sizes[:n]] + values[:n]
            k = int(v.argmax())
            if v[k] > best[c] + 1e-12:
                best[c], took[c] = v[k], k
    pattern: dict[int, int] = {}
    c = room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[int(took[c])] = pattern.get(int(took[c]), 0) + 1
            c -= int(sizes[took[c]])
    return float(best[room]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan with row pivots. Plain array arithmetic, as the driver has forked and threaded linear algebra may then wait for ever."""
    n = len(a)
    work = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        k = i + int(np.abs(work[i:, i]).argmax())
        work[[i, k]] = work[[k, i]]
        work[i] /= work[i, i]
        factor = work[:, i].copy()
        factor[i] = 0
        work -= np.outer(factor, work[i])
    return work[:, n:]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a * x).sum(axis=1)


def plan(demand: dict[int, int], room: int = CLASSES) -> list[tuple[dict[int, int], int]]:
    """Patterns {class: pieces} and how many sequences have each; together they hold the demand {class: pieces} exactly."""
    sizes = np.array(sorted(k for k, n in demand.items() if n > 0 and k < room), np.int64)
    left = {k: n for k, n in demand.items() if n > 0}
    plans: list[tuple[dict[int, int], int]] = []
    if len(sizes):
        m, d = len(sizes), np.array([demand[int(s)] for s in sizes], float)
        columns = [{i: int(room // s)} for i, s in enumerate(sizes)]
        basis = np.diag([float(room // s) for s in sizes])
        inverse = np.diag(1 / np.diag(basis))
        x = _times(inverse, d)
        for turn in range(COLUMNS):
            duals = inverse.sum(axis=0)
            worth, pattern = price(sizes, np.maximum(duals, 0), room)
            if worth <= 1 + 1e-9 or x.sum() * (1 - 1 / worth) <= GAP * x.sum():
                break
            a = np.zeros(m)
            for i, n in pattern.items():
                a[i] = n
            u = _times(inverse, a)
            ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
            out = int(ratio.argmin())
            if not np.isfinite(ratio[out]):
                break
            basis[:, out], columns[out] = a, pattern
            if turn % 100 == 99:
                inverse = _inverse(basis)
            else:
                row = inverse[out] / u[out]
                inverse -= np.outer(u, row)
                inverse[out] = row
            x = np.maximum(_times(inverse, d), 0)
        for pattern, n in sorted(zip(columns, np.floor(x + 1e-9).astype(int)), key=lambda c: sorted(c[0].items())):
            by_class = {int(sizes[i]): k for i, k in pattern.items()}
            n = min([int(n), *(left[c] // k for c, k in by_class.items())])
            if n > 0:
                plans.append((by_class, n))
                for c, k in by_class.items():
                    left[c] -= n * k
    while left := {c: n for c, n in left.items() if n > 0}:
        pattern, space = {}, room
        for c in sorted(left, reverse=True):
            if k := min(space // c, left[c]):
                pattern[c] = k
                space -= k * c
        n = min(left[c] // k for c, k in pattern.items())
        plans.append((pattern, n))
        for c, k in pattern.items():
            left[c] -= n * k
    return plans


def padded(used: int) -> int:
    """What a sequence of so many tokens is padded to: itself at a power of two, else SEQUENCE."""
    return used if used & (used - 1) == 0 else SEQUENCE


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; every token of every row lies in one piece.

    Null and empty texts are the end token alone; null ids and repeated rows are packed like others; an empty table gives no rows. Only a
    histogram of at most CLASSES numbers reaches the driver. Pieces of one length are ranked in salted groups, so that thousands of copies
    spread over tasks.
    """
    rows = materialize(cut(docs, vocabulary, ranks, pattern, id_col, text_col), "pieces")
    pieces = rows.select("id", "doc_tokens", F.posexplode("crcs").alias("piece", "ids_crc32")).withColumn("start", F.col("piece").cast("long") * SEQUENCE)
    pieces = pieces.withColumn("length", F.least(F.lit(SEQUENCE), F.col("doc_tokens") - F.col("start")).cast("long")).withColumn("class", F.ceil(F.col("length") / UNIT).cast("int"))
    demand = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    slots, base, filled = [], 0, dict.fromkeys(demand, 0)
    for by_class, n in plan(demand):
        for c, k in by_class.items():
            slots.append((c, filled[c], filled[c] + n * k, k, base))
            filled[c] += n * k
        base += n
    spark = docs.sparkSession
    slot_table = F.broadcast(spark.createDataFrame(slots, "class int, low long, high long, each long, base long"))  # a few thousand rows, as the classes are few
    salts = max(1, -(-sum(demand.values()) // ROWS_A_RANK))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    before = salted.groupBy("class", "salt").count().withColumn("before", F.sum("count").over(Window.partitionBy("class").orderBy("salt")) - F.col("count")).drop("count")
    order = Window.partitionBy("class", "salt").orderBy("id", "start", "ids_crc32")
    ranked = salted.withColumn("within", F.row_number().over(order) - 1).join(before, ["class", "salt"]).withColumn("rank", F.col("within") + F.col("before"))
    placed = ranked.join(slot_table, "class").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.withColumn("sequence_id", (F.col("base") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long"))
    along = Window.partitionBy("sequence_id").orderBy(F.col("class").desc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long"))
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
