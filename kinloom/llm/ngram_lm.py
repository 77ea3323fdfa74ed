"""N-gram language model in an Elias-Fano trie.

Every level is a monotone sequence, coded by Elias and Fano: the word hashes, then for n-grams the number of their context (of the word, of
the n-gram one shorter) times the vocabulary's size plus the last word's id. So the upper bits of a level are also the pointers from contexts
to their continuations, and an n-gram is found by one successor search from where its context begins. Beside each n-gram lie one byte for its
discounted probability and one for the weight that it passes to shorter contexts. Levels are split by the first word into shards, built by one task each,
written to the shared folder and memory-mapped by the tasks that score; only the pages in use are read. The n-grams of a word that would fill
a shard by itself are dealt out by their second word.

The model interpolates absolute discounting: p(w|uv) = max(c - D, 0) / c(uv) + g(uv) p(w|v), and so on down to single words, where what is
discounted goes to unknown words. Counts are of all training texts, and each shard has the D that its own counts of one and two ask.
Rounding is finest near 1, and what it adds above 1 is cut off.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.llm.common import fresh_path, map_batches, schema_of

U64 = np.uint64
#: Stands for the hash of a text's end.
END = 0x5D0C_E4D0_0000_0001
#: Tokens a task counts or scores at a time, tokens a shard is made for, word counts that a task holds, levels that it keeps open.
BATCH_TOKENS, SHARD_TOKENS, HELD, OPEN = 1_000_000, 5_000_000, 2_000_000, 400
#: A word seen so often has its n-grams dealt out, to one shard for each so many.
HOT_TOKENS = 1_000_000
#: Bytes stand for log10 from 0 down to this, in steps that grow from 0 on; what is less likely is left to shorter contexts.
FLOOR = -8.0


# ---- Elias-Fano


def _select_table() -> np.ndarray:
    """For each byte the places of its ones."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    table = np.zeros((256, 8), np.uint8)
    for b in range(256):
        at = np.flatnonzero(bits[b])
        table[b, : len(at)] = at
    return table


_IN_BYTE = _select_table()
_L8, _H8 = U64(0x0101010101010101), U64(0x8080808080808080)


def _planes(low_bits: int) -> list[tuple[str, np.dtype, int]]:
    """Arrays of 4, 2 and 1 bytes that the lower bits of an entry fill, and the bits below each."""
    found, below = [], 0
    for size in (4, 2, 1):
        while low_bits - below >= 8 * size:
            found.append((f"low{below}", np.dtype(f"u{size}"), below))
            below += 8 * size
    return found


def ef_encode(keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays that hold sorted distinct unsigned 64-bit keys: whole bytes of lower bits, upper bits in unary, zeros counted up to each 64 bits."""
    n = len(keys)
    top = int(keys[-1]) if n else 0
    low_bits = min(range(0, 64, 8), key=lambda b: b * n + n + (top >> b))
    high = (keys >> U64(low_bits)).astype(np.int64)
    size = (n + (top >> low_bits) + 1 + 63) // 64 * 64
    upper = np.zeros(size, np.uint8)
    upper[high + np.arange(n)] = 1
    words = np.packbits(upper, bitorder="little").view(U64)
    zeros = np.concatenate([[0], np.cumsum(64 - np.bitwise_count(words).astype(np.int64))[:-1]])
    low = {name: ((keys >> U64(below)) & U64((1 << 8 * kind.itemsize) - 1)).astype(kind) for name, kind, below in _planes(low_bits)}
    # a word of zeros more, as searches read the word behind
    return {"meta": np.array([n, low_bits], np.int64), "upper": np.append(words, U64(0)), "zeros": zeros.astype(np.uint32 if size < 1 << 32 else np.int64)} | low


def ef_find(ef: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The position of each key, or -1: select finds the run of entries with its upper bits, a search in the run its successor. Sorted keys are faster."""
    n, low_bits = (int(x) for x in ef["meta"])
    found = np.full(len(keys), -1, np.int64)
    if not n:
        return found
    upper, zeros = ef["upper"], ef["zeros"]
    low = [(ef[name], U64(below)) for name, _, below in _planes(low_bits)]
    high = (keys >> U64(low_bits)).astype(np.int64)
    # the last entry's upper bits are the number of zeros before its one; beyond them nothing is
    live = np.flatnonzero((high >= 0) & (high < (len(upper) - 1) * 64 - n))
    high = high[live]
    bit = _select0(upper, zeros, high - 1) + 1
    begin = bit - high
    # the ones from there on are the run
    word, shift = bit >> 6, (bit & 63).astype(U64)
    ones = upper[word] >> shift
    ones |= np.where(shift > 0, upper[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    rest = ~ones
    with np.errstate(over="ignore"):
        run = np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
    long = np.flatnonzero(run == 64)
    if len(long):
        run[long] = _select0(upper, zeros, high[long]) - high[long] - begin[long]
    some = np.flatnonzero(run)
    live, begin, run = live[some], begin[some], run[some]
    target = keys[live] & U64((1 << low_bits) - 1)
    while len(live):
        half = run >> 1
        at = begin + half
        if low:
            value = low[0][0][at].astype(U64)
            for plane, below in low[1:]:
                value |= plane[at].astype(U64) << below
        else:
            value = np.zeros(len(at), U64)
        hit = value == target
        found[live[hit]] = at[hit]
        above = value < target
        run = np.where(above, run - half - 1, half)
        begin = np.where(above, at + 1, begin)
        go = np.flatnonzero((run > 0) & ~hit)
        live, begin, run, target = live[go], begin[go], run[go], target[go]
    return found


def _select0(upper: np.ndarray, zeros: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The bit of the k-th zero, from 0; -1 for k = -1."""
    some = np.maximum(k, 0)
    word = np.searchsorted(zeros, some.astype(zeros.dtype), "right") - 1
    left = (some - zeros[word]).astype(U64)
    x = ~upper[word]
    # ones of each byte, then of each byte and those below it
    sums = x - ((x >> U64(1)) & U64(0x5555555555555555))
    sums = (sums & U64(0x3333333333333333)) + ((sums >> U64(2)) & U64(0x3333333333333333))
    with np.errstate(over="ignore"):
        sums = ((sums + (sums >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _L8
        # bytes up to whose end there are no more ones than are skipped
        below = np.bitwise_count(((left * _L8 | _H8) - sums) & _H8).astype(U64) * U64(8)
    left -= ((sums << U64(8)) >> below) & U64(255)
    return np.where(k < 0, -1, word * 64 + below.astype(np.int64) + _IN_BYTE[((x >> below) & U64(255)).astype(np.intp), left.astype(np.intp)])


def quantise(p: np.ndarray) -> np.ndarray:
    """A byte for each probability or weight: 0 for none, 1 to 255 for log10 from FLOOR up to 0."""
    with np.errstate(divide="ignore"):
        down = np.log10(p) / FLOOR
    return np.where(down <= 1, np.rint(254 * (1 - np.sqrt(np.clip(down, 0, 1)))) + 1, 0).astype(np.uint8)


_RESTORED = np.concatenate([[0.0], 10 ** (FLOOR * (1 - np.arange(255) / 254) ** 2)])


def restore(codes: np.ndarray) -> np.ndarray:
    return _RESTORED[codes]


# ---- files


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _put(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of arrays behind a header; written under another name first, so that a task that runs twice does no harm."""
    fs, path = _filesystem(uri)
    place, at = {}, 0
    for name, a in arrays.items():
        place[name] = (at, len(a), a.dtype.str)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(place).encode()
    head += b" " * (-(len(head) + 8) % 8)
    draft = f"{path}.{np.random.default_rng().integers(1 << 62):x}"
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(draft) as f:
        f.write(len(head).to_bytes(8, "little") + head)
        for a in arrays.values():
            f.write(a.tobytes() + b"\0" * (-a.nbytes % 8))
    fs.move(draft, path)


def _map(uri: str) -> dict[str, np.ndarray]:
    """A file's arrays, memory-mapped; a file that is not on a mounted path is copied, block by block, to an unnamed local one first."""
    fs, path = _filesystem(uri)
    if fs.type_name == "local":
        raw = np.memmap(path, np.uint8, "r")
    else:
        import shutil
        import tempfile

        with tempfile.TemporaryFile() as f, fs.open_input_stream(path) as source:
            shutil.copyfileobj(source, f, 1 << 22)
            f.flush()
            raw = np.memmap(f, np.uint8, "r")
    raw = np.asarray(raw)
    size = int(raw[:8].view(np.int64)[0])
    place = json.loads(bytes(raw[8 : 8 + size]))
    base = 8 + size
    return {name: raw[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, (at, n, kind) in place.items()}


# ---- tokens


def _numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' tokens as numbers, 0 for the end of each, where each text ends, and the words' hashes by number; nulls are empty texts."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts, ""))))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    counts = np.diff(split.offsets.to_numpy()).astype(np.int64)
    numbers = coded.indices.to_numpy().astype(np.int64) + 1
    if b"" in words:  # an empty text's only part
        none = words.index(b"") + 1
        blank = numbers == none
        counts[np.repeat(np.arange(len(counts)), counts)[blank]] = 0
        numbers = numbers[~blank]
    ends = np.cumsum(counts + 1)
    out = np.zeros(len(numbers) + len(counts), np.int64)
    inside = np.ones(len(out), bool)
    inside[ends - 1] = False
    out[inside] = numbers
    return out, ends, np.fromiter(chain([END], map(xxhash.xxh64_intdigest, words)), U64, len(words) + 1)


class Reader:
    """Texts as numbers, and by number what the model says of the words of the last texts: id (-1: unknown), count, probability alone, weight that it passes."""

    def __init__(self, model: Model) -> None:
        self.model = model

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        m = self.model
        numbers, ends, hashes = _numbers(texts)
        self.ids, self.counts = m.ids(hashes)
        self.alone = np.where(self.counts > 0, (self.counts - m.discount) / max(1, m.total), m.discount * m.words / max(1, m.total))
        self.passed = m.passed_by_words(self.ids)
        return numbers, ends


def _groups(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """The texts in groups of about BATCH_TOKENS tokens at most, and where each group begins."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(column):
        before = int(sizes[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + 6 * BATCH_TOKENS, "right")))
        yield first, column.slice(first, end - first)
        first = end


def _pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences and counts, byte by byte of all, so that the shuffle compresses what is zero."""
    steps = np.diff(keys, prepend=U64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes(), counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.ascontiguousarray(np.frombuffer(keys, np.uint8).reshape(8, -1).T).view(U64).ravel()
    return np.cumsum(steps, dtype=U64), np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the sums of their counts."""
    keys, counts = np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts.astype(np.int64), first)


def _summed(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return _merged([_unpack(k, c) for k, c in zip(pdf["keys"], pdf["counts"], strict=True)])


def _by_shard(shards: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The order by shard and key."""
    bits = int(keys.max()).bit_length() if len(keys) else 0
    if bits + (int(shards.max()).bit_length() if len(shards) else 0) <= 64:
        return np.argsort((shards.astype(U64) << U64(min(bits, 63))) | keys)
    return np.lexsort((keys, shards))


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """The stretches of equal values."""
    edges = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(0, np.int64)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _dealt(shards: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each shard; keys are sorted within each."""
    if not len(keys):
        return
    order = _by_shard(shards, keys)
    shards, keys, counts = shards[order], keys[order], counts[order]
    s, k, c = zip(*((int(shards[a]), *_pack(keys[a:b], counts[a:b])) for a, b in _runs(shards)), strict=True)
    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())], ["shard", "keys", "counts"])


_DEALT = "shard int, keys binary, counts binary"


# ---- the model


def _none() -> np.ndarray:
    return np.zeros(0, np.int64)


@dataclass
class Model:
    """Where the levels are and the corpus's figures.

    offsets: the first word id of each vocabulary shard; hot, hot_counts, hot_passed: ids of the words whose n-grams are dealt out, their
    counts and the weights that they pass; bigrams, trigrams: the shards that have some.
    """

    path: str
    offsets: list[int] = field(default_factory=lambda: [0])
    total: int = 0
    shards: int = 1
    discount: float = 0.5
    hot: np.ndarray = field(default_factory=_none)
    hot_counts: np.ndarray = field(default_factory=_none)
    hot_passed: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bigrams: frozenset[int] = frozenset()
    trigrams: frozenset[int] = frozenset()
    _open: dict[str, dict[str, np.ndarray]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_open": {}}

    @property
    def words(self) -> int:
        return self.offsets[-1]

    @property
    def own(self) -> int:
        """Contexts of one word that a shard has; from there on they are hot ones, the same in all."""
        return -(-self.words // self.shards)

    def level(self, name: str, shard: int) -> dict[str, np.ndarray]:
        key = f"{name}-{shard}"
        if key not in self._open:
            if len(self._open) >= OPEN:
                del self._open[next(iter(self._open))]
            self._open[key] = _map(f"{self.path}/{key}")
        return self._open[key]

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ids (-1: unknown) and counts of hashes."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        n = len(self.offsets) - 1
        if not n:
            return ids, counts
        order = np.argsort(hashes)
        hashes = hashes[order]
        shard = _hash_shard(hashes, n)  # in the hashes' order
        for a, b in _runs(shard):
            s = int(shard[a])
            if self.offsets[s] < self.offsets[s + 1]:
                level = self.level("words", s)
                at = ef_find(level, hashes[a:b] - level["base"][0])
                known = np.flatnonzero(at >= 0)
                ids[order[a + known]] = at[known] + self.offsets[s]
                counts[order[a + known]] = level["count"][at[known]]
        return ids, counts

    def _hot_place(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words stand among the hot ones, and whether they do."""
        place = np.minimum(np.searchsorted(self.hot, u), max(0, len(self.hot) - 1))
        return place, (self.hot[place] == u if len(self.hot) else np.zeros(len(u), bool))

    def home(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shard of bigrams (word ids) and their keys in it."""
        shard, context = u % self.shards, u // self.shards
        place, hot = self._hot_place(u)
        if hot.any():
            over = np.maximum(1, self.hot_counts[place[hot]] // HOT_TOKENS)
            spread = ((w[hot].astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(33)).astype(np.int64)
            shard[hot] = (shard[hot] + spread % over) % self.shards
            context[hot] = self.own + place[hot]
        return shard, context.astype(U64) * U64(self.words) + w.astype(U64)

    def passed_by_words(self, u: np.ndarray) -> np.ndarray:
        """The weight that each word (id, -1: unknown) passes to words alone; all of it where nothing follows the word."""
        out = np.ones(len(u))
        place, hot = self._hot_place(u)
        if len(self.hot_passed):
            out[hot] = self.hot_passed[place[hot]]
        rest = np.flatnonzero((u >= 0) & ~hot)
        rest = rest[np.argsort(u[rest] % self.shards, kind="stable")]
        shard = u[rest] % self.shards
        for a, b in _runs(shard):
            if int(shard[a]) in self.bigrams:
                out[rest[a:b]] = restore(self.level("bigrams", int(shard[a]))["pass_one"][u[rest[a:b]] // self.shards])
        return out

    def find_bigrams(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shard, place there (-1: none) and probability of bigrams of word ids (-1: unknown)."""
        shard, place, p = np.zeros(len(u), np.int64), np.full(len(u), -1, np.int64), np.zeros(len(u))
        known = np.flatnonzero((u >= 0) & (w >= 0))
        home, keys = self.home(u[known], w[known])
        order = _by_shard(home, keys)
        known, home, keys = known[order], home[order], keys[order]
        shard[known] = home
        for a, b in _runs(home):
            if int(home[a]) in self.bigrams:
                level = self.level("bigrams", int(home[a]))
                at = ef_find(level, keys[a:b])
                hit = np.flatnonzero(at >= 0)
                place[known[a + hit]] = at[hit]
                p[known[a + hit]] = restore(level["p"][at[hit]])
        return shard, place, p

    def find_trigrams(self, shard: np.ndarray, context: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight that contexts (bigrams' shards and places) pass on, and the probability of words (ids, -1: none such) behind them."""
        passed, p = np.ones(len(w)), np.zeros(len(w))
        keys = context.astype(U64) * U64(self.words) + np.maximum(w, 0).astype(U64)
        order = _by_shard(shard, keys)
        home, keys = shard[order], keys[order]
        for a, b in _runs(home):
            if int(home[a]) in self.trigrams:
                level = self.level("trigrams", int(home[a]))
                rows = order[a:b]
                passed[rows] = weight = restore(level["pass_two"][context[rows]])
                some = np.flatnonzero((w[rows] >= 0) & (weight < 1))
                at = ef_find(level, keys[a:b][some])
                hit = np.flatnonzero(at >= 0)
                p[rows[some[hit]]] = restore(level["p"][at[hit]])
        return passed, p


def _hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64)


def _discount(ones: int, twos: int) -> float:
    return min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones + twos else 0.5


def _pairs(numbers: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a token has one before it in its text, and both as one code."""
    at = np.flatnonzero(numbers[:-1]) + 1
    return at, (numbers[at - 1] << bits) | numbers[at]


def _count_words(shards: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> Iterator[pa.RecordBatch]:
        keys, counts = _merged(held)
        yield from _dealt(_hash_shard(keys, shards), keys, counts)

    for batch in batches:
        for _, group in _groups(batch["text"]):
            numbers, _, hashes = _numbers(group)
            held.append((hashes, np.bincount(numbers, minlength=len(hashes))))
            if sum(len(k) for k, _ in held) > HELD:
                yield from counted()
                held.clear()
    if held:
        yield from counted()


def _build_words(path: str, pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _summed(pdf)
    shard = int(pdf["shard"].iloc[0])
    _put(f"{path}/words-{shard}", ef_encode(keys - keys[0]) | {"base": keys[:1], "count": counts})
    hot = np.flatnonzero((counts >= HOT_TOKENS) & (keys != U64(END)))
    return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())], "ones": [int((counts == 1).sum())], "twos": [int((counts == 2).sum())], "hot": [hot.tolist()], "hot_counts": [counts[hot].tolist()]})


def _count_bigrams(model: Model):
    reader = Reader(model)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batch["text"]):
            numbers, _ = reader.read(group)
            bits = len(reader.ids).bit_length()
            codes, counts = np.unique(_pairs(numbers, bits)[1], return_counts=True)
            shard, keys = model.home(reader.ids[codes >> bits], reader.ids[codes & ((1 << bits) - 1)])
            yield from _dealt(shard, keys, counts)

    return step


def _passed(taken: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The bytes of the weights that contexts pass, of what was taken of their counts; all where nothing follows, a little at least."""
    return np.maximum(quantise(np.where(total > 0, taken / np.maximum(total, 1), 1.0)), 1)


def _build_bigrams(model: Model, pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's bigrams, discounted as its own counts of one and two ask; counts are one byte each, the large ones apart."""
    keys, counts = _summed(pdf)
    shard = int(pdf["shard"].iloc[0])
    d = _discount(int((counts == 1).sum()), int((counts == 2).sum()))
    context = (keys // U64(model.words)).astype(np.int64)
    total = np.bincount(context, counts, model.own + len(model.hot))
    total[model.own :] = model.hot_counts
    taken = d * np.bincount(context, minlength=len(total))
    large = np.flatnonzero(counts >= 255)
    _put(
        f"{model.path}/bigrams-{shard}",
        ef_encode(keys)
        | {"p": quantise((counts - d) / total[context]), "often": np.minimum(counts, 255).astype(np.uint8), "large": large, "large_count": counts[large], "pass_one": _passed(taken[: model.own], total[: model.own])},
    )
    hot = np.flatnonzero(taken[model.own :])
    return pd.DataFrame({"shard": [shard], "hot": [hot.tolist()], "taken": [taken[model.own + hot].tolist()]})


def _count_trigrams(model: Model):
    reader = Reader(model)

    def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for _, group in _groups(batch["text"]):
            numbers, _ = reader.read(group)
            bits = len(reader.ids).bit_length()
            low = (1 << bits) - 1
            at, codes = _pairs(numbers, bits)
            pair, bigrams = pd.factorize(codes)
            shard, place, _ = model.find_bigrams(reader.ids[bigrams >> bits], reader.ids[bigrams & low])
            of = np.full(len(numbers), -1, np.int64)
            of[at] = pair
            at = at[of[at - 1] >= 0]
            codes, counts = np.unique((of[at - 1] << bits) | numbers[at], return_counts=True)
            context = codes >> bits
            yield from _dealt(shard[context], place[context].astype(U64) * U64(model.words) + reader.ids[codes & low].astype(U64), counts)

    return step


def _build_trigrams(model: Model, pdf: pd.DataFrame) -> pd.DataFrame:
    keys, counts = _summed(pdf)
    shard = int(pdf["shard"].iloc[0])
    d = _discount(int((counts == 1).sum()), int((counts == 2).sum()))
    two = model.level("bigrams", shard)
    seen = two["often"].astype(np.int64)
    seen[two["large"]] = two["large_count"]
    context = (keys // U64(model.words)).astype(np.int64)
    kinds = np.bincount(context, minlength=len(seen))
    _put(f"{model.path}/trigrams-{shard}", ef_encode(keys) | {"p": quantise((counts - d) / seen[context]), "pass_two": _passed(d * kinds, np.where(kinds > 0, seen, 0))})
    return pd.DataFrame({"shard": [shard]})


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Count the texts and build the levels in the shared folder.

    Null texts are empty, repeated rows count again, an empty table gives a model without words; other columns are not read. The driver gets a few numbers
    for each shard and for each word that fills a shard. Word ids have 32 bits.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "lm")
    texts = docs.select(F.col(text_col).alias("text"))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    stats = "shard int, n long, total long, ones long, twos long, hot array<long>, hot_counts array<long>"
    got = texts.mapInArrow(partial(_count_words, shards), _DEALT).groupBy("shard").applyInPandas(partial(_build_words, path), stats).collect()
    sizes = {r["shard"]: r["n"] for r in got}
    model = Model(path, np.cumsum([0, *(sizes.get(s, 0) for s in range(shards))]).tolist(), sum(r["total"] for r in got))
    if not model.total:
        return Model(path)
    if model.words >= 1 << 32:
        raise ValueError("more than 2 ** 32 different words")
    model.shards = max(1, -(-model.total // SHARD_TOKENS))
    model.discount = _discount(sum(r["ones"] for r in got), sum(r["twos"] for r in got))
    hot = sorted((model.offsets[r["shard"]] + at, n) for r in got for at, n in zip(r["hot"], r["hot_counts"], strict=True))
    model.hot, model.hot_counts = np.array([u for u, _ in hot], np.int64), np.array([n for _, n in hot], np.int64)
    got = map_batches(texts, partial(_count_bigrams, replace(model)), _DEALT).groupBy("shard").applyInPandas(partial(_build_bigrams, replace(model)), "shard int, hot array<long>, taken array<double>").collect()
    model.bigrams = frozenset(r["shard"] for r in got)
    taken = np.zeros(len(hot))
    for r in got:
        taken[r["hot"]] += r["taken"]
    model.hot_passed = taken / model.hot_counts
    got = map_batches(texts, partial(_count_trigrams, replace(model)), _DEALT).groupBy("shard").applyInPandas(partial(_build_trigrams, replace(model)), "shard int").collect()
    model.trigrams = frozenset(r["shard"] for r in got)
    return model


def log10_probabilities(reader: Reader, numbers: np.ndarray) -> np.ndarray:
    """The model's log10 probability of each token; equal n-grams are looked up once."""
    model = reader.model
    if not model.total:
        return np.zeros(len(numbers))
    logs = np.log10(reader.alone)[numbers]
    bits = len(reader.ids).bit_length()
    low = (1 << bits) - 1
    at, codes = _pairs(numbers, bits)
    pair, bigrams = pd.factorize(codes)
    first, last = bigrams >> bits, bigrams & low
    shard, place, p = model.find_bigrams(reader.ids[first], reader.ids[last])
    two = p + reader.passed[first] * reader.alone[last]
    logs[at] = np.log10(np.minimum(two, 1))[pair]
    of = np.full(len(numbers), -1, np.int64)
    of[at] = pair
    # two words before, whose bigram is known
    at = at[of[at - 1] >= 0]
    at = at[place[of[at - 1]] >= 0]
    triple, trigrams = pd.factorize((of[at - 1] << bits) | numbers[at])
    context = trigrams >> bits
    ending = np.zeros(len(trigrams), np.int64)
    ending[triple] = of[at]
    # no trigram ends with a bigram that is not known
    passed, p = model.find_trigrams(shard[context], place[context], np.where(place[ending] >= 0, reader.ids[trigrams & low], -1))
    logs[at] = np.log10(np.minimum(p + passed * two[ending], 1))[triple]
    return logs


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text") -> DataFrame:
    """The named columns of docs and n_tokens, n_known, train_tokens, base_score and score of each row's whole text.

    Null and empty texts are the end token alone; null ids and repeated rows are scored like others; columns of docs that have a
    result's name give way. Words the training did not have count as one unknown word.
    """
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kept = [c for c in columns if c not in results]
    schema = f"{schema_of(docs.select(*kept))}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def make():
        reader = Reader(model)
        size = model.total + 0.1 * (model.words + 1)

        def step(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for first, group in _groups(batch[text_col]):
                numbers, ends = reader.read(group)
                logs = log10_probabilities(reader, numbers)
                starts = np.concatenate([[0], ends[:-1]])
                add = lambda x: np.add.reduceat(x, starts)
                part = batch.slice(first, len(group))
                known, base = (reader.counts > 0).astype(np.int64), np.log10((reader.counts + 0.1) / size)
                yield pa.RecordBatch.from_arrays(
                    [*(part[c] for c in kept), pa.array(ends - starts), pa.array(add(known[numbers])), pa.array(np.full(len(group), model.total, np.int64)), pa.array(add(base[numbers])), pa.array(add(logs))],
                    [*kept, *results],
                )

        return step

    return map_batches(docs.select(*kept, *([] if text_col in kept else [text_col])), make, schema)
