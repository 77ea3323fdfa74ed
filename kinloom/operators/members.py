"""Pairs of a record and a query scored against the record's members: blocks of records meet blocks of queries in numpy, pairs follow from arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinloom.functions import similarity
from kinloom.operators import blocking

#: Records, and about how many queries, that Python compares at once; cells of scores that it holds of one kind; pairs that follow from one row.
BLOCK, CELLS, SPREAD = 2000, 1 << 17, 1 << 15
#: Different texts of a task whose scores with each other are kept.
KEPT = 2000


class Remembered:
    """A symmetric function of two lists of texts, all by all; scores of up to KEPT different texts are kept."""

    def __init__(self, score: Callable[[list[str], list[str]], np.ndarray]):
        self.score, self.at, self.table = score, {}, np.full((0, 0), np.nan)

    def __call__(self, xs: list[str], ys: list[str]) -> np.ndarray:
        both = dict.fromkeys([*xs, *ys])
        if len(self.at | both) > KEPT:
            self.at, self.table = {}, np.full((0, 0), np.nan)
            if len(both) > KEPT:
                return self.score(xs, ys)
        for t in both:
            self.at.setdefault(t, len(self.at))
        if more := len(self.at) - len(self.table):
            self.table = np.pad(self.table, (0, more), constant_values=np.nan)
        i, j = (np.array([self.at[t] for t in ts], np.int64) for ts in (xs, ys))
        missing = np.isnan(self.table[np.ix_(i, j)])
        rows, cols = np.flatnonzero(missing.any(1)), np.flatnonzero(missing.any(0))
        if len(rows):
            found = self.score([xs[k] for k in rows], [ys[k] for k in cols])
            self.table[np.ix_(i[rows], j[cols])] = found
            self.table[np.ix_(j[cols], i[rows])] = found.T
        return self.table[np.ix_(i, j)]


def rounded(x: np.ndarray) -> np.ndarray:
    """x to six places; halves go away from 0 by x's decimal digits, as in Spark."""
    y = np.abs(x)
    y *= 1e6
    y += 0.5
    k = np.floor(y)
    y -= k
    y -= 0.5
    for at in zip(*np.nonzero(np.abs(y, out=y) > 0.5 - 1e-6), strict=True):
        k[at] = int((abs(Decimal(repr(float(x[at])))) * 1_000_000).to_integral_value(ROUND_HALF_UP))
    k /= 1e6
    return np.where(x < 0, 0.0 - k, k)


def _coded(texts: pa.Array) -> tuple[list[str], np.ndarray]:
    found = texts.dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy().astype(np.int64)


def _folded(f: np.ufunc, out: np.ndarray, owner: np.ndarray, values: Callable[[slice], np.ndarray]) -> np.ndarray:
    """out with the values of members, a row each, taken into their owner's row by f; owners rise."""
    step = max(1, CELLS // max(1, out.shape[1]))
    for a in range(0, len(owner), step):
        own = owner[a : a + step]
        runs = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[runs]] = f(out[own[runs]], f.reduceat(values(slice(a, a + len(own))), runs, axis=0))
    return out


class Block:
    """A block of records (s1_id, members: m_id, nm, am) and one of queries (nq, aq, ids: q_id, own, tops), by classes of equal name and address."""

    def __init__(self, refs: pa.StructArray, asked: pa.StructArray, alike: Remembered, near: Remembered, placed: Remembered):
        members, ids = refs.field("members"), asked.field("ids")
        self.s1, self.count = refs.field("s1_id").to_numpy(), members.value_lengths().to_numpy().astype(np.int64)
        members, self.start = members.flatten(), np.cumsum(self.count) - self.count
        self.m_id, (m_names, self.mn), (m_places, self.ma) = members.field("m_id").to_numpy(), _coded(members.field("nm")), _coded(members.field("am"))
        (names, self.cn), (places, self.ca) = _coded(asked.field("nq")), _coded(asked.field("aq"))
        self.cls, self.asked = np.repeat(np.arange(len(self.cn)), ids.value_lengths().to_numpy()), ids.flatten()
        self.q = self.asked.field("q_id").to_numpy()
        self.nt, self.nr, self.at = alike(m_names, names), near(m_names, names), placed(m_places, places)
        self.nr_c, self.at_c = self.nr[:, self.cn], self.at[:, self.ca]
        self._own()

    def _own(self) -> None:
        """Queries that are members of a record here (k, of record o) are compared with its other members."""
        own, order = self.asked.field("own"), np.argsort(self.s1)
        pos = np.minimum(np.searchsorted(self.s1[order], own.fill_null(0).to_numpy()), len(order) - 1)
        here = own.is_valid().to_numpy(False) & (self.s1[order][pos] == own.fill_null(0).to_numpy())
        self.k = np.flatnonzero(here)
        self.o = order[pos[self.k]]
        by = np.argsort(self.o, kind="stable")
        self.k, self.o = self.k[by], self.o[by]
        n = self.count[self.o]
        of = np.repeat(np.arange(len(n)), n)
        m = self.start[self.o][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of]
        other = self.m_id[m] != self.q[self.k][of]
        of, m = of[other], m[other]
        c = self.cls[self.k][of]
        values = self.nt[self.mn[m], self.cn[c]], self.nr[self.mn[m], self.cn[c]], self.at[self.ma[m], self.ca[c]]
        self.of_own = [x[:, 0] for x in self._ends(len(n), np.bincount(of, minlength=len(n)), of, *(lambda a, v=v: v[a, None] for v in (*values, values[1] * values[2] / 100)))]

    @staticmethod
    def _ends(rows: int, count: np.ndarray, owner: np.ndarray, nt, nr, at, na, sizes: tuple[int, int, int] = (1, 1, 1)) -> list[np.ndarray]:
        """By row the greatest and mean nt, and the greatest nr, at and na, of its members; -1 without any."""
        least = lambda n: np.full((rows, n), -1.0)
        total = _folded(np.add, np.zeros((rows, sizes[0])), owner, nt)
        mean = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], -1.0)
        return [_folded(np.maximum, least(sizes[0]), owner, nt), mean, *(_folded(np.maximum, least(n), owner, v) for n, v in ((sizes[0], nr), (sizes[1], at), (sizes[2], na)))]

    def chunks(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """Some records at once, from and to, and their scores: the greatest and mean token set, and the greatest ratio by name, the greatest by address, and both by class."""
        step = max(1, CELLS // max(1, len(self.cn)))
        for a in range(0, len(self.s1), step):
            b = min(a + step, len(self.s1))
            count = self.count[a:b]
            first = self.start[a]
            mn, ma = (x[first : first + count.sum()] for x in (self.mn, self.ma))
            sizes = self.nt.shape[1], self.at.shape[1], len(self.cn)
            yield a, b, self._ends(b - a, count, np.repeat(np.arange(b - a), count), lambda x: self.nt[mn[x]], lambda x: self.nr[mn[x]], lambda x: self.at[ma[x]], lambda x: self.nr_c[mn[x]] * self.at_c[ma[x]] / 100, sizes)  # noqa: B023

    def tops(self) -> pa.RecordBatch:
        """What the block's best record gives a query."""
        best = np.full((2, len(self.q)), -1.0)
        c_own, kinds = self.cls[self.k], (self.cn[self.cls], self.cls)
        for a, b, (_, _, nr, _, na) in self.chunks():
            own = np.flatnonzero((self.o >= a) & (self.o < b))
            for x, (values, kind, of_own) in enumerate(((nr, kinds[0], self.of_own[2]), (na, kinds[1], self.of_own[4]))):
                top = values.max(axis=0)[kind]
                for some in np.array_split(own, 1 + len(own) * (b - a) // CELLS):
                    left = values[:, self.cn[c_own[some]] if x == 0 else c_own[some]]
                    left[self.o[some] - a, np.arange(len(some))] = of_own[some]
                    top[self.k[some]] = left.max(axis=0)
                best[x] = np.maximum(best[x], top)
        return pa.RecordBatch.from_arrays([pa.array(self.q), *map(pa.array, best)], ["q_id", "top_nr", "top_na"])

    def spread(self) -> Iterator[pa.RecordBatch]:
        """Rows from whose arrays pairs follow (SCHEMA): of queries and the records that they are no members of, then of the others."""
        tops = [self.asked.field(c).to_numpy() for c in ("top_nr", "top_na")]
        kinds = []
        for of, top in zip((self.cn[self.cls], self.cls), tops, strict=True):
            _, t = np.unique(top, return_inverse=True)
            _, first, kind = np.unique(of * (t.max() + 1) + t, return_index=True, return_inverse=True)
            kinds.append((of[first], top[first], kind.astype(np.int32)))
        (n_of, n_top, ni), (c_of, c_top, ci) = kinds
        ai, many, size = self.ca[self.cls].astype(np.int32), len(self.q), max(1, SPREAD // len(self.q))
        for a, b, (nt, mean, nr, at, na) in self.chunks():
            lists = np.append(np.arange(0, b - a, size), b - a)
            rows = len(lists) - 1
            own = np.full((rows, many), -1, np.int32)
            k, o = (x[(self.o >= a) & (self.o < b)] for x in (self.k, self.o - a))
            own[o // size, k] = o % size
            names = [rounded(x)[:, n_of] for x in (nt, mean, nr)]
            values = [*names, rounded(nr[:, n_of] - n_top), rounded(at), rounded(na)[:, c_of], rounded(na[:, c_of] - c_top)]
            yield self._batch(lists, self.s1[a:b], np.arange(rows + 1) * many, [np.tile(self.q, rows), own.ravel(), *(np.tile(x, rows) for x in (ni, ai, ci))], [np.full(rows, x.shape[1], np.int32) for x in (values[0], values[4], values[5])], [(lists * x.shape[1], x.ravel()) for x in values])
        if len(self.k):
            ends = np.append(np.flatnonzero(np.diff(self.o, prepend=-1)), len(self.o))
            n = np.diff(ends).astype(np.int32)
            at = (np.arange(len(self.o)) - np.repeat(ends[:-1], n)).astype(np.int32)
            nt, mean, nr, addr, na = self.of_own
            values = [nt, mean, nr, nr - tops[0][self.k], addr, na, na - tops[1][self.k]]
            yield self._batch(np.arange(len(n) + 1), self.s1[self.o[ends[:-1]]], ends, [self.q[self.k], np.full(len(at), -1, np.int32), at, at, at], [n, n, n], [(ends, rounded(x)) for x in values])

    @staticmethod
    def _batch(lists, s1, ends, asked, sizes, values) -> pa.RecordBatch:
        of = lambda at, x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x))
        return pa.RecordBatch.from_arrays([of(lists, s1), *(of(ends, x) for x in asked), *map(pa.array, sizes), *(of(*v) for v in values)], NAMES)


#: Of Block.spread: records, queries, a query's own record (its place in s1, else -1) and its places among names, addresses and classes, how many of these, and their scores.
SCHEMA = "s1 array<long>, asked array<long>, own array<int>, ni array<int>, ai array<int>, ci array<int>, nn int, an int, cn int, " + ", ".join(f"{c} array<double>" for c in ("nt", "mean", "nr", "nr_gap", "at", "na", "na_gap"))
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]


def _blocks(df: DataFrame, of: DataFrame, on: list[str], key, value, name: str, *apart: str) -> DataFrame:
    """(on, name): values in blocks of about BLOCK rows of df, of which none has rows that differ in apart."""
    many = df.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    return of.join(many, on).withColumn("block", F.pmod(F.xxhash64(*key), "blocks")).groupBy(*on, "block", *apart).agg(F.collect_list(value).alias(name)).drop("block", *apart)


def record_blocks(s: DataFrame, members: DataFrame, on: list[str]) -> DataFrame:
    """(on, refs): records (on, s1_id) with their members (s1_id, m_id, nm, am); repeated records lie in different blocks, so that a block finds a query's own by its id."""
    s = s.groupBy(*on, "s1_id").agg(F.count(F.lit(1)).alias("copies")).select(*on, "s1_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    own = members.groupBy("s1_id").agg(F.array_sort(F.collect_list(F.struct("m_id", "nm", "am"))).alias("members"))
    return _blocks(s, s.join(own, "s1_id", "left"), on, ["s1_id"], F.struct("s1_id", F.coalesce("members", F.array().cast(own.schema["members"].dataType)).alias("members")), "refs", "copy")


def query_blocks(o: DataFrame, on: list[str], *more: str) -> DataFrame:
    """(on, asked): queries (on, q_id, nq, aq, own: the record that has the query as a member, and more) by classes of equal name and address."""
    classes = blocking.held(o, [*on, "nq", "aq"], "q_id", F.struct("q_id", "own", *more), "ids")
    return _blocks(o, classes, on, ["nq", "aq", F.get("ids", F.lit(0))["q_id"]], F.struct("nq", "aq", "ids"), "asked")


def _met(refs: DataFrame, asked: DataFrame, on: list[str], give: Callable[[Block], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = Remembered(similarity.token_set_ratios), Remembered(similarity.ratios), Remembered(similarity.token_set_ratios)
        for batch in batches:
            for i in range(batch.num_rows):
                yield from give(Block(batch["refs"][i].values, batch["asked"][i].values, *scores))

    return blocking.class_pairs(refs, asked, on, "refs").select("refs", "asked").mapInArrow(compared, schema)


def tops(refs: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """(q_id, top_nr, top_na): the greatest that any record gives a query, -1 for a record without other members."""
    found = _met(refs, asked, on, lambda block: iter([block.tops()]), "q_id long, top_nr double, top_na double")
    return found.groupBy("q_id").agg(F.max("top_nr").alias("top_nr"), F.max("top_na").alias("top_na"))


def member_scores(refs: DataFrame, asked: DataFrame, on: list[str]) -> DataFrame:
    """All pairs that agree in the columns on: the greatest and mean token set ratio of the query's name and those of the record's other members, the greatest ratio, the
    greatest token set ratio of addresses, the greatest product, and the gaps of ratio and product to top_nr and top_na; rounded, -1 without other members."""
    met = _met(refs, asked, on, Block.spread, SCHEMA)
    each = met.select("*", F.posexplode("s1").alias("i", "s1_id")).select("*", F.posexplode("asked").alias("j", "q_id")).where(F.get("own", "j") != F.col("i"))
    of = lambda c, ix, n: F.get(c, F.col("i") * F.col(n) + F.get(ix, "j"))
    by = [("nt", "n"), ("mean", "n"), ("nr", "n"), ("at", "a"), ("na", "c"), ("nr_gap", "n"), ("na_gap", "c")]
    return each.select("s1_id", "q_id", *(of(c, f"{k}i", f"{k}n" if k != "n" else "nn").alias(c) for c, k in by))
