"""Problem 1: all similar pairs between set-valued records.

Method: T-occurrence list merging. Records with equal sets form one class; a class is sent to the
partitions of its signature tokens, where inverted lists are probed with a heap that skips ids which
cannot reach the overlap, and the longest lists are only binary-searched.

Signatures keep that exact: tokens have one global order (tokens outside a bounded dictionary of the
frequent ones first, by hash; then by rising frequency). Two sets that overlap enough share their first
common token within a prefix of each. If that token is frequent the second common token joins the
signature, and if the two together are still expected in many sets, the third. Which tokens need an
extension depends on the tokens alone, so both sides agree, and a pair is emitted only at its own first
common tokens, so never twice. A signature that could gather more than `hot` classes is split in
blocks, and its classes meet block pair by block pair.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut, parallelism

#: Frequent tokens whose order is by frequency. A bound on memory only: results don't depend on it.
DICTIONARY = 50_000
#: A signature of one token is extended if more classes hold the token, of two if more are expected to.
SINGLE, DOUBLE = 24, 48
#: Classes that may meet in one group of one task.
HOT = 20_000


def normal_set(values):
    """Sorted distinct values without surrounding spaces, in lower case; nulls and blanks don't count."""
    low = F.transform(values, lambda x: F.lower(F.trim(x)))
    return F.array_sort(F.array_distinct(F.filter(low, lambda x: x.isNotNull() & (x != ""))))


def merge_skip(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """(id, occurrences) of ids in at least `need` of the sorted lists, by a heap of their heads that
    pops `need` - 1 heads at a time and lets those lists skip to the next possible id."""
    heap = [(x[0], k) for k, x in enumerate(lists)]
    heapq.heapify(heap)
    at, out = [0] * len(lists), []
    while len(heap) >= need:
        top, moved = heap[0][0], []
        while heap and heap[0][0] == top:
            moved.append(heapq.heappop(heap)[1])
        if len(moved) >= need:
            out.append((top, len(moved)))
            to = top + 1
        else:
            while heap and len(moved) < need - 1:
                moved.append(heapq.heappop(heap)[1])
            if not heap:
                break
            to = heap[0][0]
        for k in moved:
            x = lists[k]
            p = at[k] = bisect_left(x, to, at[k])
            if p < len(x):
                heapq.heappush(heap, (x[p], k))
    return out


def t_occurrence(lists: list[list[int]], need: int) -> list[tuple[int, int]]:
    """As merge_skip, but the longest lists are left out of the heap and binary-searched."""
    if len(lists) < need:
        return []
    if need == 1 or len(lists) == need == 2:
        long = 0
    else:
        longest = max(map(len, lists))
        long = min(need - 1, int(need / (0.01 * math.log2(longest + 1) + 1)))
    if not long:
        return merge_skip(lists, need)
    lists = sorted(lists, key=len)
    short, rest, out = lists[: len(lists) - long], lists[len(lists) - long :], []
    for x, n in merge_skip(short, need - long) if need - long > 1 else _count(short):
        for k, y in enumerate(rest):
            if n + len(rest) - k < need:
                break
            p = bisect_left(y, x)
            n += p < len(y) and y[p] == x
        if n >= need:
            out.append((x, n))
    return out


def _count(lists: list[list[int]]) -> list[tuple[int, int]]:
    seen: dict[int, int] = {}
    for x in lists:
        for i in x:
            seen[i] = seen.get(i, 0) + 1
    return list(seen.items())


def _mix(*parts: np.ndarray) -> np.ndarray:
    out = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ p.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            out = out ^ (out >> np.uint64(29))
    return out


class Order:
    """The global order of tokens and the signatures that follow from it."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, classes: int, threshold: float, hot: int, single: int = SINGLE, double: int = DOUBLE):
        by = np.argsort(hashes)
        self.hashes, self.counts = hashes[by], counts[by]
        self.classes, self.t, self.hot, self.single, self.double = max(classes, 1), threshold, hot, single, double

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        """Classes holding each token; 0 outside the dictionary."""
        if not len(self.hashes):
            return np.zeros(tokens.shape, np.int64)
        p = np.minimum(np.searchsorted(self.hashes, tokens), len(self.hashes) - 1)
        return np.where(self.hashes[p] == tokens, self.counts[p], 0)

    def need(self, n: int) -> int:
        """Least overlap of a set of n with any set similar to it."""
        return max(1, math.ceil(self.t * n - 1e-9))

    def signatures(self, tokens: np.ndarray, freq: np.ndarray):
        """Of sets of one size (rows in the global order): arrays row, key, greatest possible number of classes at the key."""
        n = tokens.shape[1]
        first = n - self.need(n) + 1
        rows, keys, most = [], [], []

        def add(mask, bound, *parts):
            r = np.nonzero(mask)[0]
            if len(r):
                rows.append(r)
                keys.append(_mix(*(p[r] if isinstance(p, np.ndarray) and p.ndim else np.full(len(r), p, np.int64) for p in parts)))
                most.append(bound[r])

        for i in range(first):
            a, fa = tokens[:, i], freq[:, i]
            wide = fa > self.single
            add(~wide, fa, a, 1)
            if n * self.t <= 1 + 1e-9:
                add(wide, fa, a, -1)
            for j in range(i + 1, min(first + 1, n)):
                b, fb = tokens[:, j], freq[:, j]
                wider = wide & (fa * fb / self.classes > self.double)
                add(wide & ~wider, fa, a, b, 2)
                if n * self.t <= 2 + 1e-9:
                    add(wider, fa, a, b, -2)
                if wider.any():
                    for k in range(j + 1, min(first + 2, n)):
                        add(wider, fa, a, b, tokens[:, k], 3)
        if not rows:
            return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(most)

    def key_of(self, shared: list[int], freq: list[int]) -> int:
        """The one signature at which two sets meet, from their first common tokens."""
        one = lambda *parts: int(_mix(*(np.array([p], np.int64) for p in parts))[0])
        if freq[0] <= self.single:
            return one(shared[0], 1)
        if len(shared) == 1:
            return one(shared[0], -1)
        if freq[0] * freq[1] / self.classes <= self.double:
            return one(*shared[:2], 2)
        return one(*shared[:2], -2) if len(shared) == 2 else one(*shared[:3], 3)


def _expand(order: Order):
    schema = pa.schema([("key", pa.int64()), ("block", pa.int32()), ("other", pa.int32()), ("cid", pa.int64()), ("toks", pa.binary())])

    def run(batches):
        for b in batches:
            col = b.column("toks")
            off, flat = np.asarray(col.offsets), np.asarray(col.flatten())
            off = off - off[0]
            cid, size = np.asarray(b.column("cid")), np.diff(off)
            freq = order.frequency(flat)
            by = np.lexsort((flat, freq, np.repeat(np.arange(len(cid)), size)))
            flat, freq = flat[by], freq[by]
            for n in np.unique(size):
                if n == 0:
                    continue
                at = np.nonzero(size == n)[0]
                for lo in range(0, len(at), 2000):
                    own = at[lo : lo + 2000]
                    m = off[own][:, None] + np.arange(n)
                    rows, keys, most = order.signatures(flat[m], freq[m])
                    if not len(rows):
                        continue
                    body = [flat[off[r] : off[r] + n].tobytes() for r in own]
                    blocks = np.maximum(1, -(-most // order.hot)).astype(np.int64)
                    mine = (_mix(cid[own][rows]) % blocks.astype(np.uint64)).astype(np.int64)
                    rep = np.repeat(np.arange(len(rows)), blocks)
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                    rows, mine, keys = rows[rep], mine[rep], keys[rep]
                    met = np.where(blocks[rep] > 1, _mix(keys, np.minimum(mine, other), np.maximum(mine, other)), keys)
                    for s in range(0, len(rows), 20_000):
                        e = slice(s, s + 20_000)
                        yield pa.record_batch([pa.array(met[e].view(np.int64)), pa.array(mine[e].astype(np.int32)), pa.array(other[e].astype(np.int32)), pa.array(cid[own][rows[e]]), pa.array([body[r] for r in rows[e]], pa.binary())], schema=schema)

    return run


def _probe(group: list[tuple[int, int, int, np.ndarray]], order: Order, t: float, key: int):
    """Similar pairs of one group. A class is probed against the lists of the smaller ones before it."""
    group.sort(key=lambda x: len(x[3]))
    lists: dict[int, list[int]] = {}
    toks = [g[3].tolist() for g in group]
    for r, own in enumerate(toks):
        n = len(own)
        for s, shared in t_occurrence([x for w in own if (x := lists.get(w))], order.need(n)):
            if shared < t * (n + len(toks[s]) - shared) - 1e-9:
                continue
            a, b = group[r], group[s]
            if a[1] == b[1] and a[2] != a[1]:
                continue  # this pair of the same block meets in that block's own group
            theirs = set(toks[s])
            common = [w for w in own if w in theirs][:3]
            k = order.key_of(common, order.frequency(np.array(common)).tolist())
            if max(1, -(-int(order.frequency(np.array(common[:1]))[0]) // order.hot)) > 1:
                k = int(_mix(np.array([k], np.uint64), np.array([min(a[1], b[1])]), np.array([max(a[1], b[1])]))[0])
            if k == key:
                yield a[0], b[0]
        for w in own:
            lists.setdefault(w, []).append(r)


def _join(order: Order, t: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        rest, key, out = [], None, []
        for b in batches:
            keys, cid = np.asarray(b.column("key")), np.asarray(b.column("cid"))
            block, other, body = np.asarray(b.column("block")), np.asarray(b.column("other")), b.column("toks")
            if not len(keys):
                continue
            cuts = [0, *(np.nonzero(np.diff(keys))[0] + 1).tolist(), len(keys)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if keys[lo] != key:
                    if len(rest) > 1:
                        out.extend(_probe(rest, order, t, key % (1 << 64)))
                    rest, key = [], int(keys[lo])
                    if hi - lo == 1 and hi < len(keys):
                        continue
                rest.extend((int(cid[i]), int(block[i]), int(other[i]), np.frombuffer(body[i].as_py(), np.int64)) for i in range(lo, hi))
            if len(out) > 50_000:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)
                out = []
        if len(rest) > 1:
            out.extend(_probe(rest, order, t, key % (1 << 64)))
        yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], schema=schema)

    return run


def similar_pairs(left: DataFrame, id_col: str, set_col: str, threshold: float = 0.6, right: DataFrame | None = None, dictionary: int = DICTIONARY, hot: int = HOT, single: int = SINGLE, double: int = DOUBLE) -> DataFrame:
    """Pairs (id_a, id_b) of rows whose sets reach the Jaccard `threshold` (> 0).

    Within `left`, id_a < id_b; with `right`, id_a is of `left` and id_b of `right`. Ids are longs and
    unique in their table; repeated rows count once and null ids are in no pair. Null and empty sets,
    and sets of blanks alone, are in no pair. Values meet as 64-bit hashes. Other columns are ignored,
    whatever their names. Empty tables give no rows.
    """
    spark, sides = left.sparkSession, [left] if right is None else [left, right]
    rows = None
    for k, df in enumerate(sides):
        one = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), normal_set(F.col(f"`{set_col}`")).alias("s"), F.lit(k).alias("side")).where("id is not null and size(s) > 0")
        rows = one if rows is None else rows.unionAll(one)
    rows = rows.select("id", "side", F.unhex(F.sha2(F.to_json(F.struct("s")), 256)).alias("k"), F.array_distinct(F.transform("s", lambda x: F.xxhash64(x))).alias("toks"))
    classes = cut(rows.groupBy("k").agg(F.min("id").alias("low"), F.first("toks").alias("toks")).select("k", F.xxhash64("k").alias("cid"), "toks"))
    seen = classes.select(F.explode("toks").alias("t")).groupBy("t").count().where("count > 1").orderBy(F.desc("count"), "t").limit(dictionary).toPandas()
    order = Order(seen["t"].to_numpy(np.int64), seen["count"].to_numpy(np.int64), classes.count(), threshold, hot, single, double)
    keyed = classes.select("cid", "toks").mapInArrow(_expand(order), "key long, block int, other int, cid long, toks binary")
    met = keyed.repartition(parallelism(spark), "key").sortWithinPartitions("key").mapInArrow(_join(order, threshold), "a long, b long")
    members = rows.select("id", "side", F.xxhash64("k").alias("cid")).distinct()
    same = classes.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    if right is None:
        ends = lambda c, i: members.select(F.col("cid").alias(c), F.col("id").alias(i))
        far = met.join(ends("a", "x"), "a").join(ends("b", "y"), "b").where("x != y")
        near = ends("a", "x").join(ends("a", "y"), "a").where("x < y")
        return far.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).unionAll(near.select(F.col("x").alias("id_a"), F.col("y").alias("id_b")))
    both = met.unionAll(met.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionAll(same)
    x = members.where("side = 0").select(F.col("cid").alias("a"), F.col("id").alias("id_a"))
    y = members.where("side = 1").select(F.col("cid").alias("b"), F.col("id").alias("id_b"))
    return both.join(x, "a").join(y, "b").select("id_a", "id_b")
