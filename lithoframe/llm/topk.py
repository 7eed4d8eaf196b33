"""Exact top-k by inner product over a bit-sliced index.

Components are quantised to integers. A block of candidates keeps, for each dimension and bit, a bitmap over its
rows; a query's scores are added up as bitmaps with carry-save adders, and its best rows are picked from the most
significant slice downward, ties at the boundary by smaller id. Rows and queries meet in a grid of blocks, each
of a bounded number of rows, so every candidate is scored for every query without a cross join; the best of
each block are merged by query.

Cases: vectors that are null or hold a null or a non-finite component take no part, nor do null ids; vectors of
different lengths are not compared; a query's candidates are the rows with another id, so with repeated ids
none of the query's own rows, and the least of its vectors is the query; fewer candidates than k give all of them;
quantised components and scores beyond 64 bits are the nearest 64-bit integer (components without the least one), and
nothing else about large ones differs: rows with components of 2^31 or more are scored beside the index in
integers of any size; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle, table

SCALE = 64
K = 20
BLOCK_CELLS = 1 << 22  # components in a block, about
BIG = 1 << 31  # size of a component that the index does not hold
LONG = (1 << 63) - 1
CHUNK_QUERIES = 1 << 12
LEAST_TASKS = 16
LEAST_CHUNK = 128
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, q (array of bigint), of those that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda v: F.greatest(F.floor(v.cast("double") * scale), F.lit(-LONG))).alias("q"))  # floor ends at 64 bits


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size, then the nearest 64-bit ones."""
    return np.array([max(-LONG - 1, min(LONG, s)) for s in x.astype(object) @ q.astype(object)], np.int64)


def leading(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, ~scores))[:k]
    return ids[order], scores[order]


def signed_digits(q: np.ndarray) -> list[np.ndarray]:
    """Digits -1, 0 and 1 of integers to base 2, least significant first, no two neighbours set: a third of them is."""
    out, left = [], q.astype(np.int64)
    while left.any():
        digit = np.where(left & 1 == 1, 2 - (left & 3), 0)
        out.append(digit)
        left = (left - digit) >> 1
    return out


class SlicedBlock:
    """Bitmaps by dimension and bit over rows in the order of their ids; rows with big components stand beside them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order].astype(np.int64, copy=False)
        size = np.abs(x)
        big = (size >= BIG).any(1)
        few = slice(None) if not big.any() else ~big  # a slice copies nothing
        self.big_ids, self.big = ids[big], x[big]
        self.ids, self.x = ids[few], x[few]
        self.reach = size[few].max(0, initial=0).astype(float)
        n, d = self.x.shape
        if not n:
            return
        up = self.x - self.x.min(0)
        most = int(up.max(initial=0))
        self.bits = max(1, most.bit_length())
        words = -(-n // 64)
        wide = np.zeros((d, words * 64), np.min_scalar_type(most))  # a dimension is a row of the smallest integers that hold it
        wide[:, :n] = up.T
        self.slices = np.empty((2, d, self.bits, words), np.uint64)
        for j in range(self.bits):
            self.slices[0, :, j] = np.packbits(wide & wide.dtype.type(1 << j), axis=1, bitorder="little").view(np.uint64)
        self.slices[1] = ~self.slices[0]
        self.room = [np.empty((0, words), np.uint64)] * 3  # for sums, used again by the next query
        self.valid = np.packbits(np.arange(words * 64) < n, bitorder="little").view(np.uint64)

    def sums(self, q: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the scores plus a constant: negative digits of a weight count complements."""
        terms: dict[int, list[np.ndarray]] = {}  # weight of two -> places of slices
        for i, digit in enumerate(signed_digits(q)):
            for sign, value in enumerate((1, -1)):
                dims = np.flatnonzero(digit == value)
                if len(dims):
                    for j in range(self.bits):
                        terms.setdefault(i + j, []).append((sign * self.x.shape[1] + dims) * self.bits + j)
        places = [np.concatenate(terms[w]) if w in terms else np.empty(0, np.int64) for w in range(max(terms, default=-1) + 1)]
        flat = self.slices.reshape(-1, len(self.valid))
        rows, load = 1, 0
        for at in places:  # a column holds its own slices and the carries of the one below
            load = len(at) + load // 2 + 1
            rows = max(rows, load)
        if len(self.room[0]) < rows:
            self.room = [np.empty((rows, len(self.valid)), np.uint64) for _ in range(3)]
        stack, above, spare = self.room
        out, carried, w = [], 0, 0
        while w < len(places) or carried:
            n = carried
            if w < len(places):
                n += len(places[w])
                np.take(flat, places[w], axis=0, out=stack[carried:n], mode="clip")
            carried = 0
            while n > 2:
                t = n // 3
                r = n - 3 * t  # these wait
                a, b, c, odd, carry = stack[r : r + t], stack[r + t : r + 2 * t], stack[r + 2 * t : n], spare[:t], above[carried : carried + t]
                np.bitwise_xor(a, b, out=odd)
                np.bitwise_xor(a, c, out=carry)
                np.bitwise_and(carry, odd, out=carry)
                np.bitwise_xor(carry, a, out=carry)  # c where a and b differ, else a
                np.bitwise_xor(odd, c, out=a)
                n = r + t
                carried += t
            if n == 2:
                np.bitwise_and(stack[0], stack[1], out=above[carried])
                np.bitwise_xor(stack[0], stack[1], out=stack[0])
                carried += 1
            out.append(stack[0].copy() if n else np.zeros_like(self.valid))
            stack, above = above, stack
            w += 1
        return out

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of other ids, all if fewer."""
        if not len(self.ids):
            found = np.empty(0, np.int64), np.empty(0, np.int64)
        elif self.reach @ np.abs(q).astype(float) > LONG / 2:
            other = self.ids != query_id
            found = leading(self.ids[other], exact(self.x[other], q), k)
        else:
            found = self._picked(query_id, q, k)
        other = self.big_ids != query_id
        if not other.any():
            return found
        return leading(np.concatenate([found[0], self.big_ids[other]]), np.concatenate([found[1], exact(self.big[other], q)]), k)

    def _picked(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = np.searchsorted(self.ids, [query_id, query_id + 1])
        open_ = self.valid.copy()
        if lo < hi:
            own = np.zeros(len(open_) * 64, np.uint8)
            own[lo:hi] = 1
            open_ &= ~np.packbits(own, bitorder="little").view(np.uint64)
        sure = np.zeros_like(open_)
        for s in reversed(self.sums(q)):
            more = sure | open_ & s
            n = int(np.bitwise_count(more).sum())
            if n >= k:
                open_ &= s
            else:
                sure = more
                open_ &= ~s
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
        first = rows(sure)
        at = np.concatenate([first, rows(open_)[: max(0, k - len(first))]])
        return self.ids[at], self.x[at] @ q


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """quantised vectors and a condition for queries -> query_id, rank, vec_id, score."""
    rows = settle(vectors.withColumn("row", F.monotonically_increasing_id()))  # numbers that stay, so equal rows spread
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("q").alias("q"))
    cells, m = rows.agg(F.sum(F.size("q") + 1)).first()[0] or 0, asked.count()
    r = max(1, -(-cells // BLOCK_CELLS))
    c = max(-(-m // CHUNK_QUERIES), min(-(-m // LEAST_CHUNK), -(-LEAST_TASKS // r)), 1)
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    held = rows.select("vec_id", "q", F.lit(False).alias("asks"), F.pmod(F.xxhash64("vec_id", "row"), F.lit(r)).cast("int").alias("r"), every(c).alias("c"))
    asking = asked.select("vec_id", "q", F.lit(True).alias("asks"), every(r).alias("r"), F.pmod(F.xxhash64("vec_id"), F.lit(c)).cast("int").alias("c"))

    def run(key: tuple, cell: pa.Table) -> pa.Table:
        asks = cell.column("asks").to_numpy()
        ids = cell.column("vec_id").to_numpy()
        arrays = cell.column("q").combine_chunks()
        sizes = pa.compute.list_value_length(arrays).to_numpy()
        values = arrays.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        out: list[tuple] = []
        for d in np.unique(sizes[asks]):
            part = lambda which, d=d: values[(starts[:-1][which, None] + np.arange(d)).reshape(-1)].reshape(len(which), d)
            mine, theirs = np.flatnonzero(~asks & (sizes == d)), np.flatnonzero(asks & (sizes == d))
            if len(mine):
                block = SlicedBlock(ids[mine], part(mine))
                for query_id, q in zip(ids[theirs], part(theirs).astype(np.int64), strict=True):
                    found, score = block.best(query_id, q, k)
                    out.append((np.full(len(found), query_id), found, score))
        cols = [np.concatenate([o[i] for o in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    best = held.unionByName(asking).groupBy("r", "c").applyInArrow(run, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(quantised(table(spark, sf_dir, "embeddings")), is_query=F.col("vec_id") % 20 == 0)


QUERIES = {"op3_topk": op3_topk}
ORACLE_SQL = {
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN abs(CAST(x AS DOUBLE)) < 1e17 THEN CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT) WHEN x > 0 THEN 9223372036854775807 ELSE -9223372036854775807 END) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, min(q) AS q FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])), 0) AS score
      FROM a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
c AS (SELECT query_id, vec_id, CAST(greatest(least(score, 9223372036854775807), -9223372036854775808) AS BIGINT) AS score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM c) WHERE rank <= 20
"""
}
