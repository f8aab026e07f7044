"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers, floor(scale * x). In a block of candidates, each attribute is
held as bit slices: bitmaps over the block's rows, one a binary digit of the attribute's
distance from its least value (or to its greatest, for queries that weigh it negatively),
so that all that is added is positive. A query adds, for every set bit of its weights, the
attribute's slices shifted by that bit: bitmaps of equal weight are reduced three to two by
full adders, bitwise, until one bitmap a digit of the sum is left. The top rows are then
selected from the most significant slice downward: rows surely in, rows still level. Rows that
stay level at the end have equal sums, and those boundary rows are resolved exactly, by
their integer scores and the smaller id.

Blocks are bounded: candidates and queries are dealt into blocks by a hash of their ids, and each
pair of blocks meets in one task, so neither side is ever whole in one place. Every candidate
of every block is scored; there is no pruning that could lose one.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor
do null ids; only vectors of equal dimension are compared; a query never meets rows of its
own id; repeated rows are candidates each on its own; fewer candidates than k give fewer
rows; an empty table gives an empty table; other columns are ignored. Components whose integers
lie beyond 64 bits count as the nearest that fits; a block whose sums could pass 63 bits is scored in
integers of any size, and a score beyond 64 bits counts as the nearest that fits.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Attributes of the candidates of a block, and queries of a block: at most, and, while there are fewer tasks than cores, at least.
BLOCK_CELLS, QUERY_ROWS, FEW_QUERIES = 1 << 22, 4_096, 32
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def quantised(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """id, dim, q array<bigint>: the rows that take part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(F.col(vector)) > 0)
    rows = vectors.filter(usable).select(F.col(key).cast("bigint").alias("id"), x.alias("x")).filter(F.forall("x", finite))
    return rows.select("id", F.size("x").alias("dim"), F.transform("x", lambda v: F.floor(v * scale).cast("bigint")).alias("q"))


def _packed(bits: np.ndarray, words: int) -> np.ndarray:
    """Rows of booleans to bitmaps of 64-bit words."""
    raw = np.packbits(bits, axis=-1, bitorder="little")
    out = np.zeros((*raw.shape[:-1], words * 8), np.uint8)
    out[..., : raw.shape[-1]] = raw
    return out.view(np.uint64)


class BitSlicedIndex:
    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.n, self.dim = rows.shape
        self.words = -(-self.n // 64)
        self.low, self.high = rows.min(0), rows.max(0)
        self.digits = [int(v).bit_length() for v in self.high - self.low]
        self.up = [self._slices(rows[:, d] - self.low[d], self.digits[d]) for d in range(self.dim)]
        self.down = [self._slices(self.high[d] - rows[:, d], self.digits[d]) for d in range(self.dim)]
        self.all = _packed(np.ones(self.n, bool), self.words)

    def _slices(self, values: np.ndarray, digits: int) -> list[np.ndarray]:
        return [_packed((values >> b & 1).astype(bool), self.words) for b in range(digits)]

    def added(self, query: list[int]) -> list[np.ndarray]:
        """Slices of the sum, without its constant part, from the least significant on."""
        columns: list[list[np.ndarray]] = []

        def put(digit: int, bitmap: np.ndarray) -> None:
            while len(columns) <= digit:
                columns.append([])
            columns[digit].append(bitmap)

        for d, w in enumerate(query):
            slices, weight, shift = (self.up[d], w, 0) if w > 0 else (self.down[d], -w, 0)
            while weight:
                if weight & 1:
                    for b, s in enumerate(slices):
                        put(shift + b, s)
                weight >>= 1
                shift += 1
        digit = 0
        while digit < len(columns):
            level = columns[digit]
            while len(level) > 1:
                a, b = level.pop(), level.pop()
                half = a ^ b
                if level:
                    c = level.pop()
                    put(digit + 1, (a & b) | (half & c))
                    level.insert(0, half ^ c)
                else:
                    put(digit + 1, a & b)
                    level.append(half)
            digit += 1
        return [c[0] if c else np.zeros(self.words, np.uint64) for c in columns]

    def top(self, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
        """(id, score) of the k best of this block, ties to the smaller id."""
        level = self.all
        own = np.flatnonzero(self.ids == query_id)
        if len(own):
            mask = np.ones(self.n, bool)
            mask[own] = False
            level = _packed(mask, self.words)
        count = lambda bitmap: int(np.bitwise_count(bitmap).sum())
        sure = np.zeros(self.words, np.uint64)
        missing = k
        if count(level) > missing:
            for s in reversed(self.added(query)):
                high = level & s
                n = count(high)
                if n > missing:
                    level = high
                elif n == missing:
                    sure, level, missing = sure | high, np.zeros(self.words, np.uint64), 0
                    break
                else:
                    sure, level, missing = sure | high, level & ~s, missing - n
        rows = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: self.n])
        chosen = rows(sure)
        boundary = rows(level)
        if len(boundary) > missing:  # equal sums: the smaller ids
            boundary = boundary[np.argsort(self.ids[boundary], kind="stable")[:missing]]
        chosen = np.concatenate((chosen, boundary))
        scores = self.rows[chosen] @ np.array(query, np.int64)
        order = np.lexsort((self.ids[chosen], -scores))[:k]
        return [(int(self.ids[chosen[i]]), int(scores[i])) for i in order]


def exact_top(ids: np.ndarray, rows: np.ndarray, query_id: int, query: list[int], k: int) -> list[tuple[int, int]]:
    """The same in integers of any size, for components that slices of 64 bits cannot add."""
    far = 1 << 63
    scored = [(min(max(sum(a * b for a, b in zip(row, query, strict=True)), -far), far - 1), i) for i, row in zip(ids.tolist(), rows.tolist(), strict=True) if i != query_id]
    return [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, <key>, score. `is_query`: a condition on the id, named `id`."""
    rows = quantised(vectors, key, vector, scale)
    size = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q"), F.coalesce(F.sum("dim"), F.lit(0)).alias("cells")).first()
    n_blocks = max(1, -(-size["cells"] // BLOCK_CELLS))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-size["q"] // QUERY_ROWS), min(-(-cores // n_blocks), -(-size["q"] // FEW_QUERIES)))
    block = lambda n: F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("dim", block(n_blocks).alias("cb"), spread(q_blocks).alias("qb"), "id", "q")
    queries = rows.filter(is_query).select("dim", spread(n_blocks).alias("cb"), block(q_blocks).alias("qb"), "id", "q")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if left.num_rows and right.num_rows:
            ids = left.column("id").to_numpy()
            flat = left.column("q").combine_chunks().flatten().to_numpy()
            block, queries_ = flat.reshape(len(ids), -1), right.column("q").to_pylist()
            largest = max(abs(int(block.min())), abs(int(block.max())))
            if 2 * largest * max(sum(map(abs, q)) for q in queries_) < 1 << 62:
                top = BitSlicedIndex(ids, block).top
            else:
                top = functools.partial(exact_top, ids, block)
            for query_id, query in zip(right.column("id").to_pylist(), queries_, strict=True):
                out += [(query_id, i, s) for i, s in top(query_id, query, k)]
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), columns, strict=True)})

    keys = ("dim", "cb", "qb")
    found = candidates.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(meet, "query_id bigint, id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(key), "score")
