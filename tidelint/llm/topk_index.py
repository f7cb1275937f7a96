"""Exact top-k inner products over a bit-sliced index.

Components are turned to integers. A block of up to 16,384 vectors keeps, for
each component, six slices: bitmaps over the block's rows of its quantised value.
A query's weights are written in signed binary digits; the slices (or their
complements, for negative digits) are added up by carry-save bitmap arithmetic,
which gives slices of every row's score. Going down from the most significant
slice selects the k-th largest. What quantisation may have hidden is bounded by
the norms of the query and of the rows' remainders, so the rows within twice that
bound are the boundary rows; their integer scores are computed exactly.

Blocks and groups of queries are dealt to cells, each holding one block and at
most about 4,096 queries, so neither side is ever whole in a task. A cell returns
k rows a query.

A vector takes part if it is not null, holds neither null nor non-finite
components, and its id is not null; it meets vectors of its own length only. A
query does not meet rows of its own id; rows that repeat an id count once each
as candidates. Equal scores go to the smaller id. Scores are 64-bit integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelint.llm import frames

BITS = 6
_BLOCK = 16_384
_QUERIES = 4_096


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` with the largest products."""
    index = frames.stored(_blocks(vectors, scale, vec_id, vector))
    asked = frames.stored(_blocks(queries, scale, vec_id, vector))
    deep = index.agg(F.max("part"), F.max("seq")).first()
    n = asked.agg(F.sum("n"), F.max("seq")).first()
    groups = max(1, -(-(n[0] or 0) // _QUERIES))
    rows = (deep[1] or 0) + 1
    cells = ((deep[0] or 0) + 1) * rows
    sides = index.select((F.col("part") * rows + F.col("seq")).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("j"), "dim", "ids", "data")
    asks = asked.select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"), F.pmod(F.xxhash64("part", "seq"), F.lit(groups)).cast("int").alias("j"), "dim", "ids", "data")
    found = (sides.groupBy("i", "j").cogroup(asks.groupBy("i", "j"))
             .applyInArrow(_searched(k), "query_id bigint, vec_id bigint, score bigint"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _blocks(vectors: DataFrame, scale: float, vec_id: str, vector: str) -> DataFrame:
    """(part, seq, dim, n, ids, data): integer vectors in blocks, one length each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for dim, ids, data in _valid(batch, scale):
                old = held.pop(dim, (np.zeros(0, np.int64), np.zeros((0, dim), np.int64)))
                ids, data = np.concatenate([old[0], ids]), np.concatenate([old[1], data])
                while len(ids) >= _BLOCK:
                    yield _row(part, seq, ids[:_BLOCK], data[:_BLOCK])
                    seq, ids, data = seq + 1, ids[_BLOCK:], data[_BLOCK:]
                held[dim] = ids, data
        for ids, data in held.values():
            if len(ids):
                yield _row(part, seq, ids, data)
                seq += 1

    return vectors.select(F.col(vec_id).cast("bigint"), F.col(vector).cast("array<double>")).mapInArrow(
        run, "part int, seq int, dim int, n int, ids binary, data binary")


def _row(part: int, seq: int, ids: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "dim": pa.array([data.shape[1]], pa.int32()),
                            "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "data": pa.array([np.ascontiguousarray(data).tobytes()], pa.binary())})


def _valid(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each length: ids and integer vectors of the rows that take part."""
    ids, lists = batch.column(0), batch.column(1)
    whole = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
    lengths = np.asarray(lists.value_lengths().fill_null(-1))
    for dim in np.unique(lengths[whole]):
        rows = pa.array(np.flatnonzero(whole & (lengths == dim)))
        flat = lists.take(rows).flatten()
        x = np.asarray(flat.fill_null(np.nan), np.float64).reshape(len(rows), dim)
        fine = np.isfinite(x).all(1)
        if dim and fine.any():
            yield int(dim), np.asarray(ids.take(rows), np.int64)[fine], np.floor(scale * x[fine]).astype(np.int64)


class SlicedBlock:
    """Bitmaps over the rows of one block, by component and slice."""

    def __init__(self, ids: np.ndarray, data: np.ndarray) -> None:
        self.ids, self.data = ids, data
        n, d = data.shape
        self.low = data.min(0)
        spread = int((data.max(0) - self.low).max())
        self.shift = max(0, spread.bit_length() - BITS)
        coarse = (data - self.low) >> self.shift
        self.half = ((1 << self.shift) - 1) / 2
        rest = data - self.low - (coarse << self.shift) - self.half
        self.rest = float(np.sqrt((rest * rest).sum(1).max()))
        self.words = -(-n // 64)
        bits = np.zeros((2 * BITS * d, self.words), np.uint64)
        for b in range(BITS):
            packed = np.zeros((d, self.words * 8), np.uint8)
            packed[:, :-(-n // 8)] = np.packbits(((coarse >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            bits[b * d:(b + 1) * d] = packed.view(np.uint64)
        bits[BITS * d:] = ~bits[:BITS * d]
        self.bits = bits
        mask = np.zeros(self.words * 8, np.uint8)
        mask[:-(-n // 8)] = np.packbits(np.ones(n, np.uint8), bitorder="little")
        self.mask = mask.view(np.uint64)

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, least first, of the weighted sum of all components, less the same constant for every row."""
        d = len(query)
        size = np.abs(query)
        half = size >> 1
        both = size + half
        change = half ^ both
        plus, minus = both & change, half & change          # signed digits of |query|
        plus, minus = np.where(query < 0, minus, plus), np.where(query < 0, plus, minus)
        columns: list[list[np.ndarray]] = [[] for _ in range(int(both.max()).bit_length() + BITS)]
        for p in range(int(both.max()).bit_length()):
            rows = np.concatenate([np.flatnonzero((plus >> p) & 1), np.flatnonzero((minus >> p) & 1) + BITS * d])
            for b in range(BITS):
                columns[p + b].append(rows + b * d)
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        at = 0
        while at < len(columns) or carried:
            rows = np.concatenate(columns[at]) if at < len(columns) and columns[at] else np.zeros(0, np.int64)
            here = np.concatenate([self.bits[rows], *carried])
            carried = []
            while len(here) > 2:
                third = len(here) // 3
                a, b, c = here[:third], here[third:2 * third], here[2 * third:3 * third]
                x = a ^ b
                carried.append((a & b) | (x & c))
                here = np.concatenate([x ^ c, here[3 * third:]])
            if len(here) == 2:
                carried.append((here[0] & here[1])[None])
                here = (here[0] ^ here[1])[None]
            out.append(here[0] if len(here) else np.zeros(self.words, np.uint64))
            at += 1
        return out

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: within the bound of the k-th largest coarse score."""
        if len(self.ids) <= k:
            return np.arange(len(self.ids))
        slices = self.sums(query)
        among, need, value = self.mask, k, 0
        for w in range(len(slices) - 1, -1, -1):
            ones = among & slices[w]
            count = int(np.bitwise_count(ones).sum())
            if count >= need:
                among, value = ones, value | 1 << w
            else:
                need, among = need - count, among & ~slices[w]
        slack = 2 * float(np.sqrt((query.astype(float) ** 2).sum())) * self.rest / (1 << self.shift)
        least = max(0, value - int(slack * (1 + 1e-9)) - 1)
        more, same = np.zeros_like(self.mask), self.mask
        for w in range(len(slices) - 1, -1, -1):
            if least >> w & 1:
                same = same & slices[w]
            else:
                more, same = more | (same & slices[w]), same & ~slices[w]
        return np.flatnonzero(np.unpackbits((more | same).view(np.uint8), bitorder="little"))

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows of the block."""
        rows = self.boundary(query, k + int(np.count_nonzero(self.ids == query_id)))
        rows = rows[self.ids[rows] != query_id]
        scores = self.data[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def _unpacked(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for dim, ids, data in zip(table.column("dim").to_pylist(), table.column("ids").to_pylist(), table.column("data").to_pylist(), strict=True):
        yield dim, np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dim)


def _searched(k: int) -> Callable:
    def run(blocks: pa.Table, asks: pa.Table) -> pa.Table:
        query_ids, ids, scores = [], [], []
        for dim, own, data in _unpacked(blocks) if asks.num_rows else ():
            block = SlicedBlock(own, data)
            for width, asked, queries in _unpacked(asks):
                for query_id, query in zip(asked.tolist(), queries, strict=True) if width == dim else ():
                    i, s = block.best(query_id, query, k)
                    query_ids.append(np.full(len(i), query_id))
                    ids.append(i)
                    scores.append(s)
        join = lambda x: pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64))
        return pa.table({"query_id": join(query_ids), "vec_id": join(ids), "score": join(scores)})
    return run


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS a FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.a, v.a)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.a) = len(v.a)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
