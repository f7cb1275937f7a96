"""Embedding near duplicates through a pivot-permutation index.

A vector is described by its four nearest reference points (pivots), in order of
nearness. Pivots are vectors of a sample of at most 4,096 rows, the
one bounded collection on the driver, filled up with random directions; their number grows with the
root of the table from 64 to 1,024. The inverted lists are kept by pairs
of pivots, so two vectors meet in a list exactly if they share two pivots or
more; they are looked at in the list of their least shared pair only.

1. Each input partition first joins near-identical vectors to balls: those with
   equal pivots whose angle to their common mean is below nine tenths of half
   the limit angle. All members of a ball are linked to each other, whatever
   their number, so a group of copies is one entry from here on.
2. Balls enter the lists of the six pairs of their centre's pivots. Lists of one
   entry are dropped by their counts, and those of more than 2,048 are cut into blocks that
   meet block by block.
3. Within a list the angle of two centres and the radii say whether all, none or
   some members are linked. For the first a list returns sums per ball and a
   spanning forest of links, never the pairs. For the last the members
   of both balls are compared. Single vectors are compared by their cosine in double precision.
4. Components of the links of balls, and the least id of each.

A pair is linked if labels are equal and not null, both vectors have the same length and their cosine is at least
the limit. Null, empty and zero vectors and those that hold null or non-finite
components link with nothing, nor do rows without an id (n_links 0, component
null, kept). Rows that repeat an id are vectors of their own. An empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames

LIMIT = 0.93
PIVOTS = 4                          # nearest pivots of a vector
_SAMPLE, _LEAST, _MOST = 4_096, 64, 1_024
_LIST, _FEW = 2_048, 16
_CHUNK = 8_192
_BALL = "ball bigint, label string, dim int, centre binary, radius double, n bigint, least bigint, near array<int>, members array<bigint>"


def linked(vectors: DataFrame, limit: float = LIMIT, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors`."""
    rows = frames.stored(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("bigint").alias("vec_id"),
                                        F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v")))
    pivots = _pivots(rows)
    balls = frames.stored(rows.where("vec_id IS NOT NULL AND label IS NOT NULL").select("row", "vec_id", "label", "v").mapInArrow(_balls(pivots, limit), _BALL))
    found = frames.stored(_met(balls, limit))
    some = _some(rows, balls, found.where("kind = 1").select("a", "b"), limit)
    edges = found.where("kind = 2").select("a", "b").union(some.where("row IS NULL").select("a", "b"))
    roots = frames.components(edges.distinct())
    labelled = balls.join(roots.select(F.col("node").alias("ball"), "root"), "ball", "left").select("ball", "n", "least", "members", F.coalesce("root", "ball").alias("root"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    wide = found.where("kind = 0").groupBy(F.col("a").alias("ball")).agg(F.sum("n").alias("wide"))
    known = (labelled.join(least, "root").join(wide, "ball", "left")
             .select(F.explode("members").alias("row"), "component_id", (F.col("n") - 1 + F.coalesce("wide", F.lit(0))).alias("sure")))
    more = some.where("row IS NOT NULL").groupBy("row").agg(F.sum("n").alias("more"))
    counts = rows.select("row", "vec_id").join(known.join(more, "row", "left"), "row", "left")
    component = F.coalesce("component_id", "vec_id")
    return counts.select("vec_id", (F.coalesce("sure", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("bigint").alias("n_links"), component.alias("component_id"),
                         F.col("vec_id").eqNullSafe(component).alias("kept"))


def _pivots(rows: DataFrame) -> dict[int, np.ndarray]:
    """Pivots by the length of vectors."""
    size = min(_MOST, max(_LEAST, math.isqrt(rows.count())))
    sample = rows.where("v IS NOT NULL").orderBy(F.xxhash64("vec_id"), "row").limit(_SAMPLE).select("v").collect()
    by_length: dict[int, list[np.ndarray]] = {}
    for (v,) in sample:
        x = np.array([np.nan if c is None else c for c in v], np.float64)
        if len(x) and np.isfinite(x).all() and (x != 0).any():
            by_length.setdefault(len(x), []).append(_unit(x[None])[0])
    return {dim: _spread_out(np.stack(own), size) for dim, own in by_length.items()}


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _spread_out(sample: np.ndarray, size: int) -> np.ndarray:
    """`size` directions: vectors of the sample that are not close to one taken before, then random ones."""
    dim, taken = sample.shape[1], []
    for x in sample:
        if len(taken) == size:
            break
        if not taken or (np.stack(taken) @ x).max() < 0.9:
            taken.append(x)
    rest = size - len(taken)
    return np.concatenate([np.array(taken).reshape(-1, dim), _random(dim, rest)]) if rest else np.stack(taken)


def _random(dim: int, size: int) -> np.ndarray:
    return _unit(np.random.Generator(np.random.PCG64(dim)).normal(size=(size, dim)))


def _near(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first."""
    out = np.empty((len(x), min(PIVOTS, len(pivots))), np.int32)
    for at in range(0, len(x), 4096):
        close = -(x[at:at + 4096] @ pivots.T)
        best = np.argpartition(close, out.shape[1] - 1, axis=1)[:, :out.shape[1]]
        out[at:at + 4096] = np.take_along_axis(best, np.argsort(np.take_along_axis(close, best, 1), axis=1, kind="stable"), 1)
    return out


def _lists(column: pa.Array, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten()
    return np.asarray(flat.fill_null(np.nan), np.float64).reshape(len(rows), dim)


def _balls(pivots: dict[int, np.ndarray], limit: float) -> Callable:
    """Balls of the near-identical vectors of a task, `_CHUNK` rows at a time."""
    most = 0.9 * math.acos(limit) / 2

    def grouped(batch: pa.Table) -> Iterator[tuple]:
        column = batch.column("v").combine_chunks()
        whole = np.asarray(column.is_valid())
        lengths = np.where(whole, np.asarray(column.value_lengths().fill_null(0)), 0)
        row, vec, label = batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), np.asarray(batch.column("label").to_pylist(), object)
        for dim in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == dim)
            x = _lists(column, at, dim)
            fine = np.isfinite(x).all(1) & (x != 0).any(1)
            at, x = at[fine], x[fine]
            if not len(at):
                continue
            x = _unit(x)
            near = _near(x, pivots.get(dim, _random(dim, _LEAST)))
            _, code = np.unique(label[at], return_inverse=True)
            order = np.lexsort((*near.T[::-1], code))
            change = np.ones(len(at) + 1, bool)
            change[1:-1] = (code[order][1:] != code[order][:-1]) | (near[order][1:] != near[order][:-1]).any(1)
            edges = np.flatnonzero(change)
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                own = order[a:z]
                for members, centre, radius in _gathered(x[own], most):
                    rows = at[own[members]]
                    yield int(row[rows[0]]), label[rows[0]], dim, centre.tobytes(), radius, len(rows), int(vec[rows].min()), near[own[0]].tolist(), row[rows].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made() -> pa.RecordBatch:
            columns = list(zip(*grouped(pa.Table.from_batches(held)), strict=True)) or [[]] * 9
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            names = ["ball", "label", "dim", "centre", "radius", "n", "least", "near", "members"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                held.append(batch.slice(at, _CHUNK))
                if sum(b.num_rows for b in held) >= _CHUNK:
                    yield made()
                    held = []
        if held:
            yield made()
    return run


def _gathered(x: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Rows of `x` in balls of at most that radius around the mean of their members."""
    left = np.arange(len(x))
    while len(left) > 1:
        close = left[x[left] @ x[left[0]] >= math.cos(1.5 * most)]
        centre = x[close].mean(0)
        centre /= np.sqrt(centre @ centre)
        angle = np.arccos(np.clip(x[close] @ centre, -1, 1))
        inside = close[angle <= most]
        if left[0] not in inside or len(inside) == 1:
            yield left[:1], x[left[0]], 0.0
            left = left[1:]
            continue
        yield inside, centre, float(angle[angle <= most].max()) + 1e-7
        left = np.setdiff1d(left, inside, assume_unique=True)
    if len(left):
        yield left, x[left[0]], 0.0


def _met(balls: DataFrame, limit: float) -> DataFrame:
    """(kind, a, b, n): links of ball a with n vectors elsewhere (0), pairs of which some members may be linked (1), a forest of links (2)."""
    pairs = list(combinations(range(PIVOTS), 2))
    lists = F.explode(F.array(*[F.struct(F.least(F.col("near")[i], F.col("near")[j]).alias("p"), F.greatest(F.col("near")[i], F.col("near")[j]).alias("q")) for i, j in pairs]))
    thin = balls.select("label", "dim", lists.alias("key")).select("label", "dim", "key.*").groupBy("label", "dim", "p", "q").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    key = ["label", "dim", "p", "q"]
    full = balls.select("label", "dim", lists.alias("key"), "ball", "centre", "radius", "n", "near").select("label", "dim", "key.*", "ball", "centre", "radius", "n", "near")
    blocks = F.ceil(F.col("size") / _LIST).cast("int")
    own = F.pmod(F.xxhash64("ball"), F.col("blocks")).cast("int")
    dealt = (full.join(thin, key).withColumn("blocks", blocks).withColumn("block", own)
             .select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
             .drop("blocks", "other", "size"))
    cell = [*key, "low", "high"]
    return (dealt.repartition(*cell).sortWithinPartitions(*cell).select(*cell, "block", "ball", "centre", "radius", "n", "near")
            .mapInArrow(_compared(limit), "kind int, a bigint, b bigint, n bigint"))


class _Balls:
    """Balls of one cell."""

    def __init__(self, t: pa.Table) -> None:
        dim, p, q = t.column("dim")[0].as_py(), t.column("p").to_numpy()[:, None], t.column("q").to_numpy()[:, None]
        self.ball, self.block = t.column("ball").to_numpy(), t.column("block").to_numpy()
        self.radius, self.n = t.column("radius").to_numpy(), t.column("n").to_numpy()
        self.centre = np.frombuffer(b"".join(t.column("centre").to_pylist()), np.float64).reshape(-1, dim)
        near = np.array(t.column("near").to_pylist(), np.int32)
        # a pair that shares a pivot below q other than p meets in an earlier list
        self.earlier = np.where((near < q) & (near != p), near, -1)
        self.both = t.column("low")[0].as_py() != t.column("high")[0].as_py()

    def shared(self, a: slice, b: slice) -> np.ndarray:
        x, y = self.earlier[a], self.earlier[b]
        out = np.zeros((len(x), len(y)), bool)
        for i in range(x.shape[1]):
            for j in range(y.shape[1]):
                out |= (x[:, i, None] == y[None, :, j]) & (x[:, i, None] >= 0)
        return out


def _compared(limit: float) -> Callable:
    angle = math.acos(limit)

    def judged(cosine: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of balls: all members are linked, some may be."""
        apart, single = np.arccos(np.clip(cosine, -1, 1)), reach == 0
        sure = np.where(single, cosine >= limit, apart + reach <= angle - 1e-7)
        return sure, ~sure & ~single & (apart - reach <= angle + 1e-7)

    def compare(c: _Balls) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        size = len(c.ball)
        sums, root = np.zeros(size, np.int64), np.arange(size)
        order = np.argsort(c.block, kind="stable") if c.both else np.arange(size)
        for name in ("ball", "block", "radius", "n", "centre", "earlier"):
            setattr(c, name, getattr(c, name)[order])
        split = int(np.searchsorted(c.block, c.block.max())) if c.both else size
        forest: list[tuple[int, int]] = []
        for at in range(0, split if c.both else size, 512):
            a = slice(at, min(at + 512, split))
            b = slice(split, size) if c.both else slice(at, size)
            sure, maybe = judged(c.centre[a] @ c.centre[b].T, c.radius[a][:, None] + c.radius[b][None, :])
            new = ~c.shared(a, b)
            if not c.both:
                new &= np.arange(b.start, b.stop)[None, :] > np.arange(a.start, a.stop)[:, None]
            sure, maybe = sure & new, maybe & new
            sums[a] += sure @ c.n[b]
            sums[b] += c.n[a] @ sure
            i, j = np.nonzero(maybe)
            yield 1, c.ball[a][i], c.ball[b][j], np.zeros(len(i), np.int64)
            # each row hangs its own tree under those it is linked with
            for r in np.flatnonzero(sure.any(1)).tolist():
                trees = np.unique(root[np.flatnonzero(sure[r]) + b.start])
                mine = root[r + a.start]
                for other in trees[trees != mine].tolist():
                    forest.append((int(c.ball[mine]), int(c.ball[other])))
                    root[root == other] = mine
        some = np.flatnonzero(sums)
        yield 0, c.ball[some], c.ball[some], sums[some]
        ends = np.array(forest, np.int64).reshape(-1, 2)
        yield 2, ends[:, 0], ends[:, 1], np.zeros(len(ends), np.int64)

    def few(t: pa.Table, starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Cells of few balls at once, pair by pair."""
        dims = t.column("dim").to_numpy()
        for dim in np.unique(dims[starts]).tolist():
            firsts, seconds = [], []
            for size in np.unique(sizes).tolist():
                at = starts[(sizes == size) & (dims[starts] == dim)]
                i, j = np.triu_indices(size, 1)
                firsts.append((at[:, None] + i).ravel())
                seconds.append((at[:, None] + j).ravel())
            i, j = np.concatenate(firsts), np.concatenate(seconds)
            used, place = np.unique(np.concatenate([i, j]), return_inverse=True)
            i, j = place[:len(i)], place[len(i):]
            c = _Balls(t.take(pa.array(used)))
            new = np.ones(len(i), bool)
            for x in c.earlier.T:
                for y in c.earlier.T:
                    new &= (x[i] != y[j]) | (x[i] < 0)
            i, j = i[new], j[new]
            cosine = np.concatenate([np.einsum("ij,ij->i", c.centre[i[k:k + 65_536]], c.centre[j[k:k + 65_536]]) for k in range(0, len(i), 65_536)] or [np.zeros(0)])
            sure, maybe = judged(cosine, c.radius[i] + c.radius[j])
            yield 1, c.ball[i[maybe]], c.ball[j[maybe]], np.zeros(int(maybe.sum()), np.int64)
            i, j = i[sure], j[sure]
            yield 0, np.concatenate([c.ball[i], c.ball[j]]), np.concatenate([c.ball[i], c.ball[j]]), np.concatenate([c.n[j], c.n[i]])
            yield 2, c.ball[i], c.ball[j], np.zeros(len(i), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in _cells(batches):
            sizes = np.diff(np.append(starts, t.num_rows))
            small = (sizes > 1) & (sizes <= _FEW) & (t.column("low").to_numpy()[starts] == t.column("high").to_numpy()[starts])
            found = [compare(_Balls(t.slice(a, n))) for a, n in zip(starts[~small & (sizes > 1)].tolist(), sizes[~small & (sizes > 1)].tolist(), strict=True)]
            if small.any():
                found.append(few(t, starts[small], sizes[small]))
            for some in found:
                for kind, a, b, n in some:
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(n)], names=["kind", "a", "b", "n"])
    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole cells and where these start, of batches sorted by their first six columns."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        change = np.zeros(t.num_rows, bool)
        for c in range(6):
            k = np.asarray(t.column(c).to_pylist(), object) if c == 0 else t.column(c).to_numpy()
            change[1:] |= k[1:] != k[:-1]
        if held:
            change[0] = any(held[-1].column(c)[-1].as_py() != t.column(c)[0].as_py() for c in range(6))
        edges = np.flatnonzero(change)
        if not len(edges):
            held.append(t)
            continue
        if held:
            yield pa.concat_tables([*held, t.slice(0, int(edges[0]))]), np.zeros(1, np.int64)
        else:
            edges = np.append(0, edges)
        if len(edges) > 1:
            yield t.slice(int(edges[0]), int(edges[-1] - edges[0])), edges[:-1] - edges[0]
        held = [t.slice(int(edges[-1]))]
    if held:
        yield pa.concat_tables(held), np.zeros(1, np.int64)


def _some(rows: DataFrame, balls: DataFrame, pairs: DataFrame, limit: float) -> DataFrame:
    """(a, b, row, n): by their members, links of single rows (row, n) and of the balls (a, b; row is null) of `pairs`."""
    members = balls.select("ball", F.explode("members").alias("row")).join(rows.select("row", "v"), "row")
    asked = pairs.distinct().select("a", "b", F.explode(F.array("a", "b")).alias("ball"))
    return (asked.join(members, "ball").select("a", "b", (F.col("ball") == F.col("a")).alias("first"), "row", "v")
            .groupBy("a", "b").applyInArrow(_exact(limit), "a bigint, b bigint, row bigint, n bigint"))


def _exact(limit: float) -> Callable:
    def run(t: pa.Table) -> pa.Table:
        first, row = np.asarray(t.column("first").to_pylist(), bool), t.column("row").to_numpy()
        x = _unit(np.array(t.column("v").to_pylist(), np.float64))
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        n = np.zeros(len(row), np.int64)
        for at in range(0, len(left), 512):
            close = x[left[at:at + 512]] @ x[right].T >= limit
            n[left[at:at + 512]] += close.sum(1)
            n[right] += close.sum(0)
        some = np.flatnonzero(n)
        a, b = t.column("a")[0].as_py(), t.column("b")[0].as_py()
        rows = [*row[some].tolist(), *([None] if len(some) else [])]
        return pa.table({"a": pa.array([a] * len(rows), pa.int64()), "b": pa.array([b] * len(rows), pa.int64()), "row": pa.array(rows, pa.int64()),
                         "n": pa.array([*n[some].tolist(), *([0] if len(some) else [])], pa.int64())})
    return run


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.a) = len(y.a) AND list_cosine_similarity(x.a, y.a) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT d.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, d.vec_id) AS component_id, coalesce(c.component_id, d.vec_id) IS NOT DISTINCT FROM d.vec_id AS kept
FROM embeddings d LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
