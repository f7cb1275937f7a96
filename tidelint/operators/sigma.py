"""Robust local spread: 1.4826 x rolling MAD with a standard-deviation fallback.

The window length differs from series to series, which a row frame (a literal)
cannot express, and a sliding exact median costs O(n w) in the window operator.
Each task therefore takes one bounded piece of one series: runs of 65,536 positions or
two windows, whichever is more, with a window of neighbours on either side, so that a row is in
three pieces at most. A worker holds one piece at a time. Inside a piece the medians of all windows are found
together: values become ranks, and every window descends the bits of its median's rank at once,
from the counts of zero bits before its two ends (a wavelet matrix of which only
one level is held). That is O(n log n) whatever the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelint.operators.batches import whole_groups
from tidelint.operators.ordering import Cuts, FirstAfter, Last, measured, ordered
from tidelint.operators.ordering import kept as keep
from tidelint.operators.stats import attach_medians

MIN_SAMPLES = 11           # shorter windows cannot estimate a local spread
MAD_TO_SIGMA = 1.4826
_LEAST_VALUES = 3          # a window with fewer values has no spread
_RUN = 1 << 16             # positions of a piece whose windows are short; a worker holds whole pieces


def attach_global_sigma(df: DataFrame, keys, columns: dict[str, Column], cuts: Cuts | None = None) -> DataFrame:
    """Whole-series spread on every row: 1.4826 MAD, or population std when MAD is 0."""
    kept = [F.col(f"`{c}`") for c in df.columns]
    cuts = cuts or measured(df, keys, ())
    work = attach_medians(df, keys, {f"_m_{n}": v for n, v in columns.items()}, cuts, {f"_p_{n}": F.stddev_pop(v) for n, v in columns.items()})
    work = attach_medians(work, keys, {f"_d_{n}": F.abs(v - F.col(f"_m_{n}")) for n, v in columns.items()}, cuts)
    return work.select(*kept, *[
        F.when(F.col(f"_d_{n}") * MAD_TO_SIGMA > 0, F.col(f"_d_{n}") * MAD_TO_SIGMA)
        .otherwise(F.col(f"_p_{n}")).alias(n) for n in columns])


class Windows:
    """Centred windows of ``size`` rows over ordered values; an even one reaches one row further back.

    Statistics are of the values that are not NaN, NaN for windows with fewer
    than three.
    """

    def __init__(self, values: np.ndarray, size: int):
        self.there = np.flatnonzero(~np.isnan(values))
        self.values = values[self.there]
        n, ahead = len(values), (size - 1) // 2
        seen = np.zeros(n + 1, np.int32)
        np.cumsum(~np.isnan(values), out=seen[1:])
        row = np.arange(n)
        self.left = seen[np.maximum(row + ahead + 1 - size, 0)]
        self.right = seen[np.minimum(row + ahead + 1, n)]
        self.enough = self.right - self.left >= _LEAST_VALUES

    def median(self) -> np.ndarray:
        out = np.full(len(self.left), np.nan)
        if self.enough.any():
            left, right = self.left[self.enough], self.right[self.enough]
            size = right - left
            distinct, ranks = np.unique(self.values, return_inverse=True)
            low = distinct[_selected(ranks, left, right, (size - 1) // 2)]
            even = size % 2 == 0
            if even.any():
                low[even] = (low[even] + distinct[_selected(ranks, left[even], right[even], size[even] // 2)]) / 2
            out[self.enough] = low
        return out

    def deviation(self, rows: np.ndarray) -> np.ndarray:
        """Sample standard deviation of the windows of some rows; exactly 0 where all values are equal."""
        out = np.full(len(rows), np.nan)
        fine = self.enough[rows]
        left, right = self.left[rows[fine]], self.right[rows[fine]]
        size = (right - left).astype(np.longdouble)
        centred = (self.values - np.mean(self.values)).astype(np.longdouble) if len(self.values) else self.values
        first, second = (np.concatenate([[0], np.cumsum(x)]) for x in (centred, centred * centred))
        total = first[right] - first[left]
        spread = np.maximum(second[right] - second[left] - total * total / size, 0) / (size - 1)
        changes = np.concatenate([[0, 0], np.cumsum(self.values[1:] != self.values[:-1])])
        same = changes[right] == changes[np.minimum(left + 1, len(changes) - 1)]
        out[fine] = np.where(same, 0.0, np.sqrt(spread).astype(np.float64))
        return out


def _selected(ranks: np.ndarray, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest rank (from 0) inside each range [left, right) of ``ranks``."""
    ranks, left, right, k = (x.astype(np.int32) for x in (ranks, left, right, k))
    out = np.zeros(len(k), np.int32)
    for bit in range(int(ranks.max()).bit_length() - 1, -1, -1):
        ones = (ranks >> bit) & 1 == 1
        zeros = np.zeros(len(ranks) + 1, np.int32)
        np.cumsum(~ones, out=zeros[1:])
        a, z = zeros[left], zeros[right]
        up = k >= z - a
        out |= up.astype(np.int32) << bit
        # zero bits keep their order in front, one bits behind them
        left, right = np.where(up, zeros[-1] + left - a, a), np.where(up, zeros[-1] + right - z, z)
        k = np.where(up, k - (z - a), k)
        ranks = np.concatenate([ranks[~ones], ranks[ones]])
    return out


def local_spread(values: np.ndarray, size: int) -> np.ndarray:
    """Local spread of one ordered piece of a series, NaN for rows whose window holds too few values."""
    own = Windows(values, size)
    spread = MAD_TO_SIGMA * Windows(np.abs(values - own.median()), size).median()
    flat = np.flatnonzero(~(spread > 0))
    if len(flat):
        spread[flat] = own.deviation(flat)
    return spread


def filled(spread: np.ndarray) -> np.ndarray:
    """Rows without a spread take that of the next row that has one, else of the last before them."""
    known = np.flatnonzero(~np.isnan(spread))
    if not len(known):
        return spread
    return spread[known[np.minimum(np.searchsorted(known, np.arange(len(spread))), len(known) - 1)]]


def rolling_sigma(df: DataFrame, keys, pos: str, n: str,
                  columns: dict[str, tuple[Column, str | None]], cuts: Cuts | None = None) -> DataFrame:
    """Add one spread column per entry of ``columns``: {out: (value, window column)}.

    ``pos`` numbers the rows of a series from 0 and ``n`` is its row count. A
    window that is too short, or covers the series, uses the whole-series
    spread; ``None`` always does, and then nothing leaves the JVM.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    kept = list(df.columns)
    cuts = cuts or measured(df, keys, pos)
    whole = attach_global_sigma(df, keys, {f"_g_{o}": v for o, (v, _w) in columns.items()}, cuts)
    windows = {o: w for o, (_v, w) in columns.items() if w is not None}
    outs = list(columns)
    if not windows:
        return whole.withColumnsRenamed({f"_g_{o}": o for o in outs})
    work = whole.withColumns({f"_v_{o}": columns[o][0] for o in windows})
    schema = T.StructType(list(df.schema.fields) + [T.StructField(o, T.DoubleType()) for o in outs])
    group = [*keys, "_part"]
    if cuts.none:
        piece = work.withColumns({"_part": F.lit(0).cast("bigint"), "_size": F.lit(2**62)})
    else:
        reach = F.greatest(*[F.when((F.col(w) >= MIN_SAMPLES) & (F.col(w) < F.col(n)), F.col(w))
                             .otherwise(F.lit(0)) for w in windows.values()], F.lit(0)).cast("long")
        size = F.greatest(F.lit(min(cuts.rows, _RUN)), 2 * reach)
        first, last = F.floor((F.col(pos) - reach) / size), F.floor((F.col(pos) + reach) / size)
        spread = F.sequence(F.greatest(first, F.lit(0)).cast("long"), F.least(last, F.floor((F.col(n) - 1) / size)).cast("long"))
        piece = work.withColumn("_size", size).withColumn("_part", F.explode(spread))
    one_piece = cuts.none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbers(t: pa.Table, name: str) -> np.ndarray:
            return t.column(name).to_pandas().to_numpy(dtype="float64")

        for t, starts in whole_groups(batches, group):
            out = t.select(kept)
            bounds = list(zip(starts, [*starts[1:], t.num_rows], strict=True))
            length = numbers(t, n)
            for o in outs:
                sigma = numbers(t, f"_g_{o}").copy()
                if o in windows:
                    win, values = numbers(t, windows[o]), numbers(t, f"_v_{o}")
                    for a, z in bounds:
                        if MIN_SAMPLES <= win[a] < length[a]:
                            local = local_spread(values[a:z], int(win[a]))
                            sigma[a:z] = filled(local) if one_piece else local
                out = out.append_column(o, pa.array(sigma, from_pandas=True))
            if not one_piece:
                own = t.column(pos).to_numpy() // t.column("_size").to_numpy() == t.column("_part").to_numpy()
                out = out.filter(pa.array(own))
            del t
            yield from out.to_batches()
            del out                                     # before the next piece is read

    # many short groups share a batch, so the cost per series stays small
    rolled = piece.repartition(*group).sortWithinPartitions(*group, pos).mapInArrow(run, schema)
    if one_piece:
        return rolled
    rolled = keep(rolled)
    # windows with fewer than three values take the nearest later spread, else the earlier
    s = ordered(rolled, keys, pos, cuts.at(pos)).scan(
        **{f"_n_{o}": FirstAfter(o) for o in outs}, **{f"_p_{o}": Last(o) for o in outs})
    return s.rows.select(*[F.col(f"`{c}`") for c in kept], *[
        F.coalesce(F.col(f"_n_{o}"), F.col(f"_p_{o}")).alias(o) for o in outs])
