"""Wide peaks of a series: the first turning point of a cast.

A peak is a value, or a run of equal ones, above both its neighbours. Around it
lies all that is not higher; its prominence is its height above the higher of
the two lowest values there, left and right, and its width is measured, by linear
interpolation, half the prominence below it. A missing value counts as higher than any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.operators.batches import whole_groups

# Least widths of a turning point in samples, tried in this order.
TURN_WIDTHS = (100.0, 50.0)


def _higher(x: np.ndarray) -> np.ndarray:
    """Place of the nearest higher value before each one, -1 where there is none."""
    out, stack = np.empty(len(x), np.int64), []
    for i, v in enumerate(x.tolist()):
        while stack and stack[-1][1] <= v:
            stack.pop()
        out[i] = stack[-1][0] if stack else -1
        stack.append((i, v))
    return out


class _Lowest:
    """Place of the lowest value in any range, the last one where several are equal."""

    def __init__(self, x: np.ndarray):
        self.x, self.levels, width = x, [np.arange(len(x))], 1
        while 2 * width <= len(x):
            a, b = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(x[b] <= x[a], b, a))
            width *= 2

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(float))[1] - 1
        out = np.empty(len(first), np.int64)
        for k in np.unique(level).tolist():
            here = level == k
            a, b = self.levels[k][first[here]], self.levels[k][last[here] - (1 << k) + 1]
            out[here] = np.where(self.x[b] <= self.x[a], b, a)
        return out


def peak_widths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all peaks (the middle of equal values) and their widths in samples."""
    x = np.where(np.isnan(values), np.inf, values)
    steps = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)
    runs = x[steps[:-1]]
    inner = np.arange(1, len(runs) - 1)
    tops = inner[(runs[inner] > runs[inner - 1]) & (runs[inner] > runs[inner + 1]) & np.isfinite(runs[inner])] if len(inner) else inner
    at = (steps[tops] + steps[tops + 1] - 1) // 2
    if not len(at):
        return at, np.zeros(0)
    before, behind = _higher(x)[at] + 1, len(x) - 2 - _higher(x[::-1])[len(x) - 1 - at]
    left = _Lowest(x)(before, at)
    right = len(x) - 1 - _Lowest(x[::-1])(len(x) - 1 - behind, len(x) - 1 - at)
    level = x[at] - (x[at] - np.maximum(x[left], x[right])) / 2
    widths = np.zeros(len(at))
    # a peak is no wider than the distance of its two lowest places
    for i in np.flatnonzero(right - left >= min(TURN_WIDTHS)).tolist():
        a = left[i] + int(np.flatnonzero(x[left[i]:at[i]] <= level[i])[-1])
        z = at[i] + int(np.flatnonzero(x[at[i]:right[i] + 1] <= level[i])[0])
        start = a + (level[i] - x[a]) / (x[a + 1] - x[a])
        stop = z - (level[i] - x[z]) / (x[z - 1] - x[z])
        widths[i] = stop - start
    return at, widths


def turning_point(values: np.ndarray) -> int | None:
    """The first peak of width 100 or more, else of 50 or more."""
    at, widths = peak_widths(values)
    for least in TURN_WIDTHS:
        wide = np.flatnonzero(widths >= least)
        if len(wide):
            return int(at[wide[0]])
    return None


def turning_points(df: DataFrame, keys, by, value: str) -> DataFrame:
    """(keys, turn) of every series: the row number (from 0) of its turning point, null where it has none.

    Casts stream through the tasks in order; one cast's values (eight bytes
    each) are held at a time.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = [by] if isinstance(by, str) else list(by)
    kinds = dict(df.dtypes)
    work = df.select(*[F.col(f"`{k}`") for k in dict.fromkeys([*keys, *by])], F.col(f"`{value}`").cast("double").alias("_v"))
    schema = ", ".join([*[f"`{k}` {kinds[k]}" for k in keys], "turn bigint"])
    return (work.repartition(*keys).sortWithinPartitions(*keys, *by).select(*keys, "_v").mapInArrow(_turns(keys), schema))


def _turns(keys: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            values = table.column("_v").to_pandas().to_numpy(dtype="float64")
            turns = [turning_point(values[a:z]) for a, z in zip(starts, [*starts[1:], table.num_rows], strict=True)]
            heads = table.select(keys).take(pa.array(starts))
            yield from heads.append_column("turn", pa.array(turns, pa.int64())).combine_chunks().to_batches()
    return run
