"""Whole groups out of sorted Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups from batches sorted by group, with their starts."""
    pieces, tail = [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        ids = t.select(group).to_pandas()
        change = (ids != ids.shift()).any(axis=1).to_numpy()
        change[0] = tail is None or tuple(ids.iloc[0]) != tail
        tail = tuple(ids.iloc[-1])
        starts = np.flatnonzero(change)
        if len(starts) == 0:
            pieces.append(t)
            continue
        if starts[0] > 0:
            pieces.append(t.slice(0, int(starts[0])))
        if pieces:
            yield pa.concat_tables(pieces), [0]
        if len(starts) > 1:
            yield t.slice(int(starts[0]), int(starts[-1] - starts[0])), [int(x - starts[0]) for x in starts[:-1]]
        pieces = [t.slice(int(starts[-1]))]
    if pieces:
        yield pa.concat_tables(pieces), [0]
