"""Current-profiler rows: one per record and depth cell."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelint.functions.flags import (BAD, DISMISSED, GOOD, MISSING, SUSPECT, UNKNOWN, flag)
from tidelint.functions.timespec import micros
from tidelint.operators.batches import whole_groups
from tidelint.operators.ordering import Position, Prev, attach, attach_aggregates, measured, ordered
from tidelint.operators.qc_tests import CurrentLimits, c

# Order of the digits in a current flag string.
CURRENT_TESTS = ("cur_range", "cur_signal", "cur_stdev", "cur_tilt", "cur_manual")
LYING_TILT = 45.0
MAX_DEPTHS = 4
ARROWS_PER_DEPTH = 60


def tidy_cells(df: DataFrame, record: list[str], blocks: dict[tuple[str, int], dict[str, Column]]) -> DataFrame:
    """Wide records to one row per cell. ``blocks`` maps (column name, cell
    number) to the cell's parameters; record columns repeat."""
    cells = F.array(*[F.struct(F.lit(col).alias("column"), F.lit(cell).alias("cell"),
                               *[v.alias(n) for n, v in params.items()])
                      for (col, cell), params in blocks.items()])
    return df.select(*record, F.explode(cells).alias("_e")).select(*record, "_e.*")


def cell_counts(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Records and the largest number of cells in one of them."""
    per = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.max("_n").alias("cells"))


def current_flags(df: DataFrame, columns: dict[str, str], limits: CurrentLimits | None = None,
                  off: frozenset[str] = frozenset(), reviewed: bool = False) -> DataFrame:
    """Five digits per cell and their rollup, as one projection.

    ``columns`` maps speed, strength, state, stdev and tilt to columns.
    """
    lim = limits or CurrentLimits()
    speed, strength, state, stdev, tilt = (c(columns[k]) for k in ("speed", "strength", "state", "stdev", "tilt"))

    def when(hit: Column, digit: int) -> Column:
        return F.when(F.coalesce(hit, F.lit(False)), flag(digit)).otherwise(flag(GOOD))

    tests = {
        "cur_range": when((speed < 0) | (speed > lim.max_speed), BAD),
        "cur_signal": when(F.coalesce(state != 0, F.lit(False))
                           | F.coalesce((strength < lim.min_strength) | (strength >= 0), F.lit(False)), BAD),
        "cur_stdev": when(stdev > lim.max_stdev, SUSPECT),
        "cur_tilt": F.when(tilt.isNull(), flag(UNKNOWN)).otherwise(
            F.when(tilt > lim.tilt_bad, flag(BAD)).when(tilt > lim.tilt_suspect, flag(SUSPECT)).otherwise(flag(GOOD))),
        "cur_manual": flag(GOOD if reviewed else UNKNOWN)}
    gone = speed.isNull()
    digits = {n: F.when(gone, flag(MISSING)).otherwise(flag(DISMISSED) if n in off else d) for n, d in tests.items()}
    df = df.withColumns(digits)
    some = [F.col(n) for n in CURRENT_TESTS]
    # unknown and switched-off digits alone leave a cell good
    rollup = (F.when(F.array_contains(F.array(*some), BAD), flag(BAD))
              .when(F.array_contains(F.array(*some), SUSPECT), flag(SUSPECT)).otherwise(flag(GOOD)))
    return df.withColumns({"Flag": F.concat(*[x.cast("string") for x in some]),
                           "Flag_cur": F.when(gone, flag(MISSING)).otherwise(rollup)})


def usable(df: DataFrame, depth: str, current: list[str], flag_column: str = "Flag_cur") -> DataFrame:
    """Cells with a depth and a complete, non-bad current solution."""
    cond = c(depth).isNotNull() & (F.col(flag_column) != BAD)
    for n in current:
        cond = cond & c(n).isNotNull()
    return df.where(cond)


def available_depths(df: DataFrame, keys: list[str], depth: str, current: list[str]) -> DataFrame:
    return usable(df, depth, current).select(*keys, c(depth).alias("depth")).distinct()


def mean_speed_by_depth(df: DataFrame, site: str, depth: str, speed: str, flag_column: str = "Flag_cur") -> DataFrame:
    """Mean speed per site and depth; sites with one depth are left out, and
    nothing is returned unless two sites remain."""
    rows = df.where((F.col(flag_column) != BAD) & c(depth).isNotNull() & c(speed).isNotNull())
    prof = rows.groupBy(site, c(depth).alias("depth")).agg(F.avg(c(speed)).alias("mean_speed"))
    prof = attach_aggregates(prof, [site], {"_depths": F.count(F.lit(1))}).where(F.col("_depths") >= 2)
    sites = prof.select(site).distinct().agg((F.count(F.lit(1)) >= 2).alias("_enough"))
    return prof.join(F.broadcast(sites.where("_enough"))).select(site, "depth", "mean_speed")


def heat_map(df: DataFrame, keys: list[str], depth: str, ts: str, values: dict[str, str],
             flag_column: str = "Flag_cur") -> DataFrame:
    """Mean per depth and instant, long form."""
    rows = df.where((F.col(flag_column) != BAD) & c(depth).isNotNull())
    return rows.groupBy(*keys, c(depth).alias("depth"), ts).agg(*[F.avg(c(v)).alias(n) for n, v in values.items()])


def speed_scale(df: DataFrame, keys: list[str], speed: str, flag_column: str = "Flag_cur") -> DataFrame:
    """Colour scale maximum: 5 % above the fastest cell drawn."""
    return df.where(F.col(flag_column) != BAD).groupBy(*keys).agg((F.max(c(speed)) * 1.05).alias("speed_max"))


def tilt_records(df: DataFrame, record: list[str], tilt: str) -> DataFrame:
    """One tilt per record."""
    return df.groupBy(*record).agg(F.max(c(tilt)).alias("tilt"))


def tilt_report(records: DataFrame, keys, by, limits: CurrentLimits | None = None) -> DataFrame:
    """Suspect, bad and lying-over records, and the spans the last form."""
    lim = limits or CurrentLimits()
    keys = [keys] if isinstance(keys, str) else list(keys)
    over = F.coalesce(F.col("tilt") >= LYING_TILT, F.lit(False))
    s = ordered(records.withColumn("_over", over), keys, by).scan(_was=Prev("_over"))
    rows = s.rows
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if((F.col("tilt") > lim.tilt_suspect) & (F.col("tilt") <= lim.tilt_bad)).alias("suspect"),
        F.count_if(F.col("tilt") > lim.tilt_bad).alias("bad"), F.count_if("_over").alias("lying"),
        F.count_if(F.col("_over") & ~F.coalesce("_was", F.lit(False))).alias("lying_spans"))


def spread_depths(df: DataFrame, site: str, depth: str) -> DataFrame:
    """Up to four depths per site, evenly spread from shallow to deep."""
    d = df.select(site, c(depth).alias("depth")).where(F.col("depth").isNotNull()).distinct()
    s = ordered(d, site, "depth").scan(_i=Position())
    rows = attach_aggregates(s.rows, site, {"_n": F.count(F.lit(1))}, s.cuts)
    last = F.col("_n") - 1
    wanted = [F.rint(last * k / (MAX_DEPTHS - 1)).cast("long") for k in range(MAX_DEPTHS)]
    keep = (F.col("_n") <= MAX_DEPTHS) | F.array_contains(F.array(*wanted), F.col("_i"))
    return rows.where(keep).select(site, "depth")


def decimated(df: DataFrame, site: str, depth: str, by: list[str]) -> DataFrame:
    """Every k-th row per site and depth so that the fullest depth keeps about 60."""
    depth_rows = df.withColumn("depth", c(depth)) if depth != "depth" else df
    s = ordered(depth_rows, [site, "depth"], by).scan(_i=Position())
    counts = s.rows.groupBy(site, "depth").agg(F.count(F.lit(1)).alias("_n"))
    stride = counts.groupBy(site).agg(F.greatest(F.ceil(F.max("_n") / float(ARROWS_PER_DEPTH)), F.lit(1)).alias("_k"))
    return attach(s.rows, stride, site).where(F.col("_i") % F.col("_k") == 0).drop("_i", "_k")


def broken_lines(df: DataFrame, panel_times: DataFrame, site: str, ts: str, depths: DataFrame,
                 values: list[str]) -> DataFrame:
    """Every panel instant at every drawn depth, null where no cell survived.
    Repeated instants keep the row that sorts first."""
    grid = panel_times.select(site, ts).distinct().join(depths, site)      # at most four depths
    first = df.groupBy(site, "depth", ts).agg(F.min(F.struct(*values)).alias("_v"))
    return attach(grid, first, [site, "depth", ts]).select(site, "depth", ts, *[F.col(f"_v.{v}").alias(v) for v in values])


def transit_windows(df: DataFrame, keys, by, depth: str, ts: str = "ts", rate: float = 0.5,
                    reach_s: int = 120, amplitude: float = 0.3) -> DataFrame:
    """When an instrument was going into or out of the water.

    A sample is fast when the net displacement to the last sample within two
    minutes (at least the next one) exceeds the rate. Runs of fast samples, and
    runs at most two minutes apart, form one window, which is kept when its
    depth range is large enough. ``by`` orders samples of equal time.

    Rows are shuffled once: a piece of a series also gets the samples of the two
    minutes after it and the one that follows. It returns its runs, with the
    depth range of each and of the rows between them; those few rows are joined in
    order over the pieces of a series.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    by = [x for x in ([by] if isinstance(by, str) else list(by)) if x != ts]
    span = reach_s * 1_000_000
    work = df.select(*[c(k) for k in keys], *[c(x) for x in by], micros(F.col(ts)).alias("_t"), c(depth).cast("double").alias("_z"))
    order = ("_t", *by)
    group = [*keys, "_part"]
    pieces = measured(work, keys, order).spread(work, "_t", span, "_part")
    kinds = {f.name: f.dataType.simpleString() for f in work.schema.fields}
    names = [f"`{k}` {kinds[k]}" for k in keys]
    runs = (pieces.repartition(*group).sortWithinPartitions(*group, *order).select(*group, "_own", "_t", "_z")
            .mapInArrow(_runs_of(keys, rate, span), ", ".join([*names, *_RUN])))
    return (runs.repartition(*keys).sortWithinPartitions(*keys, "piece", "number")
            .mapInArrow(_joined(keys, span, amplitude), ", ".join([*names, "first_pos bigint, last_pos bigint, depth_range double"])))


_RUN = ("piece bigint", "number int", "kind int", "first bigint", "last bigint", "t0 bigint", "t1 bigint",
        "low double", "high double", "gap_low double", "gap_high double")
_CLOSED, _OPEN, _HEAD, _END = range(4)      # a run that ends in its piece, one that does not, where one open before ends, the piece's end


def _runs_of(keys: list[str], rate: float, span: int) -> Callable:
    def extent(z: np.ndarray, a: int, b: int) -> tuple[float | None, float | None]:
        part = z[a:b]
        part = part[~np.isnan(part)]
        return (float(part.min()), float(part.max())) if len(part) else (None, None)

    def events(t: np.ndarray, known: np.ndarray, z: np.ndarray, own: int) -> Iterator[tuple]:
        """Rows of _RUN after piece and number, in order, of a piece whose first ``own`` rows are its own."""
        row = np.arange(own)
        far = np.searchsorted(t, t[:own] + span, "right") - 1
        far = np.where(far > row, far, row + 1)
        partner = np.minimum(far, len(t) - 1)
        elapsed = np.where((far < len(t)) & known[:own], (t[partner] - t[:own]) / 6e7, 0)
        net = np.nan_to_num(np.abs(z[partner] - z[:own]))
        fast = (elapsed > 0) & (net >= rate * elapsed)
        change = np.flatnonzero(np.diff(np.concatenate([[False], fast, [False]]).astype(np.int8)))
        if own and not fast[0]:
            yield _HEAD, 0, int(partner[0]), None, int(t[partner[0]]), *extent(z, 0, int(partner[0]) + 1), None, None
        behind = 0
        for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
            gap = extent(z, behind, a)
            if b == own:
                yield _OPEN, a, own - 1, int(t[a]), int(t[own - 1]), *extent(z, a, own), *gap
                behind = own
            else:
                last = int(partner[b])
                yield _CLOSED, a, last, int(t[a]), int(t[last]), *extent(z, a, last + 1), *gap
                behind = last + 1
        yield _END, 0, own, None, int(t[own - 1]), None, None, *extent(z, behind, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, [*keys, "_part"]):
            out = []
            known = np.asarray(table.column("_t").is_valid())
            t = table.column("_t").combine_chunks().fill_null(-2**62).to_numpy()
            z = table.column("_z").to_pandas().to_numpy(dtype="float64")
            own = np.asarray(table.column("_own").to_pylist(), bool)
            for a, b in zip(starts, [*starts[1:], table.num_rows], strict=True):
                size = int(own[a:b].sum())
                if size:
                    head = [table.column(k)[a].as_py() for k in keys]
                    piece = table.column("_part")[a].as_py()
                    out += [(*head, piece, i, *e) for i, e in enumerate(events(t[a:b], known[a:b], z[a:b], size))]
            if out:
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(x, table.schema.field(k).type) for k, x in zip(keys, columns, strict=False)]
                types = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, *[pa.float64()] * 4]
                arrays += [pa.array(x, kind) for x, kind in zip(columns[len(keys):], types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *[x.split()[0] for x in _RUN]])
    return run


class _Transits:
    """The windows of one series from the runs of its pieces, in order."""

    def __init__(self, span: int, amplitude: float):
        self.span, self.amplitude = span, amplitude
        self.offset, self.end, self.end_t = 0, -1, 0
        self.open: list | None = None           # first, last, t0, t1, low, high, gap
        self.window: list | None = None         # first, last, t1, low, high
        self.gap: list[float] = []
        self.found: list[tuple[int, int, float]] = []

    def add(self, kind, first, last, t0, t1, low, high, gap_low, gap_high) -> None:
        reach = [x for x in (low, high) if x is not None]
        gap = [x for x in (gap_low, gap_high) if x is not None]
        if kind == _END:
            self.gap += gap
            self.offset, self.end, self.end_t = self.offset + last, self.offset + last - 1, t1
        elif kind == _HEAD:
            if self.open:
                self._close(self.offset + last, t1, reach)
        else:
            if self.open and first == 0:
                self.open[3] += reach
            else:
                self.open = [self.offset + first, t0, self.gap + gap, reach]
                self.gap = []
            if kind == _CLOSED:
                self._close(self.offset + last, t1, [])

    def _close(self, last: int, t1: int, reach: list[float]) -> None:
        first, t0, gap, own = self.open
        self.open, own = None, own + reach
        if self.window and t0 - self.window[2] <= self.span:
            self.window[1:] = [last, t1, self.window[3] + gap + own]
        else:
            self._flush()
            self.window = [first, last, t1, own]
        self.window[3] = [min(self.window[3]), max(self.window[3])] if self.window[3] else []

    def _flush(self) -> None:
        if self.window and self.window[3] and self.window[3][1] - self.window[3][0] >= self.amplitude:
            self.found.append((self.window[0], self.window[1], self.window[3][1] - self.window[3][0]))
        self.window = None

    def finish(self) -> list[tuple[int, int, float]]:
        if self.open:
            self._close(self.end, self.end_t, [])
        self._flush()
        return self.found


def _joined(keys: list[str], span: int, amplitude: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, state, kinds = None, None, None

        def made() -> pa.RecordBatch:
            rows = [(*head, *w) for w in state.finish()]
            columns = list(zip(*rows, strict=True)) or [[]] * (len(keys) + 3)
            types = [*kinds, pa.int64(), pa.int64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, types, strict=True)], names=[*keys, "first_pos", "last_pos", "depth_range"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if row[:len(keys)] != head:
                    if state:
                        yield made()
                    head, state = row[:len(keys)], _Transits(span, amplitude)
                state.add(*row[len(keys) + 2:])
        if state:
            yield made()
    return run

