"""Ordered evaluation over many series, exact when one series is most of the data.

A window partitioned by series puts a whole series into one task, which cannot
be when a series holds a third of the table. ``ordered`` therefore counts the
rows of every series first, in one aggregate. A series of at most
``spark.tidelint.pieceRows`` rows is one piece; a longer one is cut at borders
that a sample of its order gives. The borders are literals: at most 65,536 of
them in all, so that pieces grow with a table that needs more, and they never
change when a task is run again. Nothing else runs while a query is built.

A scan runs inside (series, piece). What a piece needs of those before or
after it is an associative summary, one row a piece, which is scanned in turn
and joined back to the rows of long series. As there are no more pieces than
borders, that table is broadcast. Rows are shuffled once, whatever the number
of scans. Only where series are long, rows that are read twice after an earlier
scan are written to the shared folder first.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIECE_ROWS_CONF = "spark.tidelint.pieceRows"
PIECE_ROWS = 500_000
PIECE = "_piece"
_MOST_PIECES = 65_536
_DRAWN = 16                 # sampled rows a border
_FAN = 256                  # borders are looked up in two steps of at most this many


@dataclass(frozen=True)
class Cuts:
    """Where the long series of a frame are cut: their keys and borders, None when there are no long series."""
    keys: tuple[str, ...]
    by: tuple[str, ...]
    table: DataFrame | None
    rows: int = PIECE_ROWS
    position: bool = False
    groups: int | None = None   # series that were counted

    @property
    def none(self) -> bool:
        return self.table is None

    def few(self, keys) -> bool:
        """True when groups of ``keys`` were counted to be no more than a broadcast table may have rows."""
        return self.groups is not None and self.groups <= _MOST_PIECES and set(keys) <= set(self.keys)

    def crossed(self, name: str, values) -> Cuts:
        """The cuts of a frame whose columns ``values`` are unpivoted, so that every series becomes one for each of them."""
        values = list(values)
        table = self.table if self.none else self.table.withColumn(f"_k_{name}", F.explode(F.array(*[F.lit(v) for v in values])))
        groups = None if self.groups is None else self.groups * len(values)
        return replace(self, keys=(*self.keys, name), table=table, groups=groups)

    def bounds(self, keys) -> bool:
        """True when every group of ``keys`` is known to fit one piece."""
        return self.none and set(self.keys) <= set(keys)

    def at(self, position: str) -> Cuts:
        """The same series cut at every ``rows``-th row number, for rows in the order of their number."""
        return replace(self, by=(position,), position=True)

    def spread(self, df: DataFrame, t: str, span: int, out: str) -> DataFrame:
        """Rows with a piece (``out``) and whether it is their own (``_own``).

        A row of a long series is sent to its own piece, to those whose last row is at most
        ``span`` before it in ``t``, the first column of the order, and to the
        one before if it is the first of its own.
        """
        if self.none:
            return df.withColumns({out: F.lit(0).cast("bigint"), "_own": F.lit(True)})
        both = df.alias("a").join(F.broadcast(self.table).alias("b"), _same("a", "b", self.keys), "left").select("a.*", F.flatten("b._borders").alias("_borders"))
        at = F.struct(*[_c(n) for n in self.by])
        piece = F.coalesce(F.size(F.filter("_borders", lambda b: b <= at)), F.lit(0))
        near = F.coalesce(F.size(F.filter("_borders", lambda b: b[t] < _c(t) - span)), F.lit(0))
        begins = F.coalesce(F.exists("_borders", lambda b: b.eqNullSafe(at)), F.lit(False)).cast("int")
        rows = both.withColumns({"_p": F.when(F.col("_borders").isNull(), 0).otherwise(piece), "_near": near, "_begins": begins})
        first = F.when(F.col("_borders").isNull(), 0).otherwise(F.least("_near", F.col("_p") - F.col("_begins")))
        return (rows.withColumn(out, F.explode(F.sequence(first.cast("bigint"), F.col("_p").cast("bigint"))))
                .withColumn("_own", F.col(out) == F.col("_p")).drop("_borders", "_p", "_near", "_begins"))

    def numbered(self, df: DataFrame) -> DataFrame:
        """Rows with the number of their piece; null in a series of one piece."""
        if self.none:
            return df
        at = F.struct(*[_c(n) for n in self.by])
        group = F.size(F.filter("_borders", lambda g: g[0] <= at))
        inside = F.size(F.filter(F.element_at("_borders", group), lambda b: b <= at))
        number = F.floor(_c(self.by[0]) / self.rows) if self.position else F.when(group == 0, F.lit(0)).otherwise((group - 1) * _FAN + inside)
        piece = F.when(F.col("_borders").isNotNull(), number)
        both = df.alias("a").join(F.broadcast(self.table).alias("b"), _same("a", "b", self.keys), "left")
        return both.select("a.*", piece.cast("long").alias(PIECE))


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def _same(a: str, b: str, keys) -> Column:
    """Join condition on keys, where null equals null. Keys of ``b`` carry the prefix ``_k_``."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`_k_{k}`"))
    return out


def piece_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(PIECE_ROWS_CONF, str(PIECE_ROWS)))


def measured(df: DataFrame, keys, by) -> Cuts:
    """Count the series of ``df`` and draw borders for the long ones.

    One aggregate that returns one row; where series are long, two more that
    return their keys and borders. Without ``by`` groups are only counted.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    by = (by,) if isinstance(by, str) else tuple(by)
    rows = piece_rows(df)
    sizes = df.groupBy(*[_c(k).alias(f"_k_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    total, longest, groups = sizes.agg(F.sum("_n"), F.max("_n"), F.count(F.lit(1))).first()
    if (longest or 0) <= rows:
        return Cuts(keys, by, None, groups=groups)
    rows = max(rows, -(-total // _MOST_PIECES))
    long = sizes.where(F.col("_n") > rows).select(*[F.col(f"`_k_{k}`") for k in keys], F.ceil(F.col("_n") / rows).alias("_pieces"), "_n")
    if longest <= rows:
        return Cuts(keys, by, None, groups=groups)
    long = df.sparkSession.createDataFrame(long.collect(), long.schema)
    if not by:
        return Cuts(keys, by, long, rows, groups=groups)
    drawn = df.alias("a").join(F.broadcast(long).alias("b"), _same("a", "b", keys))
    # rows of equal keys and order are drawn together, so a border never depends on how a task was run
    dice = F.pmod(F.xxhash64(*[F.col(f"a.`{n}`") for n in (*keys, *by)]), F.lit(1 << 40))
    drawn = drawn.where(dice < F.lit(float(1 << 40)) * _DRAWN * F.col("b._pieces") / F.col("b._n")).select(
        *[F.col(f"b.`_k_{k}`") for k in keys], F.struct(*[F.col(f"a.`{n}`") for n in by]).alias("_at"))
    order = Window.partitionBy(*[f"_k_{k}" for k in keys]).orderBy("_at")
    border = drawn.withColumn("_i", F.row_number().over(order)).where(F.col("_i") % _DRAWN == 0)
    found = border.groupBy(*[f"_k_{k}" for k in keys]).agg(F.array_sort(F.collect_set("_at")).alias("_borders"))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("_borders") / _FAN).cast("int") - 1), lambda i: F.slice("_borders", i * _FAN + 1, F.lit(_FAN)))
    found = found.withColumn("_borders", chunks)
    return Cuts(keys, by, df.sparkSession.createDataFrame(found.collect(), found.schema), rows, groups=groups)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; only a local session may do without."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="tidelint-"))
    return context.getCheckpointDir()


def kept(df: DataFrame, laid: bool = False) -> DataFrame:
    """``df`` written once to the shared folder, for plans that read it twice.

    ``laid``: a later scan finds the rows dealt and sorted as they are here. Only
    a plan that is fixed before it runs tells how its rows lie.
    """
    shared_folder(df.sparkSession)
    conf, name = df.sparkSession.conf, "spark.sql.adaptive.enabled"
    adaptive = conf.get(name)
    if not laid or adaptive == "false":
        return df.checkpoint()
    conf.set(name, "false")
    try:
        return df.select("*").checkpoint()
    finally:
        conf.set(name, adaptive)


@dataclass(frozen=True)
class Prev:
    """Value on the previous row."""
    value: Column | str


@dataclass(frozen=True)
class Next:
    """Value on the next row."""
    value: Column | str


@dataclass(frozen=True)
class Last:
    """Latest non-null value so far."""
    value: Column | str
    inclusive: bool = True


@dataclass(frozen=True)
class FirstAfter:
    """Nearest non-null value from here on."""
    value: Column | str
    inclusive: bool = True


@dataclass(frozen=True)
class RunningSum:
    value: Column | str


@dataclass(frozen=True)
class RunningMax:
    value: Column | str


@dataclass(frozen=True)
class Position:
    """0-based row number inside the series."""


Scan = Prev | Next | Last | FirstAfter | RunningSum | RunningMax | Position


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


class Ordered:
    """Rows of many series with a total order inside each series."""

    def __init__(self, df: DataFrame, cuts: Cuts, scanned: bool = False):
        self.df, self.cuts, self.scanned = df, cuts, scanned

    @property
    def rows(self) -> DataFrame:
        return self.df.drop(PIECE)

    def _window(self, descending: bool = False):
        part = [_c(k) for k in self.cuts.keys] + ([] if self.cuts.none else [F.col(PIECE)])
        order = [_c(n).desc() if descending else _c(n).asc() for n in self.cuts.by]
        return Window.partitionBy(*part).orderBy(*order)

    def with_columns(self, **columns: Column) -> Ordered:
        return Ordered(self.df.withColumns(columns), self.cuts, self.scanned)

    def scan(self, _stored: bool = False, **scans: Scan) -> Ordered:
        """Add one column per scan; all scans of a call share the sorts.

        With ``_stored``, rows of long series are written with what their own piece
        tells, so that what pieces take from each other is read from there.
        """
        up, down = self._window(), self._window(True)
        if self.cuts.none:
            return Ordered(self.df.select("*", *[self._local(s, up, down).alias(n) for n, s in scans.items()]), self.cuts, True)
        if self.scanned:
            self = Ordered(kept(self.df), self.cuts, True)
        local = self.df.select("*", *[self._local(s, up, down, True).alias(n) for n, s in scans.items()])
        if _stored:
            local = kept(local)
            self = Ordered(local.select(*[_c(n) for n in self.df.columns]), self.cuts, True)
        both = local.alias("a").join(F.broadcast(self._carry(scans)).alias("b"),
                                     _same("a", "b", self.cuts.keys) & (F.col(f"a.{PIECE}") == F.col(f"b._k_{PIECE}")), "left")
        done = both.select(*[F.col(f"a.`{c}`") for c in self.df.columns], *[self._merge(s, n).alias(n) for n, s in scans.items()])
        return Ordered(done, self.cuts, True)

    def _local(self, s: Scan, up, down, wrapped: bool = False) -> Column:
        if isinstance(s, (Prev, Next)):
            # wrapped in a struct, a null neighbour is not mistaken for the end of a piece
            v = F.struct(_col(s.value).alias("v")) if wrapped else _col(s.value)
            return (F.lag if isinstance(s, Prev) else F.lead)(v).over(up)
        if isinstance(s, Position):
            return (F.row_number().over(up) - 1).cast("long")
        if isinstance(s, RunningSum):
            return F.sum(_col(s.value)).over(up.rowsBetween(Window.unboundedPreceding, 0))
        if isinstance(s, RunningMax):
            return F.max(_col(s.value)).over(up.rowsBetween(Window.unboundedPreceding, 0))
        reach = 0 if s.inclusive else -1
        # a frame open at the far end is re-evaluated per row, so looking ahead
        # is a descending sort with a growing frame instead
        order = up if isinstance(s, Last) else down
        return F.last(_col(s.value), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, reach))

    def _carry(self, scans: dict[str, Scan]) -> DataFrame:
        """One row per piece of a long series: what it takes from the pieces before or after it."""
        at = F.struct(*[_c(n) for n in self.cuts.by])
        sums = []
        for name, s in scans.items():
            if isinstance(s, Position):
                e = F.count(F.lit(1))
            elif isinstance(s, RunningSum):
                e = F.sum(_col(s.value))
            elif isinstance(s, RunningMax):
                e = F.max(_col(s.value))
            elif isinstance(s, Prev) and isinstance(s.value, str) and s.value == self.cuts.by[0]:
                # the order's own column needs no struct to be ordered by, and so no sort to be aggregated
                e = F.struct(F.max(_c(s.value)).alias("v"))
            elif isinstance(s, Next) and isinstance(s.value, str) and s.value == self.cuts.by[0]:
                v = _c(s.value)
                e = F.struct(F.when(F.count(v) == F.count(F.lit(1)), F.min(v)).alias("v"))
            elif isinstance(s, (Prev, Next)):
                e = (F.max_by if isinstance(s, Prev) else F.min_by)(F.struct(_col(s.value).alias("v")), at)
            else:
                v = _col(s.value)
                e = (F.max_by if isinstance(s, Last) else F.min_by)(v, F.when(v.isNotNull(), at))
            sums.append(e.alias(f"_s_{name}"))
        names = [f"_k_{k}" for k in self.cuts.keys]
        pieces = (self.df.where(F.col(PIECE).isNotNull())
                  .groupBy(*[_c(k).alias(n) for k, n in zip(self.cuts.keys, names, strict=True)], F.col(PIECE).alias(f"_k_{PIECE}")).agg(*sums))
        up = Window.partitionBy(*[_c(n) for n in names]).orderBy(f"_k_{PIECE}")
        down = Window.partitionBy(*[_c(n) for n in names]).orderBy(F.col(f"_k_{PIECE}").desc())
        before = (Window.unboundedPreceding, -1)
        out = [_c(n) for n in names] + [F.col(f"_k_{PIECE}")]
        for name, s in scans.items():
            v = F.col(f"`_s_{name}`")
            if isinstance(s, (Position, RunningSum)):
                e = F.sum(v).over(up.rowsBetween(*before))
            elif isinstance(s, RunningMax):
                e = F.max(v).over(up.rowsBetween(*before))
            elif isinstance(s, Prev):
                e = F.lag(v).over(up)
            elif isinstance(s, Next):
                e = F.lead(v).over(up)
            else:
                e = F.last(v, ignorenulls=True).over((up if isinstance(s, Last) else down).rowsBetween(*before))
            out.append(e.alias(f"_c_{name}"))
        return pieces.select(*out)

    def _merge(self, s: Scan, name: str) -> Column:
        here, carried = F.col(f"a.`{name}`"), F.col(f"b.`_c_{name}`")
        if isinstance(s, (Prev, Next)):
            return F.coalesce(here, carried)["v"]
        if isinstance(s, Position):
            return here + F.coalesce(carried, F.lit(0))
        if isinstance(s, RunningSum):
            return F.when(here.isNull() & carried.isNull(), F.lit(None)).otherwise(
                F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0)))
        if isinstance(s, RunningMax):
            return F.greatest(here, carried)
        return F.coalesce(here, carried)


def ordered(df: DataFrame, keys, by, cuts: Cuts | None = None) -> Ordered:
    """Lay ``df`` out for scans. ``by`` must be a total order inside ``keys``.

    ``cuts`` are those of an earlier call on the same rows, or of rows that these
    are some of; with other keys or another order they only serve when they show that no series is long.
    Rows that have their piece already keep it: they stay where an earlier scan has dealt and sorted them.
    """
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    by = (by,) if isinstance(by, str) else tuple(by)
    if cuts is not None and cuts.none and cuts.bounds(keys):
        cuts = Cuts(keys, by, None)
    elif cuts is None or (cuts.keys, cuts.by) != (keys, by):
        cuts = measured(df.drop(PIECE), keys, by)
        df = df.drop(PIECE)
    return Ordered(df if PIECE in df.columns else cuts.numbered(df), cuts)


def attach(df: DataFrame, stats: DataFrame, keys, cuts: Cuts | None = None) -> DataFrame:
    """Left-join per-key statistics. Broadcast where ``cuts`` show that there are few groups;
    otherwise AQE decides from the measured size and splits a skewed key."""
    keys = list((keys,) if isinstance(keys, str) else keys)
    return df.join(F.broadcast(stats) if cuts is not None and cuts.few(keys) else stats, keys, "left")


def attach_aggregates(df: DataFrame, keys, aggregates: dict[str, Column], cuts: Cuts | None = None, light: bool = False) -> DataFrame:
    """Give every row the aggregates of its group.

    Where ``cuts`` show that groups are short: one window over the group, which
    shares the exchange of the scans. Otherwise partial aggregation and a join
    back, so no task ever holds a whole group. Rows are written first unless they are
    ``light``, stored or cheap to read again, and their groups are few: then
    the join moves no rows, and the result is as light.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if cuts is not None and cuts.bounds(keys):
        w = Window.partitionBy(*keys)
        return df.select("*", *[a.over(w).alias(n) for n, a in aggregates.items()])
    light = light and cuts is not None and cuts.few(keys)
    if cuts is not None and not light:
        df = kept(df)
    return attach(df, df.groupBy(*keys).agg(*[a.alias(n) for n, a in aggregates.items()]), keys, cuts if light else None)
