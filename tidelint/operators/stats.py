"""Exact per-group order statistics that also hold for very large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelint.operators.ordering import Cuts, attach, kept

_ACCURACY = 50_000         # percentile_approx: rank error at most n / accuracy
_MARGIN = 0.0002           # bracket half-width, ten times that error


def group_medians(df: DataFrame, keys, columns: dict[str, Column], cuts: Cuts | None = None) -> DataFrame:
    """Exact median per group of each expression (nulls ignored)."""
    return group_quantiles(df, keys, {n: (c, 0.5) for n, c in columns.items()}, cuts)


def attach_medians(df: DataFrame, keys, columns: dict[str, Column], cuts: Cuts | None = None,
                   more: dict[str, Column] | None = None) -> DataFrame:
    """Give every row the exact medians of its group, and other aggregates of it."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if cuts is not None and cuts.bounds(keys):
        w = Window.partitionBy(*keys)
        return df.select("*", *[F.percentile(c, F.lit(0.5)).over(w).alias(n) for n, c in columns.items()], *[c.over(w).alias(n) for n, c in (more or {}).items()])
    if cuts is not None:
        df = kept(df)
    return attach(df, group_quantiles(df, keys, {n: (c, 0.5) for n, c in columns.items()}, more=more), keys)


def group_quantiles(df: DataFrame, keys, wanted: dict[str, tuple[Column, float]], cuts: Cuts | None = None,
                    more: dict[str, Column] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles per group, and ``more`` aggregates of it.

    Where ``cuts`` show that groups are short: the built-in aggregate, which keeps
    every distinct value of a group. Otherwise one aggregate sketches all
    expressions at once, and the sketches bracket every quantile. One long
    table then holds what lies in the brackets (0.04 % of a large group) and the
    number of values below them; its running counts are the ranks.
    """
    keys = list((keys,) if isinstance(keys, str) else keys)
    aggregates = [c.alias(n) for n, c in (more or {}).items()]
    if cuts is not None and cuts.bounds(keys):
        return df.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()], *aggregates)
    work = df.select("*", *[c.cast("double").alias(f"_v{i}") for i, (c, _q) in enumerate(wanted.values())])
    shares = [q for _c, q in wanted.values()]
    sketch = work.groupBy(*keys).agg(*[F.struct(F.count(f"_v{i}").alias("n"), F.percentile_approx(f"_v{i}", [max(q - _MARGIN, 0.0), min(q + _MARGIN, 1.0)], _ACCURACY).alias("b")).alias(f"_s{i}")
                                       for i, q in enumerate(shares)], *aggregates)
    held = work.alias("a").join(sketch.alias("b"), _same(keys))
    found = held.select(*[F.col(f"a.`{k}`") for k in keys], F.explode(F.filter(F.array(*[_bracketed(i) for i in range(len(shares))]), lambda x: x.isNotNull())).alias("_x"))
    counts = found.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_count")).select(*keys, "_x.*", "_count")
    up = Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first())
    upto = F.sum("_count").over(up.rowsBetween(Window.unboundedPreceding, 0))
    at = F.element_at(F.array(*[F.lit(float(q)) for q in shares]), F.col("i") + 1) * (F.col("n") - 1)
    ranked = counts.withColumns({"_to": upto, "_at": at}).withColumn("_from", F.col("_to") - F.col("_count")).where("v IS NOT NULL")

    def pick(i: int, rank: Column) -> Column:
        return F.max(F.when((F.col("i") == i) & (rank >= F.col("_from")) & (rank < F.col("_to")), F.col("v")))

    # rows at the two ranks around a quantile, brought together per group
    sides = ranked.groupBy(*keys).agg(*[e for i in range(len(shares)) for e in (
        pick(i, F.floor("_at")).alias(f"_a{i}"), pick(i, F.ceil("_at")).alias(f"_z{i}"))])
    both = sketch.alias("a").join(sides.alias("b"), _same(keys), "left")
    out = []
    for i, (name, (_c, q)) in enumerate(wanted.items()):
        exact = F.lit(float(q)) * (F.col(f"a._s{i}.n") - 1)
        out.append((F.col(f"b._a{i}") + (F.col(f"b._z{i}") - F.col(f"b._a{i}")) * (exact - F.floor(exact))).alias(name))
    return both.select(*[F.col(f"a.`{k}`") for k in keys], *out, *[F.col(f"a.`{n}`") for n in (more or {})])


def _same(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return out


def _bracketed(i: int) -> Column:
    """(i, n, v) of a value inside the bracket, without v below it, null above it and for nulls."""
    v, n = F.col(f"a._v{i}"), F.col(f"b._s{i}.n")
    # a small group is ranked whole: the margin must span at least two elements
    small = n <= int(2 / _MARGIN)
    below = ~small & (v < F.col(f"b._s{i}.b")[0])
    inside = small | (v <= F.col(f"b._s{i}.b")[1])
    entry = F.struct(F.lit(i).alias("i"), n.alias("n"), F.when(~below, v).alias("v"))
    return F.when(v.isNotNull() & (below | inside), entry)
