"""Joins in time: interpolation between samples and nearest sample.

Targets and sources of a key are laid out in one ordered union; what a target
needs of the source sample on either side is carried along that order. One
shuffle, no range join, and a key may be any share of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.timespec import micros
from tidelint.operators.ordering import FirstAfter, Last, Next, Position, Prev, RunningSum, attach, ordered
from tidelint.operators.qc_tests import c
from tidelint.operators.stats import attach_medians

_SIDE = "struct<t bigint, v array<double>, before bigint, after bigint>"


def _sides(targets: DataFrame, sources: DataFrame, keys: list[str], ts: str,
           values: list[str], tie: str) -> DataFrame:
    """Targets with ``_l`` and ``_r``: the source sample at or before, and
    after, each target, and the source's coverage and median step."""
    src = sources.where(F.col(ts).isNotNull()).select(
        *keys, micros(F.col(ts)).alias("_t"),
        F.array(*[c(v).cast("double") for v in values]).alias("_v"))
    s = ordered(src, keys, "_t").scan(_b=Prev("_t"), _a=Next("_t"))
    rows = s.with_columns(_before=F.col("_t") - F.col("_b"), _after=F.col("_a") - F.col("_t")).rows
    rows = attach_medians(rows, keys, {"_med": F.col("_before").cast("double")}, s.cuts,
                          {"_t0": F.min("_t"), "_t1": F.max("_t"), "_ns": F.count(F.lit(1))})
    side = F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"), F.col("_before").alias("before"),
                    F.col("_after").alias("after"))
    stat = F.struct("_med", "_t0", "_t1", "_ns")
    src = rows.select(*keys, F.col("_t"), F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("_tie"),
                      side.alias("_src"), stat.alias("_st"))
    rest = F.struct(*[c(x) for x in targets.columns])
    tgt = targets.select(*keys, micros(F.col(ts)).alias("_t"), F.lit(1).alias("_kind"),
                         c(tie).cast("string").alias("_tie"), rest.alias("_row"))
    both = tgt.unionByName(src, allowMissingColumns=True)
    u = ordered(both, keys, ("_t", "_kind", "_tie")).scan(
        _l=Last("_src"), _r=FirstAfter("_src"), _s1=Last("_st"), _s2=FirstAfter("_st"))
    return u.rows.where(F.col("_kind") == 1).select(
        "_row.*", "_t", "_l", "_r", F.coalesce("_s1", "_s2").alias("_st"))


def _line(i: int, left: str = "_l", right: str = "_r") -> Column:
    """Linear value of the i-th channel at the target."""
    lt, rt, lv, rv = F.col(f"{left}.t"), F.col(f"{right}.t"), F.col(f"{left}.v")[i], F.col(f"{right}.v")[i]
    slope = (rv - lv) / (rt - lt)
    return F.when(lt == F.col("_t"), lv).otherwise(slope * (F.col("_t") - lt) + lv)


def interpolate(targets: DataFrame, sources: DataFrame, keys, values: dict[str, str],
                gap_rule: str, factor: float = 2.0, ts: str = "ts", tie: str = "sample_no") -> DataFrame:
    """Linear interpolation of source channels at the targets' times.

    ``values`` maps source columns to output columns. Nothing is extrapolated.
    ``gap_rule`` decides which gaps are bridged, in units of ``factor`` times
    the source's median step: ``"bracket"`` looks at the gap between the two
    samples around the target, ``"nearest"`` at the distance to the nearer one.
    Source stamps must be unique per key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    names = list(values)
    work = _sides(targets, sources, keys, ts, names, tie)
    t, lt, rt = F.col("_t"), F.col("_l.t"), F.col("_r.t")
    inside = (t >= F.col("_st._t0")) & (t <= F.col("_st._t1"))
    limit = factor * F.coalesce(F.col("_st._med"), F.lit(0.0))
    if gap_rule == "bracket":
        # a target on a sample belongs to the gap that ends there
        gap = F.when(lt == t, F.coalesce(F.col("_l.before"), F.col("_l.after"), F.lit(0))).otherwise(rt - lt)
        enough = F.lit(True)
    elif gap_rule == "nearest":
        gap = F.least(t - lt, rt - t)
        enough = F.col("_st._ns") >= 2
    else:
        raise ValueError("gap_rule is 'bracket' or 'nearest'")
    valid = F.coalesce(inside & (gap <= limit) & enough, F.lit(False))
    return work.select(*[c(x) for x in targets.columns],
                       *[F.when(valid, _line(i)).alias(values[n]) for i, n in enumerate(names)])


def nearest(targets: DataFrame, sources: DataFrame, keys, values: dict[str, str],
            tolerance_s: Column | float | None, ts: str = "ts", tie: str = "sample_no") -> DataFrame:
    """Channels of the nearest source sample; ties go to the later one.

    ``tolerance_s`` (seconds, inclusive) may be an expression over the targets;
    null accepts any distance. Source stamps must be unique per key.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    tol = tolerance_s if isinstance(tolerance_s, Column) else F.lit(tolerance_s).cast("double")
    held = targets.withColumn("_tol", tol)
    names = list(values)
    work = _sides(held, sources, keys, ts, names, tie)
    back, ahead = F.col("_t") - F.col("_l.t"), F.col("_r.t") - F.col("_t")
    later = back.isNull() | (ahead <= back)
    take_right = (back.isNull() | F.coalesce(later, F.lit(False))) & (F.coalesce(back, F.lit(1)) != 0)
    side = F.when(take_right, F.col("_r")).otherwise(F.col("_l"))
    far = F.when(take_right, ahead).otherwise(back)
    ok = F.coalesce(F.col("_tol").isNull() | (far <= F.col("_tol") * 1e6), F.lit(False))
    work = work.withColumns({"_side": side, "_hit": ok})
    return work.select(*[c(x) for x in targets.columns], *[
        F.when(F.col("_hit"), F.col("_side.v")[i]).alias(values[n]) for i, n in enumerate(names)])


def merge_sensor_groups(groups: DataFrame, keys, group: str, members: list[int], values: list[str],
                        ts: str = "ts", tie: str = "sample_no") -> DataFrame:
    """All sensor groups of a cast on the time axis of its largest group.

    ``groups`` is long: one row per key, group number and instant; ``members``
    lists the group numbers. Channels of group k are added as ``<value>.k``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    sizes = groups.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_size"))
    best = sizes.groupBy(*keys).agg(F.max_by(group, F.struct(F.col("_size"), -F.col(group))).alias("_master"))
    own = [*keys, group]
    s = ordered(attach(groups, best, keys).withColumn("_t", micros(F.col(ts))), own, ("_t", tie)).scan(_b=Prev("_t"))
    rows = attach_medians(s.rows, own, {"_med": (F.col("_t") - F.col("_b")).cast("double")}, s.cuts,
                          {"_t0": F.min("_t"), "_t1": F.max("_t"), "_ns": F.count("_t")})
    # every row of another group is carried to the rows of the largest one on either side, all groups in one scan
    source = F.struct(F.col("_t").alias("t"), F.array(*[c(v).cast("double") for v in values]).alias("v"), "_med", "_t0", "_t1", "_ns")
    other = F.col(group) != F.col("_master")
    rows = rows.withColumns({"_kind": (~other).cast("int"), "_src": F.when(other & F.col("_t").isNotNull(), source)})
    u = ordered(rows, keys, ("_t", "_kind", group, tie)).scan(
        **{f"_l{g}": Last(F.when(F.col(group) == g, F.col("_src"))) for g in members},
        **{f"_r{g}": FirstAfter(F.when(F.col(group) == g, F.col("_src"))) for g in members})
    out = []
    for g in members:
        left, right, t = f"_l{g}", f"_r{g}", F.col("_t")

        def of(name: str, left: str = left, right: str = right) -> Column:
            return F.coalesce(F.col(f"{left}.{name}"), F.col(f"{right}.{name}"))

        near = F.least(t - F.col(f"{left}.t"), F.col(f"{right}.t") - t) <= 2.0 * F.coalesce(of("_med"), F.lit(0.0))
        valid = F.coalesce((t >= of("_t0")) & (t <= of("_t1")) & near & (of("_ns") >= 2), F.lit(False))
        out += [F.when(valid, _line(i, left, right)).alias(f"{v}.{g}") for i, v in enumerate(values)]
    return u.rows.where(F.col("_kind") == 1).select(*[c(x) for x in groups.columns], *out)


_BASE, _LEVELS = 8, 9          # 8^8 points in a block of the last level, any number of which make up an interval


def _blocks(lo: Column, hi: Column) -> Column:
    """The few aligned blocks that make up the numbers [lo, hi], smallest first.

    Blocks of a level are 8 times those of the level below; a block is taken
    when it lies inside and its parent does not.
    """
    def part(level: int, a: Column, b: Column) -> Column:
        run = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(run, lambda x: F.struct(F.lit(level).alias("level"), x.alias("block")))

    out = []
    for level in range(_LEVELS):
        size, parent = _BASE ** level, _BASE ** (level + 1)
        a, b = F.ceil(lo / F.lit(size)), F.floor((hi + 1) / F.lit(size)) - 1
        if level == _LEVELS - 1:
            out.append(part(level, a, b))
            continue
        pa, pb = F.ceil(lo / F.lit(parent)), F.floor((hi + 1) / F.lit(parent)) - 1
        whole = pa <= pb
        out.append(part(level, a, F.when(whole, F.least(b, pa * _BASE - 1)).otherwise(b)))
        out.append(part(level, F.when(whole, F.greatest(a, (pb + 1) * _BASE)).otherwise(b + 1), b))
    return F.concat(*out)


def covering_interval(points: DataFrame, intervals: DataFrame, keys, at: str, start: str, end: str,
                      label: str, slack_s: int = 3600) -> DataFrame:
    """Label of the shortest interval, widened by the slack, that holds each
    point; null when none does.

    The different times of a key's points are numbered, and an ordered scan finds the
    first and the last of them that an interval holds. Of the intervals that hold
    the same points the shortest is kept and cut into aligned blocks of their
    numbers, each of which keeps its shortest interval; a point looks up the one block per
    level it lies in. The work grows with points plus intervals, never with their pairs.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    lo, hi = micros(F.col(start)) - slack_s * 1000000, micros(F.col(end)) + slack_s * 1000000
    length = micros(F.col(end)) - micros(F.col(start))
    pts = points.withColumn("_t", micros(F.col(at)))
    known = F.lit(True)
    for k in keys:
        known = known & c(k).isNotNull()
    asked = pts.where(known & F.col("_t").isNotNull()).select(*keys, "_t").distinct()
    spans = (intervals.where(known).select(*keys, lo.alias("_lo"), hi.alias("_hi"), F.struct(length.alias("len"), c(label).alias("lab")).alias("_i"))
             .where(F.col("_lo") <= F.col("_hi")))
    # at one time an interval begins before the point and ends after it
    ends = F.explode(F.array(F.struct(F.col("_lo").alias("_t"), F.lit(0).alias("_side")), F.struct(F.col("_hi").alias("_t"), F.lit(2).alias("_side")))).alias("_e")
    laid = (spans.select(*keys, "_lo", "_i", ends).select(*keys, "_lo", "_i", "_e._t", "_e._side")
            .unionByName(asked.withColumn("_side", F.lit(1)), allowMissingColumns=True))
    s = ordered(laid, keys, ("_t", "_side")).scan(_upto=RunningSum((F.col("_side") == 1).cast("bigint")))
    held = (s.rows.where(F.col("_side") != 1).groupBy(*keys, "_lo", "_i")
            .agg(F.max(F.when(F.col("_side") == 0, F.col("_upto"))).alias("_first"), (F.max(F.when(F.col("_side") == 2, F.col("_upto"))) - 1).alias("_last"))
            .where(F.col("_first") <= F.col("_last")).groupBy(*keys, "_first", "_last").agg(F.min("_i").alias("_i")))
    best = (held.select(*keys, "_i", F.explode(_blocks(F.col("_first"), F.col("_last"))).alias("_k"))
            .groupBy(*keys, "_k").agg(F.min("_i").alias("_i")))
    own = F.array(*[F.struct(F.lit(n).alias("level"), F.floor(F.col("_nth") / F.lit(_BASE ** n)).alias("block")) for n in range(_LEVELS)])
    numbered = ordered(asked, keys, "_t", s.cuts).scan(_nth=Position()).rows
    found = numbered.select(*keys, "_t", F.explode(own).alias("_k")).join(best, [*keys, "_k"]).groupBy(*keys, "_t").agg(F.min("_i").alias("_i"))
    return attach(pts, found, [*keys, "_t"]).select(*[c(x) for x in points.columns], F.col("_i.lab").alias(label))
