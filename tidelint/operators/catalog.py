"""The product catalogue: what was made from which inputs, and what is stale."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.functions.timespec import micros
from tidelint.operators.ordering import PIECE, Position, Prev, RunningSum, attach_aggregates, kept, measured, ordered

_DAY = "INTERVAL 1 DAY"


def path_facts(path: Column) -> dict[str, Column]:
    """Instrument, semester, bucket, site and product from
    ``<instrument>/qualified/<semester>/[_bucket/]<site>/.../<product>_QLF.csv``."""
    part = F.split(path, "/")
    name = F.regexp_replace(F.element_at(part, -1), r"\.csv$", "")
    third = F.element_at(part, 4)
    bucketed = F.startswith(third, F.lit("_")) & (F.size(part) > 5)
    return {"product": name,
            "instrument": F.when(F.contains(name, F.lit("_DOPPLER_")), "DOPPLER")
            .when(F.contains(name, F.lit("_HOBO")), "HOBO").otherwise("SEAGUARD"),
            "semester": F.element_at(part, 3),
            "bucket": F.when(bucketed, third).otherwise(F.lit("")),
            "site": F.when(bucketed, F.element_at(part, 5)).otherwise(third)}


def product_index(rows: DataFrame, path: str, ts: str, co2: str | None = None) -> DataFrame:
    """One row per product file: facts of its path, rows, period, CO2 points."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.min(ts).alias("t_start"), F.max(ts).alias("t_end"),
            (F.count(co2) if co2 else F.lit(0).cast("long")).alias("co2_points")]
    g = rows.groupBy(F.col(path).alias("path")).agg(*aggs)
    return g.select("path", *[v.alias(n) for n, v in path_facts(F.col("path")).items()],
                    "n_rows", "t_start", "t_end", "co2_points")


def delivery(index: DataFrame, rows: DataFrame, instrument: str, sites: list[str], first_year: int,
             last_year: int, path: str = "path", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows of the selected products inside the calendar window, and the list
    of included products."""
    chosen = index.where((F.upper("instrument") == instrument) & F.col("site").isin(list(sites))
                         & F.substring("semester", 1, 4).cast("int").between(first_year, last_year))
    data = rows.join(chosen.select(path), path, "left_semi").where(F.year(ts).between(first_year, last_year))
    return data, chosen


def latest_blocks(df: DataFrame, key: list[str], stamp: list[str]) -> DataFrame:
    """The newest provenance block of each product (a grouped maximum)."""
    rest = [x for x in df.columns if x not in key]
    g = df.groupBy(*key).agg(F.max(F.struct(*stamp, *[x for x in rest if x not in stamp])).alias("_m"))
    return g.select(*[F.col(x) if x in key else F.col(f"_m.{x}").alias(x) for x in df.columns])


def drop_excluded(files: DataFrame, excluded: DataFrame, name: str = "name") -> DataFrame:
    return files.join(excluded.select(name).distinct(), name, "left_anti")


def exclusions_of(deployments: DataFrame, excluded: DataFrame, folder: str, start: str = "start",
                  end: str = "end") -> DataFrame:
    """Which deployment an excluded file belonged to: both ends within a day,
    or any deployment of its folder when its own span is unknown."""
    def day(column: Column) -> Column:
        return F.unix_date(F.to_date(column))
    placed = excluded.where(F.col(start).isNotNull()).select(
        folder, "name", F.col(start).alias("_xs"), F.col(end).alias("_xe"),
        F.explode(F.sequence(day(F.col(start)) - 1, day(F.col(start)) + 1)).alias("_d"))
    dep = deployments.withColumn("_d", day(F.col(start)))
    one = F.expr(_DAY)
    near = dep.join(placed, [folder, "_d"]).where(
        F.col(start).between(F.col("_xs") - one, F.col("_xs") + one)
        & F.col(end).between(F.col("_xe") - one, F.col("_xe") + one))
    unplaced = excluded.where(F.col(start).isNull()).select(folder, "name")
    loose = deployments.join(unplaced, folder)
    return (near.select(*deployments.columns, "name", F.lit(True).alias("placed"))
            .unionByName(loose.select(*deployments.columns, "name", F.lit(False).alias("placed"))))


def preferred_exports(files: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """One export per logger: the spreadsheet when it has one, else the text."""
    stem = F.regexp_replace(F.col(name), r"\.[^.]*$", "")
    prio = F.when(F.lower(F.col(name)).endswith(".xlsx"), 0).otherwise(1)
    return files.groupBy(folder, stem.alias("stem")).agg(F.min(F.struct(prio.alias("p"), F.col(name))).alias("_m")) \
        .select(folder, "stem", F.col(f"_m.{name}").alias(name))


def subset_buckets(bucket_files: DataFrame, site_files: DataFrame, bucket: str, site: str, name: str = "name") -> DataFrame:
    """Buckets whose every file name also lies under their site."""
    there = site_files.select(site, name).distinct().withColumn("_in", F.lit(True))
    m = bucket_files.select(bucket, site, name).distinct().join(there, [site, name], "left")
    return m.groupBy(bucket, site).agg(F.count(F.lit(1)).alias("files"), F.bool_and(F.coalesce("_in", F.lit(False))).alias("redundant"))


def owning_campaign(filed: DataFrame, keys: list[str], campaign: str, campaign_day: Column, data_end: Column) -> DataFrame:
    """The campaign that recovered the logger: the earliest on or after the
    data's end, else the earliest of all; ties by name."""
    late = F.coalesce(F.date_diff(campaign_day, F.to_date(data_end)), F.lit(10 ** 6))
    order = F.struct((late < 0).cast("int").alias("a"), late.alias("b"), F.col(campaign).alias("c"))
    return filed.groupBy(*keys).agg(F.min_by(campaign, order).alias("owner"), F.count_distinct(campaign).alias("campaigns"))


def cast_numbers(df: DataFrame, keys, by, start: str, gap_s: int = 900) -> DataFrame:
    """Number the casts of a serial: a start more than 15 minutes after the
    previous one opens a new cast."""
    t = micros(F.col(start))
    s = ordered(df, keys, by).with_columns(_t=t).scan(_before=Prev("_t"))
    opens = F.coalesce(F.col("_t") - F.col("_before") > gap_s * 1000000, F.lit(True))
    s = s.with_columns(_open=opens.cast("long")).scan(cast_no=RunningSum("_open"))
    return s.rows.drop("_t", "_before", "_open")


_DAY_US = 86_400_000_000                # stamps and spans are microseconds
_REACH = 3 * _DAY_US


def _one_deployment(start: int, end: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the spans are the same deployment as (start, end).

    Both ends within a day, or within three days when the lengths differ by at
    most a twentieth of the longer.
    """
    apart = np.maximum(np.abs(starts - start), np.abs(ends - end))
    lengths = np.stack([np.full(len(starts), end - start), ends - starts])
    alike = (lengths.min(0) > 0) & (np.abs(lengths[0] - lengths[1]) <= 0.05 * lengths.max(0))
    return (apart <= _DAY_US) | (alike & (apart <= _REACH))


_Open = tuple[list[str], np.ndarray, np.ndarray]       # names, starts and ends of the groups that may still grow
_NONE: _Open = ([], np.zeros(0, np.int64), np.zeros(0, np.int64))


def _assigned(files: Iterator[tuple[str, int, int]], held: _Open) -> tuple[list[str], _Open]:
    """Deployments of files in start order after the open groups of those before, and the groups open at the end."""
    names, starts, ends = held
    out = []
    for name, start, end in files:
        past = int(np.searchsorted(starts, start - _REACH))         # too old to take this file or a later one
        names, starts, ends = names[past:], starts[past:], ends[past:]
        fits = np.flatnonzero(_one_deployment(start, end, starts, ends))
        if len(fits):
            ends = ends.copy()
            ends[fits[0]] = max(ends[fits[0]], end)
            out.append(names[fits[0]])
        else:
            names, starts, ends = [*names, name], np.append(starts, start), np.append(ends, end)
            out.append(name)
    return out, (names, starts, ends)


def _by_site(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sites one after the other, whatever batches they come in; only open groups are held."""
    site, held = None, _NONE
    for batch in batches:
        out: list[str] = []
        sites = batch.column(0).to_pylist()
        files = list(zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True))
        edges = [0, *[i for i in range(1, len(sites)) if sites[i] != sites[i - 1]], len(sites)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            if a < z:
                if sites[a] != site:
                    site, held = sites[a], _NONE
                own, held = _assigned(iter(files[a:z]), held)
                out += own
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["site", "name", "deployment"])


def _by_piece(files: pa.Table, before: pa.Table) -> pa.Table:
    """One piece of a long site after the groups handed over to it; the last row hands its own on."""
    held = _NONE
    if before.num_rows:
        held = before.column("names")[0].as_py(), np.array(before.column("starts")[0].as_py(), np.int64), np.array(before.column("ends")[0].as_py(), np.int64)
    if not files.num_rows:
        return pa.table({**{c: files.column(c) for c in ("site", "piece", "name")}, "deployment": files.column("name"),
                         **{c: before.column(c).slice(0, 0) for c in ("names", "starts", "ends")}})
    files = files.sort_by([("start", "ascending"), ("name", "ascending")])
    out, (names, starts, ends) = _assigned(zip(*(files.column(c).to_pylist() for c in ("name", "start", "end")), strict=True), held)
    n = files.num_rows
    nothing = [None] * n
    return pa.table({"site": pa.concat_arrays([files.column("site").combine_chunks(), files.column("site").combine_chunks().slice(0, 1)]),
                     "piece": pa.array(files.column("piece").to_pylist() + [files.column("piece")[0].as_py()], pa.int64()),
                     "name": pa.array(files.column("name").to_pylist() + [None], pa.string()), "deployment": pa.array([*out, None], pa.string()),
                     "names": pa.array([*nothing, names], pa.list_(pa.string())), "starts": pa.array([*nothing, starts.tolist()], pa.list_(pa.int64())),
                     "ends": pa.array([*nothing, ends.tolist()], pa.list_(pa.int64()))})


def _handed_over(rows: DataFrame, kind: str) -> DataFrame:
    """Groups of files in pieces: each piece starts from the groups that the one before left open.

    At first none is known to be open. A piece whose files reach across its
    border then hands on other groups than it was taken to, and all are run
    again with those, until every piece has started from what it was given. A
    group can only be open for three days, so two or three rounds are usual.
    """
    state = "names array<string>, starts array<bigint>, ends array<bigint>"
    given = rows.sparkSession.createDataFrame([], f"site {kind}, piece bigint, {state}")
    while True:
        done = kept(rows.groupBy("site", "piece").cogroup(given.groupBy("site", "piece"))
                    .applyInArrow(_by_piece, f"site {kind}, piece bigint, name string, deployment string, {state}"))
        left = done.where("names IS NOT NULL").select("site", (F.col("piece") + 1).alias("piece"), "names", "starts", "ends")
        left = left.join(rows.select("site", "piece").distinct(), ["site", "piece"], "left_semi")
        if left.exceptAll(given).isEmpty():
            return done.where("names IS NULL").select("site", "name", "deployment")
        given = left


def group_replicates(spans: DataFrame, site: str, name: str, start: str, end: str) -> DataFrame:
    """Group files whose spans are the same deployment, in start order.

    A file joins the oldest group that it fits, and widens it. A group can only
    take files that start within three days of its own start, so only the groups
    of the last three days are ever held. Sites stream through the tasks, one
    small row per file; a site of more files than a piece holds is cut into
    pieces that hand their open groups on. Files without a span are groups of
    their own; a file without a site is of one site with the others like it.
    """
    types = dict(spans.dtypes)
    known = spans.where(F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        F.col(site).alias("site"), F.col(name).cast("string").alias("name"), micros(F.col(start)).alias("start"), micros(F.col(end)).alias("end"))
    cuts = measured(known, "site", ("start", "name"))
    if cuts.none:
        grouped = (known.repartition("site").sortWithinPartitions("site", "start", "name")
                   .mapInArrow(_by_site, f"site {types[site]}, name string, deployment string"))
    else:
        pieces = cuts.numbered(known).withColumn("piece", F.coalesce(PIECE, F.lit(0))).drop(PIECE)
        grouped = _handed_over(pieces, types[site])
    grouped = grouped.select(F.col("site").alias(site), F.col("name").cast(types[name]).alias(name), "deployment")
    lone = spans.where(F.col(start).isNull() | F.col(end).isNull()).select(site, name, F.col(name).cast("string").alias("deployment"))
    return grouped.unionByName(lone)


def identical_sets(files: DataFrame, product: str, digest: str, order: list[Column]) -> DataFrame:
    """Products whose sets of file digests are byte-identical to an earlier one.

    The set is summarised by its size and the sums of the digests' four words,
    which need no list of files per product. ``order`` (over the product row)
    decides which copy is first; ``duplicate_of`` is null for kept ones.
    """
    words = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    sig = files.groupBy(product).agg(F.count(F.lit(1)).alias("files"),
                                     *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    group = ["files", *[f"_w{i}" for i in range(4)]]
    firsts = sig.groupBy(*group).agg(F.min_by(product, F.struct(*order)).alias("_first"))
    out = sig.join(firsts, group)
    return out.select(product, "files", F.when(F.col("_first") != F.col(product), F.col("_first")).alias("duplicate_of"))


def shared_inputs(products: DataFrame, product: str, inputs: str) -> DataFrame:
    """Raw exports that feed more than one product."""
    long = products.select(product, F.explode(F.split(inputs, r"\|")).alias("_s")).select(product, F.trim("_s").alias("source"))
    long = long.where(~F.col("source").isin("", "-"))
    return long.groupBy("source").agg(F.count_distinct(product).alias("products")).where(F.col("products") > 1)


def superseded(products: DataFrame, pairs: DataFrame, inputs: str = "inputs", made: str = "made") -> DataFrame:
    """Stale products whose inputs all lie in their keeper's, which is newer.
    ``pairs`` has ``stale`` and ``keeper``."""
    long = products.select("product", made, F.explode(F.split(inputs, r"\|")).alias("_s"))
    long = long.select("product", made, F.trim("_s").alias("source")).where(~F.col("source").isin("", "-")).distinct()
    old = long.select(F.col("product").alias("stale"), F.col(made).alias("_old"), "source")
    new = long.select(F.col("product").alias("keeper"), "source", F.lit(True).alias("_in"))
    age = products.select(F.col("product").alias("keeper"), F.col(made).alias("_new"))
    m = pairs.join(old, "stale").join(new, ["keeper", "source"], "left").join(age, "keeper")
    g = m.groupBy("stale", "keeper").agg(F.bool_and(F.coalesce("_in", F.lit(False))).alias("contained"),
                                         (F.max("_new") > F.max("_old")).alias("newer"))
    return g.withColumn("superseded", F.col("contained") & F.col("newer"))


def numbered_names(items: DataFrame, group: list[str], order: list[str], stem: Column, out: str = "name") -> DataFrame:
    """Product names; a number is added only where a group holds several."""
    s = ordered(items, group, order).scan(_i=Position())
    rows = attach_aggregates(s.rows, group, {"_n": F.count(F.lit(1))}, s.cuts)
    suffix = F.when(F.col("_n") > 1, F.concat(F.lit("_"), (F.col("_i") + 1).cast("string"))).otherwise(F.lit(""))
    return rows.select(*items.columns, F.concat(stem, suffix, F.lit("_QLF")).alias(out))


def without_light(rows: DataFrame, deployment: list[str], file: str, light: str) -> DataFrame:
    """Deployments whose every file lacks a light reading."""
    per = rows.groupBy(*deployment, file).agg((F.count(light) == 0).alias("_dark"))
    return per.groupBy(*deployment).agg(F.bool_and("_dark").alias("temperature_only"))


def modal_step(steps: DataFrame, keys: list[str], step: str) -> DataFrame:
    """Most common positive step (smallest on ties); counted per step first."""
    n = steps.where(F.col(step) > 0).groupBy(*keys, step).count()
    return n.groupBy(*keys).agg(F.max_by(step, F.struct("count", -F.col(step))).alias("interval"))

