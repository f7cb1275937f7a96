"""Small helpers shared by the operators: tables, reliable stores, sizes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, so that nothing above it runs again."""
    _ensure_folder(df.sparkSession)
    return df.checkpoint()


def stored_counting(df: DataFrame, what: str | Column = "true") -> tuple[DataFrame, int]:
    """`df` stored, and for how many of its rows `what` holds, counted while they are written."""
    seen = Observation()
    kept = stored(df.observe(seen, F.count_if(F.expr(what) if isinstance(what, str) else what).alias("rows")))
    return kept, seen.get["rows"]


def _ensure_folder(spark: SparkSession) -> None:
    """The folder is the one the cluster names in ``spark.checkpoint.dir``; only a local session that names none gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="tidelint-llm-")
        context.setCheckpointDir(folder)


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from one aggregate."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parts_of(total: int, least: int, most: int, wanted: int = 4096) -> int:
    """How many parts `total` bytes make, a part being `least` bytes and growing to `most` once there are `wanted` parts."""
    return max(1, -(-total // min(most, max(least, total // wanted))))


def hashable(docs: DataFrame, names: list[str]) -> list[str]:
    """Those of `names`, the columns of `docs` in order, whose types Spark can hash."""
    return [n for n, f in zip(names, docs.schema.fields, strict=True)
            if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]


def binary_text(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string array; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
        if isinstance(array, pa.ChunkedArray):
            array = array.chunk(0) if array.num_chunks else pa.array([], pa.string())
    array = array.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = array.buffers()[2] if len(array) else None
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, end
        row = end


_RUN = 200_000      # edges that are contracted together inside a task


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b): root is the least node that can be reached.

    Tasks first replace the edges that they hold by stars, in runs of a bounded
    number. Each round then points every node at its least neighbour, doubles the
    pointers until all end at a node that points nowhere, and contracts the edges
    to those between such nodes. A round at least halves the nodes that still have
    edges. Steps are cut by a reliable store; only numbers of rows come to the driver.
    """
    edges = edges.where("a <> b").select("a", "b")
    left, rows = stored_counting(edges.mapInArrow(_stars, edges.schema).distinct())
    labels = None
    for _ in range(most_rounds):
        if not rows:
            return labels if labels is not None else left.toDF("node", "root")
        steps = stored(left.select(F.col("b").alias("node"), F.col("a").alias("low")).union(left.select("a", "a"))
                       .groupBy("node").agg(F.min("low").alias("low")))
        moved = 1
        while moved:
            above = steps.where("node <> low").select(F.col("node").alias("low"), F.col("low").alias("lower"))
            steps, moved = stored_counting(steps.select("node", "low").join(above, "low", "left").select("node", F.coalesce("lower", "low").alias("low"), F.col("lower").isNotNull().alias("moved")), "moved")
        steps = steps.drop("moved")
        if labels is None:
            labels = steps.toDF("node", "root")
        else:
            labels = stored(labels.join(steps.toDF("root", "low"), "root", "left").select("node", F.coalesce("low", "root").alias("root")))
        left, rows = stored_counting(left.join(steps.toDF("a", "low_a"), "a").join(steps.toDF("b", "low_b"), "b")
                                     .where("low_a <> low_b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).distinct())
    raise RuntimeError(f"edges are left after {most_rounds} rounds")


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """`labels`, the components (node, root) of a graph, once `edges` (a, b) are added to it."""
    ends = (edges.join(labels.toDF("a", "root_a"), "a", "left").join(labels.toDF("b", "root_b"), "b", "left")
            .select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    tops = components(ends)
    known = labels.join(tops.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.union(tops.join(labels, "node", "left_anti").select("node", "root"))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of edges, each as (least node that the run's edges reach, node)."""
    def star(run: list[pa.RecordBatch]) -> pa.RecordBatch:
        above: dict = {}

        def top(x):
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        for batch in run:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    above[max(x, y)] = min(x, y)
        ends = [(top(x), x) for x in list(above) if above[x] != x]
        kind = run[0].schema.types
        return pa.record_batch({"a": pa.array([x for x, _ in ends], kind[0]), "b": pa.array([y for _, y in ends], kind[1])})

    run, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            run.append(batch)
            rows += batch.num_rows
        if rows >= _RUN:
            yield star(run)
            run, rows = [], 0
    if run:
        yield star(run)


def rewritten(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to a fresh folder beside the stores, and read again."""
    spark = df.sparkSession
    _ensure_folder(spark)
    out = f"{spark.sparkContext.getCheckpointDir()}/rewritten-{uuid.uuid4()}"
    df.write.parquet(out)
    return spark.read.parquet(out)
