"""Provenance files: one block of lines per product, and their keyed replacement.

A block ends at an empty line. Its first line names the product, unless it begins
with a space; every other line that reads ``word : text`` is a field. The last of
equal fields and the last of equally named blocks of a file count.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelint.operators.ordering import RunningSum, ordered
from tidelint.sources.text_exports import read_lines

# The fields of a block, and the names they get in the product index.
FIELDS = {"tipo": "kind", "campaign": "campaign", "cast": "cast_start", "co2": "co2_file", "stations": "stations", "inputs": "inputs"}
_FIELD = r"^\s*(\w+)\s*:\s*(.*)"
_ABSENT = {"co2": "-"}


def read_provenance(spark: SparkSession, root: str, name: str = "provenance.txt") -> DataFrame:
    """Blocks of every provenance file below ``root``."""
    return provenance_blocks(read_lines(spark, root, name))


def provenance_blocks(lines: DataFrame) -> DataFrame:
    """(file, name, the columns of FIELDS) from numbered lines (file, line_no, line).

    A line belongs to the block numbered by the empty lines before it in its
    file, a running sum that carries over the splits of a long file.
    """
    text = F.rtrim(F.regexp_replace("line", r"\r$", ""))
    s = ordered(lines.withColumn("_text", F.regexp_replace("line", r"\r$", "")), "file", "line_no").with_columns(
        _ends=(F.col("_text") == "").cast("long")).scan(_block=RunningSum("_ends"))
    solid = F.trim("_text") != ""
    word, value = F.regexp_extract("_text", _FIELD, 1), F.trim(F.regexp_extract("_text", _FIELD, 2))
    entry = F.struct(F.col("line_no").alias("no"), text.alias("text"))
    found = s.rows.where(solid).groupBy("file", "_block").agg(
        F.min(entry).alias("_head"), F.min_by("_text", "line_no").alias("_first"),
        *[F.max(F.when(word == f, F.struct(F.col("line_no").alias("no"), value.alias("text")))).alias(f"_f_{f}") for f in FIELDS])
    named = found.where(~F.startswith("_first", F.lit(" "))).select(
        "file", F.trim("_head.text").alias("name"), "_block",
        # the first line is the name, whatever it looks like
        *[F.when(F.col(f"_f_{f}.no") > F.col("_head.no"), F.col(f"_f_{f}.text")).alias(out) for f, out in FIELDS.items()])
    last = named.groupBy("file", "name").agg(F.max(F.struct("_block", *FIELDS.values())).alias("_b"))
    return last.select("file", "name", *[F.col(f"_b.{out}").alias(out) for out in FIELDS.values()])


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def with_provenance(index: DataFrame, blocks: DataFrame) -> DataFrame:
    """The product index (``path``, ``product``) with the fields of each product's block in its folder's file."""
    known = blocks.select(folder_of(F.col("file")).alias("_folder"), F.col("name").alias("product"), *FIELDS.values())
    joined = index.withColumn("_folder", folder_of(F.col("path"))).join(known, ["_folder", "product"], "left")
    return joined.select(*index.columns, *[F.coalesce(out, F.lit(_ABSENT.get(f, ""))).alias(out) for f, out in FIELDS.items()])


def replace_blocks(df: DataFrame, path: str, key: str) -> str:
    """Replace all rows of the keys in ``df``; other keys keep theirs. Returns the folder written.

    Rows are written to a folder of their own first. The switch is one small
    file that says which folder holds which key from now on; it appears whole or
    not at all. A run that fails before it leaves the table as it was, and a
    repeated run ends in the same rows. One writer at a time.
    """
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4()}"
    df.write.parquet(f"{path}/{folder}")
    _switch(spark, path, folder, key)
    return folder


def _switch(spark: SparkSession, path: str, folder: str, key: str) -> None:
    written = spark.read.parquet(f"{path}/{folder}")
    known = _manifest(spark, path)
    version = (known.agg(F.max("version")).first()[0] or 0) + 1 if known is not None else 1
    (written.select(F.col(key).alias("key")).distinct().select("key", F.lit(folder).alias("folder"), F.lit(version).alias("version"))
     .coalesce(1).write.mode("append").parquet(f"{path}/manifest"))


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """Every switch so far; None before the first."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
             .load(path).select("path"))
    if files.where(F.contains("path", F.lit("/manifest/"))).isEmpty():
        return None
    return spark.read.parquet(f"{path}/manifest")


def read_blocks(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The rows in force of a table written by ``replace_blocks``."""
    live = spark.read.parquet(f"{path}/manifest").groupBy("key").agg(F.max_by("folder", "version").alias("folder"))
    folders = [r[0] for r in live.select("folder").distinct().collect()]       # one a replacement still in force
    rows = spark.read.parquet(*[f"{path}/{f}" for f in folders])
    at = F.regexp_extract(F.col("_metadata.file_path"), r"/(data-[^/]+)/[^/]+$", 1)
    held = rows.withColumn("_folder", at).alias("a").join(
        live.alias("b"), F.col(f"a.`{key}`").eqNullSafe(F.col("b.key")) & (F.col("a._folder") == F.col("b.folder")), "left_semi")
    return held.drop("_folder")
