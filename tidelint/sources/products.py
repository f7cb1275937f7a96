"""Finding, reading and writing qualified tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelint.operators.ordering import shared_folder  # noqa: F401
from tidelint.operators.qc_tests import c


def discover(spark: SparkSession, root: str, subfolders: list[str], report_prefix: str,
             glob: str = "*.csv") -> DataFrame:
    """Qualified files below ``root``: those directly inside one of the known
    subfolders whose name does not start like a report. Contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", glob).load(root).select("path", "modificationTime", "length"))
    return pick_products(files, subfolders, report_prefix)


def pick_products(files: DataFrame, subfolders: list[str], report_prefix: str) -> DataFrame:
    """The same choice over any listing with a ``path`` column."""
    part = F.split(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), "/")
    name, folder = F.element_at(part, -1), F.try_element_at(part, F.lit(-2))
    return files.where(folder.isin(list(subfolders)) & F.lower(name).endswith(".csv")
                       & ~F.startswith(name, F.lit(report_prefix)))


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition: str | None = "site",
                mode: str = "overwrite") -> None:
    """Write a qualified table, one directory per site. Rows of a site are not
    gathered first: a site may be most of the data."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", "true")
    if partition:
        writer = writer.partitionBy(partition)
    writer.save(path)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def as_nulls(df: DataFrame) -> DataFrame:
    """NaN, the missing value of exports, becomes NULL in every double column."""
    return df.withColumns({n: F.when(~F.isnan(c(n)), c(n)) for n, t in df.dtypes if t in ("double", "float")})
