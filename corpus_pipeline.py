"""The corpus pipeline: quality, lines, near duplicates, passages, packing.

Each stage takes the documents that its predecessor kept and returns them with
its decisions done; the last returns the packed pieces. Stages are written to
the shared checkpoint folder and read again, so a lost executor repeats one
stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelint.llm import line_spread, order_minhash, quality_bayes, repeat_blocks, residual_packing
from tidelint.llm.frames import rewritten, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_bayes.filtered(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_spread.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return order_minhash.deduplicated(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeat_blocks.deduplicated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return residual_packing.packed(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("MinHash near-dedup", near_duplicates),
          ("substring dedup", passages), ("best-fit packing", packing)]

#: Near duplicates, passages and token ids cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = rewritten(stage(spark, docs, sf_dir))
    return docs
