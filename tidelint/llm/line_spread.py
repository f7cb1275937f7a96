"""Line deduplication by the spread of a line over distinct sites.

Each normalised line has a hash and a HyperLogLog sketch of the sites that hold
it; sketches merge in a partial aggregate, so a line of a third of all documents
is one small row a task. Lines whose estimate lies near the threshold get an
exact distinct count, the others are settled by the estimate. A line on at least
`sites` sites is boilerplate: it stays in the first document that has it (least
id, then least hash of the text) and goes from all others.

A line is normalised by trimming and lower case; only lines of at least
`words` words are judged, so short phrases that meet by chance stay. Null text
stays null; a null site counts as one site of its own. Rows equal in id and text
are treated alike. Native expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames

SITES, WORDS = 5, 3
_LOG_SIZE = 12
_BLANKS = " \t\r\x0b\f"
_NONE = -(2**63)


def _normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(_BLANKS)))


def _judged(line: Column, words: int) -> Column:
    return line.rlike(r"[^\s]+" + r"\s+[^\s]+" * (words - 1))


def _lines(docs: DataFrame, words: int, site: str) -> DataFrame:
    """(id, text hash, site, line hash) of each distinct judged line of a document."""
    own = F.filter(F.split("text", "\n"), lambda x: _judged(x, words))
    return (docs.select(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), F.xxhash64("text").alias("body"),
                        F.coalesce(F.concat(F.lit("="), F.col(site)), F.lit("")).alias("site"),
                        F.explode(F.array_distinct(F.transform(own, lambda x: F.xxhash64(_normal(x))))).alias("line")))


def boilerplate(docs: DataFrame, sites: int = SITES, words: int = WORDS, site: str = "source") -> DataFrame:
    """(id, body, line): the lines to take out of each document, one row for each."""
    lines = _lines(docs, words, site)
    spread = (lines.groupBy("line").agg(F.hll_sketch_agg("site", F.lit(_LOG_SIZE)).alias("sketch"), F.min(F.struct("id", "body")).alias("first"))
              .select("line", "first", F.hll_sketch_estimate("sketch").alias("estimate")))
    # The sketch errs by 1.04 / sqrt(4096); four times that, and one site at least, is near.
    near = max(1.0, 4 * 1.04 / 64 * sites)
    found = frames.stored(spread.where(F.col("estimate") >= sites - near))
    held = frames.stored(lines.join(found, "line"))
    exact = (held.where(F.col("estimate") <= sites + near).groupBy("line").agg(F.countDistinct("site").alias("exact")))
    return (held.join(exact, "line", "left").where(F.coalesce("exact", "estimate") >= sites)
            .where((F.col("id") != F.col("first.id")) | (F.col("body") != F.col("first.body")))
            .select("id", "body", "line").distinct())


def deduplicated(docs: DataFrame, sites: int = SITES, words: int = WORDS, site: str = "source") -> DataFrame:
    """`docs` without its boilerplate lines; `n_chars` follows the text."""
    out = _cut(docs, sites, words, site)
    return out.select(*[F.when(F.col("taken") > 0, F.col("kept_text")).otherwise(F.col(i)).alias(c) if c == "text" else
                        F.when(F.col("taken") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col(i)).alias(c) if c == "n_chars" else
                        F.col(i).alias(c) for c, i in _inner(docs).items()])


def spread_report(docs: DataFrame, sites: int = SITES, words: int = WORDS, site: str = "source") -> DataFrame:
    """Per row: doc_id, n_lines, n_removed and the kept text's digest."""
    inner = _inner(docs)
    text = F.coalesce(inner["text"], F.lit(""))
    return (_cut(docs, sites, words, site)
            .select(F.col(inner["doc_id"]).alias("doc_id"), F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"), F.col("taken").alias("n_removed"),
                    F.sha2(F.when(F.col("taken") > 0, F.col("kept_text")).otherwise(text), 256).alias("kept_sha256")))


def _inner(docs: DataFrame) -> dict[str, str]:
    return {c: f"in_{i}" for i, c in enumerate(docs.columns)}


def _cut(docs: DataFrame, sites: int, words: int, site: str) -> DataFrame:
    """`docs` under inner names, with `kept_text` and the number of lines `taken`."""
    inner = _inner(docs)
    gone = (boilerplate(docs, sites, words, site).groupBy("id", "body").agg(F.collect_set("line").alias("gone")))
    rows = (docs.toDF(*inner.values()).withColumn("id", F.coalesce(inner["doc_id"], F.lit(_NONE))).withColumn("body", F.xxhash64(inner["text"]))
            .join(gone, ["id", "body"], "left"))
    lines = F.split(inner["text"], "\n")
    kept = F.when(F.col("gone").isNotNull(), F.filter(lines, lambda x: ~(_judged(x, words) & F.array_contains("gone", F.xxhash64(_normal(x))))))
    return (rows.withColumn("kept", kept).withColumn("kept_text", F.array_join("kept", "\n"))
            .withColumn("taken", F.when(F.col("gone").isNotNull(), F.size(lines) - F.size("kept")).otherwise(0).cast("bigint")))


SQL = rf"""
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos FROM documents),
n AS (SELECT *, lower(trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) AS line, regexp_matches(raw, '\S+\s+\S+\s+\S+') AS judged FROM l),
b AS (SELECT line, min(doc_id) AS first FROM n WHERE judged GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
k AS (SELECT n.doc_id, count(*) FILTER (WHERE judged AND b.line IS NOT NULL AND b.first <> n.doc_id) AS n_removed,
      coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (WHERE NOT (judged AND b.line IS NOT NULL AND b.first <> n.doc_id)), '') AS kept
      FROM n LEFT JOIN b USING (line) GROUP BY n.doc_id)
SELECT doc_id, len(string_split(coalesce(text, ''), chr(10)))::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
