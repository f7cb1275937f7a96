"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model on counts of characters and words gives each document's own
evidence. Hosts, and paths within hosts, get Beta posteriors of the share of
good documents from the summed evidence: a path is shrunk toward its host and a
host toward the global share, the more so the fewer documents it has. How strong
the priors are comes from the spread between hosts and between the paths of a
host (method of moments). The final log odds are the document's plus those of
its path against the global share, weighted. Documents below `KEEP` go.

Host and path are columns (here the source, and the language within it). Sums
by path are partial aggregates, hosts are sums of paths; only three moments come
to the driver. The model is fitted on at most `FITTED` labelled documents, those
of the least hash of their id; everything else covers all documents.

Null text counts as empty and gets the evidence of a text without words. Null
hosts and paths are values like others. With no labels of both kinds the evidence
is one half plus a little for all, and nothing goes. Repeated labels count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames
from tidelint.llm.wordhash import word_digests, word_spans

#: Labelled documents that the document model is fitted on at most.
FITTED = 20_000
#: How much the path's log odds count, and the limits of a prior's weight in documents.
SITE_WEIGHT, WEAKEST, STRONGEST = 0.5, 2.0, 10_000.0
#: Final probability from which a document stays; below one half, as losing good text costs more than keeping some bad.
KEEP = 0.3
_FEATURES = 12


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


_COUNTED = np.stack([_table(b"#*$%&<>"), _table(b"|"), _table(b"!"), _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"),
                     _table(b".,;:?"), _table(b"\n")])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of numbers for each text of a batch."""
    n = len(offsets) - 1
    counts = np.zeros((len(_COUNTED), n))
    for k, own in enumerate(_COUNTED):
        sums = np.concatenate(([0], np.cumsum(own[data])))
        counts[k] = sums[offsets[1:]] - sums[offsets[:-1]]
    symbol, bar, shout, upper, lower, digit, point, line = counts
    starts, ends, firsts = word_spans(data, offsets)
    words = word_digests(data, starts, ends)
    per = np.diff(firsts)
    row = np.repeat(np.arange(n), per)
    again = np.zeros(n)
    np.add.at(again, row[1:], (words[1:] == words[:-1]) & (row[1:] == row[:-1]))
    order = np.lexsort((words, row))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    kinds = np.bincount(row[order][fresh], minlength=n)
    letters = np.bincount(row, ends - starts, minlength=n)
    w, size = np.maximum(per, 1), np.maximum(np.diff(offsets), 1)
    return np.stack([np.log1p(per), symbol / w, bar / w, shout / w, upper / np.maximum(upper + lower, 1), digit / size, point / w, line / w,
                     again / w, kinds / w ** 0.9, np.log1p(letters / w), (per < 5).astype(float)], axis=1)


class DocumentModel:
    """Logistic regression by Newton steps, on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> None:
        self.usable = len(y) > 0 and 0 < y.sum() < len(y)
        if not self.usable:
            return
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        self.weights = np.zeros(z.shape[1])
        ridge = penalty * np.eye(z.shape[1])
        ridge[0, 0] = 1e-9
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ self.weights)
            self.weights += step
            if np.abs(step).max() < 1e-8:
                break

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def evidence(self, x: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(x), 0.5 + 1e-6)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -12, 12)))


def measured(docs: DataFrame, host: str, path: str) -> DataFrame:
    """(doc_id, host, path, x): the features of each document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _batch_features(batch.column(3))
            yield pa.record_batch({"doc_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "x": pa.array(list(x), pa.list_(pa.float64()))})

    return (docs.select(F.col("doc_id").cast("bigint"), F.col(host).cast("string"), F.col(path).cast("string"), "text")
            .mapInArrow(run, "doc_id bigint, host string, path string, x array<double>"))


def _batch_features(column: pa.Array) -> np.ndarray:
    data, offsets = frames.binary_text(column)
    parts = [features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in frames.slices(offsets, 2 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, _FEATURES))


def fitted(measures: DataFrame, labels: DataFrame, most: int = FITTED) -> DocumentModel:
    """The document model, from at most `most` labelled documents."""
    rows = (labels.where("quality IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("y"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).join(measures.select("doc_id", "x"), "doc_id").select("x", "y").toPandas())
    return DocumentModel(np.stack(rows.x.to_list()) if len(rows) else np.zeros((0, _FEATURES)), rows.y.to_numpy(float))


def _strength(groups: DataFrame, share: str, center: Column, n: str) -> float:
    """Weight of a Beta prior, in documents, from the spread of group shares around `center`."""
    weight, gap = F.col(n), F.col(share) - center
    moments = groups.where(weight > 1).agg(F.sum(weight), F.sum(weight * gap * gap), F.sum(center * (1 - center)), F.count("*")).first()
    if not moments[0] or moments[3] < 2:
        return STRONGEST
    inner = moments[2] / moments[3]                                  # variance of one document
    between = moments[1] / moments[0] - inner * moments[3] / moments[0]
    return STRONGEST if between <= 0 else float(np.clip(inner / between - 1, WEAKEST, STRONGEST))


def posteriors(evidence: DataFrame) -> DataFrame:
    """(host, path, global_share, host_share, path_share) from (host, path, evidence), one row a path."""
    paths = frames.stored(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("evidence").alias("good")))
    total = paths.agg(F.sum("good"), F.sum("n")).first()
    share = float(np.clip((total[0] or 0.0) / (total[1] or 1), 1e-6, 1 - 1e-6))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    first = _strength(hosts.withColumn("raw", F.col("host_good") / F.col("host_n")), "raw", F.lit(share), "host_n")
    hosts = hosts.select(F.struct("host").alias("key"), ((F.col("host_good") + first * share) / (F.col("host_n") + first)).alias("host_share"))
    both = paths.withColumn("key", F.struct("host")).join(hosts, "key").withColumn("raw", F.col("good") / F.col("n"))
    second = _strength(both, "raw", F.col("host_share"), "n")
    return both.select("host", "path", F.lit(share).alias("global_share"), "host_share",
                       ((F.col("good") + second * F.col("host_share")) / (F.col("n") + second)).alias("path_share"))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _combined(rows: DataFrame, sites: DataFrame, host: str, path: str) -> DataFrame:
    """`rows` with the shares of their path and the final `quality`."""
    sites = sites.select(F.struct("host", "path").alias("site"), "global_share", "host_share", "path_share")
    out = rows.withColumn("site", F.struct(F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"))).join(sites, "site").drop("site")
    odds = _logit(F.col("evidence")) + SITE_WEIGHT * (_logit(F.col("path_share")) - _logit(F.col("global_share")))
    return out.withColumn("quality", 1 / (1 + F.exp(-odds)))


def _evidence(measures: DataFrame, model: DocumentModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(3).flatten()).reshape(batch.num_rows, -1)
            yield pa.record_batch({"doc_id": batch.column(0), "host": batch.column(1), "path": batch.column(2), "evidence": pa.array(model.evidence(x))})

    return measures.mapInArrow(run, "doc_id bigint, host string, path string, evidence double")


def judged(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """Per row: doc_id, evidence, host_share, path_share, quality and kept."""
    measures = frames.stored(measured(docs, host, path))
    rows = _evidence(measures, fitted(measures, labels))
    return (_combined(rows, posteriors(rows), "host", "path")
            .select("doc_id", "evidence", "host_share", "path_share", "quality", (F.col("quality") >= KEEP).alias("kept")))


def filtered(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang") -> DataFrame:
    """`docs` without the rows that the classifier rejects."""
    measures = frames.stored(measured(docs, host, path))
    model = fitted(measures, labels)
    sites = posteriors(_evidence(measures, model))
    inner = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    at = list(inner).index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = model.evidence(_batch_features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], [*batch.schema.names, "evidence"])

    renamed = docs.toDF(*inner.values())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in renamed.schema.fields)
    rows = renamed.mapInArrow(run, f"{fields}, evidence double")
    return (_combined(rows, sites, inner[host], inner[path]).where(F.col("quality") >= KEEP)
            .select(*[F.col(i).alias(c) for c, i in inner.items()]))
