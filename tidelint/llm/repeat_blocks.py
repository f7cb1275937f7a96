"""Substring deduplication by fixed-block anchors.

A repeat of 35 words holds, whatever its place, a whole block of 18 words that
starts at a multiple of 18 in its own document. So the blocks that do not
overlap are the reference index, every rolling window of 18 words of every
document probes it, and only windows of 35 words around a block that was hit
elsewhere can repeat. These are compared by their own digest, which extends a
hit in both directions; runs of repeating windows are the maximal repeats.

Documents are dealt to chunks by their content. A chunk sends each distinct
digest once, packed by digest bucket, and gets back one bit per digest. So a
passage that a third of all documents share costs one entry a chunk, no pairs
are formed, and texts are shuffled once (the exchange is used three times).

Removal is judged on the input: a word goes when a window of 35 words that
covers it also starts anywhere else, in the same document too. Null and empty
texts have no words. Rows equal in every column fall into one chunk and count as
separate documents. The windows' digests have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames
from tidelint.llm.wordhash import inside, window_digests, word_digests, word_spans

WINDOW = 35


def repeats(docs: DataFrame, window: int = WINDOW, text: str = "text") -> DataFrame:
    """Per row: all its columns, `n_words`, `n_removed`, `kept_text` and `kept_sha256`.

    Kept text has the kept words with the white space that followed each; the
    digest is of the kept words joined by one space.
    """
    block = (window + 1) // 2
    total = frames.text_bytes(docs, text)
    chunks = frames.parts_of(total, 2 << 20, 32 << 20)
    buckets = max(12, frames.parts_of(total, 8 << 20, 64 << 20))
    inner = [f"c{i}" for i in range(len(docs.columns))]
    base = (docs.toDF(*inner)
            .withColumn("chunk", F.pmod(F.xxhash64(*frames.hashable(docs, inner)), F.lit(chunks)).cast("int")))
    at = inner[docs.columns.index(text)]

    probes = base.groupBy("chunk").applyInArrow(_probe(at, block, buckets), "chunk int, bucket int, n int, keys binary, flags binary")
    hits = probes.groupBy("bucket").applyInArrow(_meet(2, np.uint32), "chunk int, bucket int, bits binary, step int")
    wide = (base.groupBy("chunk").cogroup(hits.groupBy("chunk"))
            .applyInArrow(_extend(at, block, window, buckets), "chunk int, bucket int, n int, keys binary, flags binary"))
    twice = wide.groupBy("bucket").applyInArrow(_meet(1, np.uint64), "chunk int, bucket int, bits binary, step int")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields if f.name != "chunk")
    done = (base.groupBy("chunk").cogroup(hits.unionByName(twice).groupBy("chunk"))
            .applyInArrow(_remove(at, inner, block, window, buckets),
                          f"{fields}, n_words bigint, n_removed bigint, kept_text string, kept_sha256 string"))
    clash = {"n_words", "n_removed", "kept_text", "kept_sha256"} & set(docs.columns)
    back = [F.col(i).alias(c) for i, c in zip(inner, docs.columns, strict=True) if c not in clash]
    return done.select(*back, "n_words", "n_removed", "kept_text", "kept_sha256")


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with the repeated words taken out of `text`; `n_chars` follows the text."""
    inner = {c: f"in_{i}" for i, c in enumerate(docs.columns)}
    out = repeats(docs.toDF(*inner.values()), window, inner["text"])
    changed = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(inner["text"]))
    cols = [changed.alias(c) if c == "text" else
            F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col(i)).alias(c) if c == "n_chars" else
            F.col(i).alias(c) for c, i in inner.items()]
    return out.select(*cols)


class _Grams:
    """Words and rolling digests of one chunk, the same each time it is read."""

    def __init__(self, column: pa.ChunkedArray, block: int, buckets: int) -> None:
        self.data, self.offsets = frames.binary_text(column)
        self.starts, self.ends, self.firsts = word_spans(self.data, self.offsets)
        self.words = word_digests(self.data, self.starts, self.ends)
        grams = window_digests(self.words, block)
        self.at = np.flatnonzero(inside(self.firsts, block, len(grams)))
        own = self.at - self.firsts[np.searchsorted(self.firsts, self.at, "right") - 1]
        self.aligned = own % block == 0
        grams = grams[self.at]
        bucket = ((grams >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        self.keys, self.which, self.counts = np.unique(
            (bucket << np.uint64(32)) | (grams & np.uint64(0xFFFFFFFF)), return_inverse=True, return_counts=True)
        self.bucket = (self.keys >> np.uint64(32)).astype(np.int64)

    def anchors(self, hit: np.ndarray) -> np.ndarray:
        """Positions of own blocks whose digest was hit."""
        return self.at[self.aligned & hit[self.which]]

    def around(self, anchors: np.ndarray, block: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct digests of the windows that hold an anchor, and each such window's position."""
        wide = window_digests(self.words, window)
        near = np.zeros(len(wide) + 1, np.int64)
        rows = np.searchsorted(self.firsts, anchors, "right") - 1
        low = np.maximum(anchors + block - window, self.firsts[rows])
        high = np.minimum(anchors, self.firsts[rows + 1] - window)
        ok = low <= high
        np.add.at(near, low[ok], 1)
        np.add.at(near, high[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        return wide[at], at


def _packed(chunk: int, buckets: np.ndarray, keys: np.ndarray, flags: np.ndarray, kind: type) -> pa.Table:
    """One row per bucket; keys are sorted, so a bucket is a run of them."""
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
    ends = np.append(cuts[1:], len(buckets))[:len(cuts)]
    return pa.table({
        "chunk": pa.array([chunk] * len(cuts), pa.int32()), "bucket": pa.array(buckets[cuts], pa.int32()),
        "n": pa.array(ends - cuts, pa.int32()),
        "keys": pa.array([keys[a:b].astype(kind).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
        "flags": pa.array([flags[a:b].astype(np.uint8).tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())})


def _probe(at: str, block: int, buckets: int) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        g = _Grams(table.column(at), block, buckets)
        anchored = np.zeros(len(g.keys), np.uint8)
        anchored[g.which[g.aligned]] = 2
        return _packed(table.column("chunk")[0].as_py(), g.bucket, g.keys, anchored | (g.counts > 1), np.uint32)
    return run


def _meet(step: int, kind: type) -> Callable:
    """Per bucket: which digests occur at two places, and (bit 2) as a block; one bit for each back to its chunk."""
    def run(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        keys = np.concatenate([np.frombuffer(x, kind) for x in table.column("keys").to_pylist()])
        flags = np.concatenate([np.frombuffer(x, np.uint8) for x in table.column("flags").to_pylist()])
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        new = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        marks = flags[order]
        places = np.add.reduceat(1 + (marks & 1).astype(np.int64), new)
        seen = np.bitwise_or.reduceat(marks, new) >= step
        good = (places > 1) & seen if step == 2 else places > 1
        hit = np.empty(len(keys), bool)
        hit[order] = np.repeat(good, np.diff(np.append(new, len(keys))))
        ends = np.cumsum(sizes)
        out = [(c, np.packbits(hit[e - n:e]).tobytes()) for c, n, e in zip(table.column("chunk").to_pylist(), sizes, ends, strict=True) if hit[e - n:e].any()]
        bucket = table.column("bucket")[0].as_py()
        return pa.table({"chunk": pa.array([c for c, _ in out], pa.int32()), "bucket": pa.array([bucket] * len(out), pa.int32()),
                         "bits": pa.array([b for _, b in out], pa.binary()), "step": pa.array([step] * len(out), pa.int32())})
    return run


def _unpacked(bits: pa.Table, step: int, buckets: np.ndarray) -> np.ndarray:
    """One flag per key, in the order in which the keys were sent."""
    hit = np.zeros(len(buckets), bool)
    for bucket, payload, own in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), bits.column("step").to_pylist(), strict=True):
        if own == step:
            a, b = np.searchsorted(buckets, (bucket, bucket + 1))
            hit[a:b] = np.unpackbits(np.frombuffer(payload, np.uint8), count=b - a)
    return hit


def _wide_keys(grams: _Grams, bits: pa.Table, block: int, window: int, buckets: int) -> tuple:
    anchors = grams.anchors(_unpacked(bits, 2, grams.bucket))
    digests, at = grams.around(anchors, block, window)
    keys, which, counts = np.unique(digests, return_inverse=True, return_counts=True)
    return keys, (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64), which, counts, at


def _extend(at: str, block: int, window: int, buckets: int) -> Callable:
    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        if not table.num_rows or not bits.num_rows:
            none = np.zeros(0, np.int64)
            return _packed(0, none, none, none, np.uint64)
        grams = _Grams(table.column(at), block, buckets)
        keys, bucket, _, counts, _ = _wide_keys(grams, bits, block, window, buckets)
        return _packed(table.column("chunk")[0].as_py(), bucket, keys, counts > 1, np.uint64)
    return run


def _remove(at: str, inner: list[str], block: int, window: int, buckets: int) -> Callable:
    def run(table: pa.Table, bits: pa.Table) -> pa.Table:
        grams = _Grams(table.column(at), block, buckets)
        gone = np.zeros(len(grams.words), bool)
        if bits.num_rows:
            _, bucket, which, _, places = _wide_keys(grams, bits, block, window, buckets)
            starts = places[_unpacked(bits, 1, bucket)[which]]
            cover = np.zeros(len(gone) + 1, np.int64)
            cover[starts] += 1
            cover[np.minimum(starts + window, len(gone))] -= 1
            gone = np.cumsum(cover[:-1]) > 0
        texts, digests, removed = [], [], []
        raw = grams.data.tobytes()
        for row in range(table.num_rows):
            a, b = grams.firsts[row], grams.firsts[row + 1]
            text = raw[grams.offsets[row]:grams.offsets[row + 1]]
            n = int(gone[a:b].sum())
            if n:
                keep = np.flatnonzero(~gone[a:b]) + a
                follow = np.append(grams.starts[a + 1:b], grams.offsets[row + 1])
                text = b"".join([raw[s:e] for s, e in zip(grams.starts[keep].tolist(), follow[keep - a].tolist(), strict=True)])
            texts.append(text.decode())
            digests.append(hashlib.sha256(b" ".join(text.split())).hexdigest())
            removed.append(n)
        return pa.table({**{c: table.column(c) for c in inner},
                         "n_words": pa.array(np.diff(grams.firsts), pa.int64()), "n_removed": pa.array(removed, pa.int64()),
                         "kept_text": pa.array(texts, pa.string()), "kept_sha256": pa.array(digests, pa.string())})
    return run
