"""Prefix trie of rebuilt conversations by whole-sequence collapse.

Turns are ordered by turn (null first; equal turns by role, then length, then
digest of the text). A conversation c is rebuilt from the first h turns of its base c - c % 100
(all if the base has fewer, none if it is absent) and from its own turns after
its first h, h being crc32 of its decimal id modulo 6. Texts never leave the scan: a
turn is its 128-bit digest of role and text and its code points, and a prefix is
the chained digest of its turns.

1. One pass over turns sorted by base writes every prefix of every conversation.
2. Identical conversations collapse to one weighted sequence with its count, its
   least id and the SHA-256 of its sorted ids. Ids are joined in blocks of 65,536
   before they meet, and the digest is fed block by block, so no group is held.
3. Sequences that are proper prefixes of others are dropped by an anti join; the
   others are the leaves.
4. Prefixes of the weighted sequences are aggregated. A node belongs to the
   sequence of its least member. What a sequence owns is a tail of its prefixes,
   so children, leaves and distinct texts below a node are sums over sequences
   and no subtree is ever walked.

The rows of one base's hundred conversations are streamed by one task; memory
holds the base's first five turns and one batch, whatever their lengths. Parents
with many children are copied over salts before they are looked up.

Null roles and texts are empty. Rows without a conversation id take no part; repeated rows
are repeated turns. An empty table has no nodes. Other columns are ignored.
c % 100 has the sign of c.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames

_ROOT = hashlib.md5(b"").digest()
_SHARED = 100                    # conversations of one base
_MOST_SHARED = 6                 # h is less than this
_IDS = 16                        # ids that agree above these bits are joined in one block
_HOT, _SALTS = 1_024, 64         # children from which a parent is copied, and its copies
_BATCH = 8_192
_PREFIX = "conv_id bigint, depth int, k1 bigint, k2 bigint, u1 bigint, u2 bigint, n bigint, upto bigint, last boolean"
_SEQUENCE = "k1 bigint, k2 bigint, weight bigint, conv_id bigint, ends_sha256 string"


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    prefixes = frames.stored(_prefixes(conversations))
    sequences = frames.stored(_sequences(prefixes))
    trie = frames.stored(_first_nodes(prefixes.join(sequences.select("conv_id"), "conv_id", "left_semi")))
    leaves = sequences.join(trie.where("goes_on").select("k1", "k2"), ["k1", "k2"], "left_anti").select("conv_id", F.lit(1).alias("leaf"))
    ends = prefixes.where("last").select("conv_id", F.col("depth").alias("length"), F.col("upto").alias("total"))
    weighted = (sequences.select("conv_id", "weight").join(ends, "conv_id")
                .join(leaves, "conv_id", "left").join(_tops(trie), "conv_id", "left"))
    return _aggregated(prefixes.join(weighted, "conv_id"), sequences)


def _prefixes(conversations: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation, the root included: key, parent's key, code points of its last turn and of all turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(" "), role, text))).alias("digest"),
        F.char_length(text).cast("bigint").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % _SHARED
    ordered = (turns.withColumn("base", base).repartition("base")
               .sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "n", "digest"))
    return ordered.select("base", "conv_id", "digest", "n").mapInArrow(_rebuilt, _PREFIX)


class _Rows:
    """Prefix rows to hand on, and the conversation being built."""

    def __init__(self) -> None:
        self.columns: list[list] = [[] for _ in range(9)]

    def begin(self, conv: int) -> None:
        self.conv, self.depth, self.key, self.total = conv, 0, _ROOT, 0
        self.hold = (conv, 0, *struct.unpack("<qq", _ROOT), None, None, 0, 0)

    def add(self, digest: bytes, n: int) -> None:
        self._put(False)
        up, self.key = self.key, hashlib.md5(self.key + digest).digest()
        self.depth, self.total = self.depth + 1, self.total + n
        self.hold = (self.conv, self.depth, *struct.unpack("<qq", self.key), *struct.unpack("<qq", up), n, self.total)

    def end(self) -> None:
        self._put(True)

    def _put(self, last: bool) -> None:
        for column, value in zip(self.columns, (*self.hold, last), strict=True):
            column.append(value)

    def taken(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.bool_())
        names = ("conv_id", "depth", "k1", "k2", "u1", "u2", "n", "upto", "last")
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(self.columns, kinds, strict=True)], names=list(names))
        self.columns = [[] for _ in range(9)]
        return batch


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, conv, base, first, skip, seen = _Rows(), None, None, [], 0, 0
    for batch in batches:
        for own_base, c, digest, n in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if c != conv:
                if conv is not None:
                    rows.end()
                if own_base != base:
                    base, first = own_base, []
                conv, seen = c, 0
                skip = 0 if c == base else zlib.crc32(str(c).encode()) % _MOST_SHARED
                rows.begin(c)
                for turn in first[:skip]:
                    rows.add(*turn)
            if c == base and len(first) < _MOST_SHARED:
                first.append((digest, n))
            seen += 1
            if seen > skip:
                rows.add(digest, n)
            if len(rows.columns[0]) >= _BATCH:
                yield rows.taken()
    if conv is not None:
        rows.end()
        yield rows.taken()


def _sequences(prefixes: DataFrame) -> DataFrame:
    """(k1, k2, weight, conv_id, ends_sha256): identical conversations as one, with the digest of all their ids."""
    blocks = (prefixes.where("last").groupBy("k1", "k2", F.shiftright("conv_id", _IDS).alias("block"))
              .agg(F.count(F.lit(1)).alias("weight"), F.min("conv_id").alias("conv_id"),
                   F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids")))
    return (blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "block")
            .select("k1", "k2", "weight", "conv_id", "ids").mapInArrow(_hashed, _SEQUENCE))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list) -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 4, pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                          names=["k1", "k2", "weight", "conv_id", "ends_sha256"])

    done, key, weight, least, sha = [], None, 0, 0, None
    for batch in batches:
        for k1, k2, count, conv, ids in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            if (k1, k2) != key:
                if sha is not None:
                    done.append((*key, weight, least, sha.hexdigest()))
                key, weight, least, sha = (k1, k2), count, conv, hashlib.sha256(ids.encode())
            else:
                weight += count
                sha.update(b"," + ids.encode())
        if len(done) >= _BATCH:
            yield made(done)
            done = []
    if sha is not None:
        done.append((*key, weight, least, sha.hexdigest()))
        yield made(done)


def _first_nodes(prefixes: DataFrame) -> DataFrame:
    """(k1, k2, conv_id, depth, u1, u2, before, goes_on): every node with its least member."""
    return prefixes.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("u1").alias("u1"), F.min("u2").alias("u2"),
        F.min(F.col("upto") - F.col("n")).alias("before"), F.max(~F.col("last")).alias("goes_on"))


def _tops(trie: DataFrame) -> DataFrame:
    """(conv_id, top, before, parent_conv_id): the highest node that each sequence owns, and the owner of the node above."""
    tops = (trie.groupBy("conv_id").agg(F.min(F.struct("depth", "before", "u1", "u2")).alias("t"))
            .select("conv_id", F.col("t.depth").alias("top"), F.col("t.before").alias("before"), F.col("t.u1").alias("k1"), F.col("t.u2").alias("k2")))
    asked = tops.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("asks"))
    owners = trie.select("k1", "k2", F.col("conv_id").alias("parent_conv_id")).join(asked, ["k1", "k2"])
    salt = F.pmod(F.xxhash64("conv_id"), F.lit(_SALTS)).cast("int")
    hot = owners.where(F.col("asks") >= _HOT).select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))).alias("salt"), F.col("parent_conv_id").alias("hot_parent"))
    found = tops.withColumn("salt", salt).join(hot, ["k1", "k2", "salt"], "left")
    rest = (found.where("hot_parent IS NULL").drop("hot_parent", "salt")
            .join(owners.where(F.col("asks") < _HOT).drop("asks"), ["k1", "k2"], "left"))
    names = ("conv_id", "top", "before", "parent_conv_id")
    return rest.select(*names).unionByName(found.where("hot_parent IS NOT NULL").withColumnRenamed("hot_parent", "parent_conv_id").select(*names))


def _total(e: Column) -> Column:
    return F.sum(e).cast("bigint")


def _aggregated(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    depth, top = F.col("depth"), F.col("top")
    texts = F.col("total") - F.when(depth >= top, F.col("upto") - F.col("n")).otherwise(F.col("before"))
    below = F.when(top.isNotNull(), texts).otherwise(0)          # code points of the distinct nodes below that the sequence owns
    above = F.when(depth > top, F.col("conv_id")).when(depth == top, F.col("parent_conv_id"))
    child = (depth < F.col("length")) & (depth + 1 >= top)
    grown = rows.groupBy("k1", "k2").agg(
        F.min("conv_id").alias("conv_id"), F.min(depth).cast("bigint").alias("depth"), F.max(above).alias("parent_conv_id"), _total(F.col("weight")).alias("n_convs"),
        _total(F.when(child, 1).otherwise(0)).alias("n_children"), _total(F.coalesce("leaf", F.lit(0))).alias("n_leaves"),
        _total(F.col("weight") * (F.col("total") - F.col("upto") + F.col("n")) - below).alias("saved_tokens"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (grown.join(sequences.select("k1", "k2", "ends_sha256"), ["k1", "k2"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", nothing).alias("ends_sha256")))


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS i,
             {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(x ORDER BY i) AS a FROM t GROUP BY 1),
h AS (SELECT conv_id, a, conv_id - conv_id % 100 AS base,
             xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii((conv_id::VARCHAR)[i])::BIGINT),
                             lambda p, q: list_reduce([xor(p, q), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM l),
r AS (SELECT h.conv_id, coalesce(b.a[1:h.h], []) || h.a[h.h + 1:] AS s FROM h LEFT JOIN l b ON b.conv_id = h.base),
p AS (SELECT conv_id, unnest(range(0, len(s) + 1)) AS d, s FROM r),
n AS (SELECT CASE WHEN d = 0 THEN [] ELSE s[1:d] END AS k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '') AS ends FROM p GROUP BY 1),
m AS (SELECT *, CASE WHEN depth > 1 THEN k[1:depth - 1] WHEN depth = 1 THEN [] END AS up,
             CASE WHEN depth > 0 THEN (n_convs - 1) * length(k[depth].t) ELSE 0 END AS own FROM n),
c AS (SELECT up, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY 1),
f AS (SELECT m.*, coalesce(c.n_children, 0) AS n_children FROM m LEFT JOIN c ON c.up = m.k),
g AS (SELECT CASE WHEN d = 0 THEN [] ELSE k[1:d] END AS k, own, n_children FROM (SELECT unnest(range(0, depth + 1)) AS d, * FROM f)),
s AS (SELECT k, sum(own)::BIGINT AS saved_tokens, (count(*) FILTER (n_children = 0))::BIGINT AS n_leaves FROM g GROUP BY 1)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN s ON s.k = f.k LEFT JOIN f u ON u.k = f.up AND f.depth > 0
"""
