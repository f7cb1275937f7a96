"""Hierarchical residual best-fit packing of token pieces into sequences.

Pieces of full length are sequences of their own. The rest is dealt by a hash, so
that each partition has the whole mix of lengths however the table is ordered.
Each partition packs best-fit, longest first, and emits the bins that are nearly
full; a bin that is not becomes an item of the next round, on an eighth of the
partitions, until one partition is left. Best fit leaves one bin at most half full
in a partition and no two others can merge, so later rounds save one bin a
partition at most, by way of the bins with the most room: as many as there were
partitions, or `_PASSED` if that is more, are passed on and lose nothing; the
others are emitted as they are. A round writes where each item
lies in its bin, and the places of pieces are these offsets added up.

Null counts as an empty text. Only a text longer than a sequence is cut. Equal
rows are separate documents.
"""

from __future__ import annotations

import os
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames
from tidelint.llm.wordhash import word_digests, word_spans

CAPACITY = 2048
_FAN = 8
_PASSED = 8_000
_REMEMBERED, _LONGEST = 800_000, 48
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of texts by a tokenizer that drops white space, so that words are encoded apart and remembered."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, an id 0 at its end."""
        ids, at = self.encoded_rows(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
        return [ids[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encoded_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after another, an id 0 at the end of each, and where each row begins.

        A part of words is looked up once a batch; equal ones are found by their 64-bit digests.
        """
        starts, ends, firsts = word_spans(data, offsets)
        data, starts, ends, firsts = _parts(data, starts, ends, firsts)
        _, where, which = np.unique(word_digests(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = self._ids([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        flat = np.frombuffer(b"".join(found), "<u4")
        per = sizes[which]                                          # tokens of each part of the batch
        upto = np.concatenate(([0], np.cumsum(per)))
        place = np.repeat((np.cumsum(sizes) - sizes)[which] - upto[:-1], per) + np.arange(upto[-1])
        rows = len(offsets) - 1
        at = upto[firsts] + np.arange(rows + 1)
        out = np.zeros(int(at[-1]), "<u4")
        out[np.arange(upto[-1]) + np.repeat(np.arange(rows), np.diff(upto[firsts]))] = flat[place]
        return out, at

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts of words."""
        known = self.known
        found = list(map(known.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        coded = self.tokenizer.encode_batch_fast([parts[i].decode() for i in new], add_special_tokens=False)
        room = _REMEMBERED - len(known)
        for i, c in zip(new, coded, strict=True):
            ids = found[i] = _bytes(c.ids)
            if room > 0 and len(parts[i]) <= _LONGEST:
                known[parts[i]] = ids
                room -= 1
        return found


def _bytes(ids: list[int]) -> bytes:
    own = array("I", ids)
    if sys.byteorder == "big":
        own.byteswap()
    return own.tobytes()


_SIGN, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_SIGN[list(b".,;:!?%&*#$|-/\\\"()[]{}<>=+_@^~")] = True
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, parts of words that the tokenizer keeps apart, and the first part of each row.

    The parts of a word are what ends in a letter and the signs after it. A word
    with `<|` may hold a special token and is left whole, in its own case.
    """
    if not len(starts):
        return data, starts, ends, firsts
    low = _LOWER[data]
    cut = np.maximum.accumulate(np.where(_SIGN[low], -1, np.arange(len(low))))[ends - 1] + 1
    split = (cut > starts) & (cut < ends)
    split[split] &= _after_letter(low, cut[split])
    special = np.searchsorted(starts, np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|"))), "right") - 1
    for word in np.unique(special).tolist():
        low[starts[word]:ends[word]] = data[starts[word]:ends[word]]
        split[word] = False
    begin = np.concatenate(([0], np.cumsum(1 + split)))             # the first part of each word
    low_ends, tails = ends.copy(), begin[1:][split] - 1
    low_ends[split] = cut[split]
    own_starts, own_ends = np.empty(begin[-1], np.int64), np.empty(begin[-1], np.int64)
    own_starts[begin[:-1]], own_ends[begin[:-1]] = starts, low_ends
    own_starts[tails], own_ends[tails] = cut[split], ends[split]
    return low, own_starts, own_ends, begin[firsts]


def _after_letter(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which places of UTF-8 bytes come after a letter: a to z, or one that is not ASCII and ends in a letter in lower case (a dotted capital I does not)."""
    out = _LETTER[data[at - 1]]
    wide = np.flatnonzero(data[at - 1] > 127)
    if len(wide):
        last = data[np.maximum(at[wide, None] - np.arange(4, 0, -1), 0)]        # the last four bytes, that of the least place first
        lead = 3 - np.argmax((last[:, ::-1] & 0xC0) != 0x80, 1)
        last[np.arange(4) < lead[:, None]] = 0
        chars, which = np.unique(last.view(">u4")[:, 0], return_inverse=True)
        letter = np.array([int(c).to_bytes(4, "big").lstrip(b"\0").decode().lower()[-1:].isalpha() for c in chars], bool)
        out[wide] = letter[which]
    return out


def encoder(path: str) -> WordEncoder:
    """The encoder of a file, one in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Per piece of at most `capacity` tokens: doc_id, piece, start, length, ids_crc32 and, if kept, ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path or tokenizer_path())
        for batch in batches:
            data, offsets = frames.binary_text(batch.column(1))
            for low, high in frames.slices(offsets, 4 << 20):
                tokens, at = own.encoded_rows(data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low])
                rows = []
                for row, (first, last) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    for start in range(0, last - first, capacity):
                        own_ids = tokens[first + start:min(first + start + capacity, last)]
                        rows.append((low + row, start // capacity, start, len(own_ids), zlib.crc32(own_ids), own_ids))
                row, piece, start, length, crc, ids = zip(*rows, strict=True)
                out = {"doc_id": batch.column(0).take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()),
                       "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
                if keep_ids:
                    out["ids"] = pa.array([i.view("<i4") for i in ids], pa.list_(pa.int32()))
                yield pa.record_batch(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and the bins' fill: longest first, each into the fullest bin that takes it."""
    at, offset, fill = [0] * len(sizes), [0] * len(sizes), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]   # open bins by what they still take
    some = 0                                                    # bit r: room[r] is not empty
    for item in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
        size = sizes[item]
        fits = some >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            own = room[left].pop()
            if not room[left]:
                some &= ~(1 << left)
        else:
            left, own = capacity, len(fill)
            fill.append(0)
        at[item], offset[item] = own, fill[own]
        fill[own] += size
        left -= size
        room[left].append(own)
        some |= 1 << left
    return at, offset, fill


def _round(capacity: int, number: int, slack: int, passed_on: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        items = np.concatenate([b.column(0).to_numpy() for b in table]) if table else np.zeros(0, np.int64)
        sizes = np.concatenate([b.column(1).to_numpy() for b in table]).tolist() if table else []
        at, offset, fill = best_fit(sizes, capacity)
        first = (number + 1 << 58) | (TaskContext.get().partitionId() << 32)
        full = np.asarray(fill, np.int64)
        underfull = np.flatnonzero(full < capacity - slack)
        passed = underfull[np.argsort(full[underfull], kind="stable")][:passed_on]
        n, m = len(items), len(passed)
        yield pa.record_batch({"item": pa.array(items, pa.int64()), "bin": pa.array(np.asarray(at, np.int64) + first, pa.int64()),
                               "place": pa.array(np.asarray(offset, np.int64)), "size": pa.array(sizes, pa.int64()), "open": pa.array([False] * n, pa.bool_())})
        yield pa.record_batch({"item": pa.array(passed + first, pa.int64()), "bin": pa.array(passed + first, pa.int64()),
                               "place": pa.array(np.zeros(m, np.int64)), "size": pa.array(full[passed]), "open": pa.array([True] * m, pa.bool_())})
    return run


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """`pieces` with `sequence_id` and the `offset` in that sequence, gapless from 0."""
    cut = frames.stored(pieces(docs, path, capacity, keep_ids).withColumn("item", F.monotonically_increasing_id()))
    parts, rounds = cut.rdd.getNumPartitions(), []
    items = cut.where(F.col("length") < capacity).select("item", F.col("length").alias("size")).repartition(parts, "item")
    most = max(_PASSED, parts + 1)
    while True:
        number, last = len(rounds), parts <= 1
        done = frames.stored(items.mapInArrow(_round(capacity, number, capacity // 256, 0 if last else most),
                                              "item bigint, bin bigint, place bigint, size bigint, open boolean"))
        rounds.append(done.where("not open").select("item", "bin", "place"))
        if last:
            break
        parts = -(-parts // _FAN)
        items = done.where("open").select("item", "size").repartition(parts, "item")
    places = None
    for own in reversed(rounds):
        if places is None:
            places = own.select("item", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
        else:
            above = places.select(F.col("item").alias("bin"), "sequence_id", F.col("offset").alias("base"))
            places = (own.join(above, "bin", "left")
                      .select("item", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset")))
    return (cut.join(places, "item", "left")
            .withColumn("sequence_id", F.coalesce("sequence_id", "item")).withColumn("offset", F.coalesce("offset", F.lit(0)))
            .drop("item"))


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the token ids of each packed sequence, at most `capacity`."""
    own = packed(docs, path, capacity, keep_ids=True)
    return (own.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("own"))
            .select("sequence_id", F.flatten(F.transform("own", lambda x: x.ids)).alias("ids")))
