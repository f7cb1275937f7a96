"""Ranked lexical search: summed accumulators of short lists inside document-at-a-time skipping over long ones.

Terms are the maximal runs of ASCII letters, digits and non-ASCII characters of
the whole text, with A-Z lower-cased.

1. Each task turns its documents into inverted lists, block by block, of those
   terms that an item may hold: a bitmap of 2^18 term hashes says which. Lists,
   document lengths and the totals N and L are stored; texts are read once.
2. df is summed over the lists, and weights are joined to the items' terms.
3. Lists are dealt to cells of about 8,192 listed documents and items to packs of
   256; every cell meets every pack. In a cell the lists of an item that hold at
   most an eighth of the cell's documents are summed term by term into one array of
   accumulators. That array is then one more bounded list: documents are gone through
   in windows of 64, a window's bound is its largest accumulator plus the largest
   contribution of each long list in it, windows are taken by falling bound, and
   those below the k-th score so far are skipped. Nothing else is left out,
   so a cell's k best are exact; they meet in one ranking per item.

Each row of the items is ranked on its own, also where ids repeat. Each row of
the documents is a document; equal scores go to the smaller id, rows without an
id come last. Null and empty texts hold no term: such documents count nowhere,
such items return nothing. Empty tables give no rows. Other columns are ignored.
Texts are cut into terms a megabyte at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelint.llm import frames

_TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")          # on UTF-8, where bytes from 0x80 belong to non-ASCII characters
_STEP = 1 << 20
_BITS = 1 << 18
_DOCS, _POSTINGS, _ITEMS = 8_192, 4_000_000, 256
_SHORT = 8                                             # lists of at most a cell's documents / _SHORT are summed first
_WINDOW = 64
_NO_ID = 2**63 - 1
_KNOWN = 1 << 20
_INDEX = "part int, seq int, term binary, df bigint, n_docs bigint, n_terms bigint, docs binary, numbers binary"
_FOUND = "q bigint, item_id bigint, doc_id bigint, score bigint"


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents with a score above 0 of each row of `items`."""
    asked = frames.stored(items.select(F.col(item_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(_asked, "q bigint, item_id bigint, term binary, times bigint"))
    bits = np.zeros(_BITS, bool)
    bits[[row[0] for row in asked.select(F.crc32("term") % _BITS).distinct().collect()]] = True
    index = frames.stored(docs.select(F.col(doc_id).cast("bigint"), F.col(text).cast("string")).mapInArrow(_indexed(np.packbits(bits).tobytes()), _INDEX))
    totals = index.agg(F.sum("n_docs"), F.sum("n_terms"), F.sum(F.when(F.col("term").isNull(), F.col("df"))), F.sum(F.when(F.col("term").isNotNull(), F.col("df")))).first()
    n, length, listed, postings = (x or 0 for x in totals)
    cells = max(1, -(-listed // _DOCS), -(-postings // _POSTINGS))
    groups = max(1, -(-asked.select("q").distinct().count() // _ITEMS))
    held = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n)) + 2) / (2 * F.col("df") + 1))).cast("bigint")
    packs = (asked.join(held, "term").withColumn("weight", weight * F.col("times")).where("weight > 0")
             .groupBy(F.pmod(F.xxhash64("q"), F.lit(groups)).cast("int").alias("j"))
             .agg(F.collect_list(F.struct("q", "item_id", "term", "weight")).alias("asked"))
             .select(F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("i"), "j", "asked"))
    lists = index.select(F.pmod(F.xxhash64("part", "seq"), F.lit(cells)).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("j"),
                         "part", "seq", "term", "docs", "numbers")
    found = lists.groupBy("i", "j").cogroup(packs.groupBy("i", "j")).applyInArrow(_searched(k, n, length), _FOUND)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("item_id", "rank", "doc_id", "score"))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, in order, a megabyte at a time."""
    if len(text) <= _STEP:
        yield _TERM.findall(text.lower())
        return
    at = 0
    while at < len(text):
        end = at + _STEP
        if end < len(text) and (cut := _TERM.match(text, end)) and _TERM.match(text, end - 1):
            end = cut.end()
        yield _TERM.findall(text[at:end].lower())
        at = end


def _counted(batch: pa.RecordBatch) -> Iterator[tuple[int | None, Counter]]:
    data, offsets = frames.binary_text(batch.column(1))
    raw = data.tobytes()
    for row, own in enumerate(batch.column(0).to_pylist()):
        counts: Counter = Counter()
        for some in terms(raw[offsets[row]:offsets[row + 1]]):
            counts.update(some)
        yield own, counts


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    q = TaskContext.get().partitionId() << 40
    for batch in batches:
        rows = []
        for own, counts in _counted(batch):
            rows += [(q, own, term, times) for term, times in counts.items()]
            q += 1
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], names=["q", "item_id", "term", "times"])


def _indexed(bits: bytes) -> Callable:
    """Inverted lists of a task's documents. The row without a term holds a block's ids and lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool).tolist()
        known: dict[bytes, bool] = {}
        part, seq = TaskContext.get().partitionId(), 0
        n_docs = n_terms = size = 0
        ids, lengths, lists = [], [], {}

        def block() -> pa.RecordBatch:
            rows = [(part, seq, None, len(ids), n_docs, n_terms, np.array(ids, np.int64).tobytes(), np.array(lengths, np.int64).tobytes())]
            rows += [(part, seq, term, len(own) // 2, 0, 0, np.array(own[::2], np.int32).tobytes(), np.array(own[1::2], np.int64).tobytes()) for term, own in lists.items()]
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names=["part", "seq", "term", "df", "n_docs", "n_terms", "docs", "numbers"])

        for batch in batches:
            for own, counts in _counted(batch):
                if not counts:
                    continue
                total = counts.total()
                n_docs, n_terms = n_docs + 1, n_terms + total
                at, some = len(ids), False
                for term, times in counts.items():
                    keep = known.get(term)
                    if keep is None:
                        if len(known) >= _KNOWN:
                            known.clear()
                        keep = known[term] = wanted[zlib.crc32(term) % _BITS]
                    if keep:
                        some = True
                        size += 1
                        if term in lists:
                            lists[term] += (at, times)
                        else:
                            lists[term] = [at, times]
                if some:
                    ids.append(_NO_ID if own is None else own)
                    lengths.append(total)
                if len(ids) >= _DOCS or size >= _POSTINGS:
                    yield block()
                    seq, n_docs, n_terms, size, ids, lengths, lists = seq + 1, 0, 0, 0, [], [], {}
        if n_docs:
            yield block()
    return run


class Cell:
    """Inverted lists over the documents of one cell."""

    def __init__(self, rows: pa.Table, n: int, length: int) -> None:
        first, ids, lengths, own = {}, [], [], []
        for part, seq, term, docs, numbers in zip(*(rows.column(c).to_pylist() for c in ("part", "seq", "term", "docs", "numbers")), strict=True):
            if term is None:
                first[part, seq] = sum(map(len, ids))
                ids.append(np.frombuffer(docs, np.int64))
                lengths.append(np.frombuffer(numbers, np.int64))
            else:
                own.append((part, seq, term, docs, numbers))
        self.ids = np.concatenate(ids)
        words = np.concatenate(lengths)
        if len(words) and 25 * int(words.max()) * n >= 2**63:
            m = np.array([75 + 25 * int(x) * n // length for x in words], np.int64)
        else:
            m = 75 + 25 * words * n // max(1, length)
        lists: dict[bytes, list] = {}
        for part, seq, term, docs, numbers in own:
            lists.setdefault(term, []).append((np.frombuffer(docs, np.int32) + first[part, seq], np.frombuffer(numbers, np.int64)))
        self.lists: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for term, some in lists.items():
            docs, times = (np.concatenate(x) for x in zip(*some, strict=True))
            self.lists[term] = docs, 1_000_000_000 * times // (1000 * times + 12 * m[docs])
        self.windows = -(-len(self.ids) // _WINDOW)
        self.long: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}

    def _spread(self, term: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A long list by document, as windows, and the largest of each window."""
        if term not in self.long:
            docs, gain = self.lists[term]
            row = np.zeros(self.windows * _WINDOW, np.int64)
            row[docs] = gain
            row = row.reshape(self.windows, _WINDOW)
            self.long[term] = row, row.max(1)
        return self.long[term]

    def best(self, weights: dict[bytes, int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents with a score above 0."""
        summed = np.zeros(self.windows * _WINDOW, np.int64)
        long = []
        for term, weight in weights.items():
            if term in self.lists:
                docs, gain = self.lists[term]
                if len(docs) * _SHORT <= len(self.ids):
                    summed[docs] += weight * gain
                else:
                    long.append((weight, *self._spread(term)))
        summed = summed.reshape(self.windows, _WINDOW)
        bound = summed.max(1)
        for weight, _, top in long:
            bound = bound + weight * top
        order = np.argsort(-bound, kind="stable")
        order = order[:np.count_nonzero(bound)]
        rows, scores, least, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 1, 0, max(4, k // 8)
        while at < len(order) and bound[order[at]] >= least:
            some = order[at:at + step]
            some = some[bound[some] >= least]
            score = summed[some]
            for weight, row, _ in long:
                score = score + weight * row[some]
            score = score.ravel()
            keep = np.flatnonzero(score >= least)
            rows = np.concatenate([rows, (some[:, None] * _WINDOW + np.arange(_WINDOW)).ravel()[keep]])
            scores = np.concatenate([scores, score[keep]])
            if len(scores) > k:
                least = max(least, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
                keep = scores >= least
                rows, scores = rows[keep], scores[keep]
            at, step = at + step, step * 2
        order = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][order], scores[order]


def _searched(k: int, n: int, length: int) -> Callable:
    def run(lists: pa.Table, packs: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if lists.num_rows and packs.num_rows:
            cell, asked = Cell(lists, n, length), {}
            for pack in packs.column("asked").to_pylist():
                for x in pack:
                    asked.setdefault((x["q"], x["item_id"]), {})[x["term"]] = x["weight"]
            for (q, item), weights in asked.items() if len(cell.ids) else ():
                ids, scores = cell.best(weights, k)
                out += [(q, item, None if i == _NO_ID else i, s) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["q", "item_id", "doc_id", "score"])
    return run


SQL = r"""
WITH dt AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM documents),
qt AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS a FROM benchmark),
qs AS (SELECT q, item_id, t, count(*) AS times FROM (SELECT q, item_id, unnest(a) AS t FROM qt) GROUP BY ALL),
s AS (SELECT count(*)::BIGINT AS n, sum(len(a))::BIGINT AS l FROM dt WHERE len(a) > 0),
p AS (SELECT d, doc_id, t, count(*) AS tf, any_value(n) AS n FROM (SELECT d, doc_id, len(a) AS n, unnest(a) AS t FROM dt) WHERE t IN (SELECT t FROM qs) GROUP BY d, doc_id, t),
w AS (SELECT t, floor(1000 * ln((2 * (SELECT n FROM s)::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM p GROUP BY t),
r AS (SELECT q, item_id, d, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * p.n * s.n) // s.l))))::BIGINT AS score
      FROM qs JOIN w USING (t) JOIN p USING (t) CROSS JOIN s GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM r WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""
