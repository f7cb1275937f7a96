"""Near duplicates by Order MinHash and banded alignment.

Each distinct text is cut into k-mers of five and of two words, labelled by their
occurrence number. A sketch takes the two least k-mers under its own hash and
keeps them in text order, so it agrees with a probability that follows edit
similarity rather than set overlap. Texts that share one of 16 sketches of five
words or of 32 of two, which find short and scattered edits, are candidates; a text
that repeats five-word k-mers is sketched once more without the repeats, so it
meets texts with the same shingles. A pair is a link when a banded alignment matches at least 0.8 of the
words of the longer text, or when 0.8 of their five-word shingles are shared
(which holds for texts whose passages changed places). Classes are the
connected components of the links and of equal texts.

No group is held whole: equal texts meet in a partial aggregate; a sketch shared
by up to eight texts gives their pairs, a larger one at first the pairs with the text
that shares most sketches and, for texts whose largest sketches it is one of, pairs
inside random sub-groups of about four. Texts of a larger one that these links leave in different
classes are then all compared, in blocks: a block of many pairs gets the texts and hands out links
only, one at most for two classes. A bound from counts of hashed words and shingles, which no link exceeds, spares
most pairs the alignment, and a text that is too far from one of a class, by a metric, is too far
from those near it. In the first pass one text is aligned with at most about 64 others in a task.

Null counts as an empty text; texts without words are duplicates of the equal
texts only. Texts of at most k words have one k-mer. Ties of the least
document id go to the least digest; rows equal in id and text count as copies.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelint.llm import frames
from tidelint.llm.wordhash import mixed, window_digests, word_digests, word_spans

WORDS = 5
SKETCHES = {WORDS: 16, 2: 32}      # how many, by the words of a k-mer
SIMILARITY = 0.8
_WHOLE = 8          # texts of a sketch that are paired without sub-groups
_SUBGROUP = 4       # mean size of a sub-group of a larger one
_GROUPED = 4        # larger sketches, the largest, in which a text is put into a sub-group
_BLOCK = 1024       # texts on each side of a block of the comparison across classes, at most about
_BLOCK_WORDS = 1 << 19      # words there, at most about
_LEADS = 4          # texts of a class there by which others are ruled out,
_CROWD = 16         # and from how many that one text may link with
_BINS = 256         # counts of hashed words and of hashed shingles, by which a pair is ruled out
_PARTNERS = 64      # texts compared with one text in a task
_SEEDS = np.random.Generator(np.random.PCG64(7_081_971)).integers(1, 2**63, (2, sum(SKETCHES.values())), dtype=np.uint64)


def classes(docs: DataFrame) -> DataFrame:
    """Per row of `docs`: doc_id, class_id (least doc_id of the class), class_docs, class_texts, links and kept.

    `links` is how many links the row's text was given; `kept` marks one row of
    each class: that of the least document id.
    """
    nodes, stats, labels = _solved(docs)
    rows = docs.select("doc_id", _node("text").alias("node"))
    degree = labels["degree"]
    return (rows.join(labels["roots"], "node", "left").join(degree, "node", "left")
            .withColumn("root", F.coalesce("root", "node")).join(stats, "root")
            .select("doc_id", F.nullif("first_id", F.lit(_LAST)).alias("class_id"), "class_docs", "class_texts",
                    F.coalesce("links", F.lit(0)).alias("links"),
                    ((F.col("node") == F.col("keeper")) & (F.coalesce("doc_id", F.lit(_LAST)) == F.col("first_id"))).alias("kept")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each class, that of its least document id."""
    nodes, stats, _ = _solved(docs)
    inner = [f"in_{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    rows = (docs.toDF(*inner).withColumn("node", _node(at["text"]))
            .withColumn("own_id", F.coalesce(at["doc_id"], F.lit(_LAST))).dropDuplicates(["node", "own_id"]))
    keepers = stats.select(F.col("keeper").alias("node"), F.col("first_id").alias("own_id"))
    return rows.join(keepers, ["node", "own_id"], "left_semi").select(*(F.col(i).alias(c) for c, i in at.items()))


_LAST = 2**63 - 1


def _node(text: str) -> F.Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _solved(docs: DataFrame) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """Distinct texts, what is known of each class, and the labels of linked texts."""
    nodes = (docs.select(_node("text").alias("node"), F.coalesce("doc_id", F.lit(_LAST)).alias("id"))
             .groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("copies")))
    links, roots = _connected(docs)
    degree = (links.select(F.col("a").alias("node")).union(links.select("b"))
              .groupBy("node").agg(F.count("*").alias("links")))
    stats = (nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
             .agg(F.min(F.struct("first", "node")).alias("least"), F.sum("copies").alias("class_docs"), F.count("*").alias("class_texts"))
             .select("root", F.col("least.first").alias("first_id"), F.col("least.node").alias("keeper"), "class_docs", "class_texts"))
    return nodes, stats, {"roots": roots, "degree": degree}


def linked(docs: DataFrame) -> DataFrame:
    """(a, b, similarity): digests of two different texts that are near duplicates."""
    return _connected(docs)[0]


def _connected(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links, and the components (node, root) that they make."""
    members = frames.stored(sharing(docs))
    found = frames.stored(candidates(members))
    near = frames.stored(_aligned(docs, found))
    roots = frames.components(near)
    large, rows = frames.stored_counting(_crossed(members, roots))
    if not rows:
        return near, roots
    more, rows = frames.stored_counting(_across(docs, large, found))
    return (near.union(more), frames.joined(roots, more)) if rows else (near, roots)


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of those texts whose digests are among `nodes`."""
    return (docs.withColumn("node", _node("text")).join(nodes.select("node").distinct(), "node", "left_semi")
            .groupBy("node").agg(F.first("text").alias("text")).select("node", "text"))


def _aligned(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, similarity) of those pairs `found` that are links."""
    texts = (docs.select(_node("text").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
             .groupBy("node").agg(F.first("text").alias("text")))
    many = found.groupBy("a").agg(F.ceil(F.count("*") / _PARTNERS).cast("int").alias("parts"))
    dealt = found.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
    heads = (many.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
             .join(texts.withColumnRenamed("node", "a"), "a"))
    tails = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    heads, tails = heads.select("a", "part", "text").toDF("a", "part", "text"), tails.toDF("a", "part", "b", "text")
    return (heads.groupBy("a", "part").cogroup(tails.groupBy("a", "part"))
            .applyInArrow(_verified, "a binary, b binary, similarity double"))


def sharing(docs: DataFrame) -> DataFrame:
    """(sketch, node, n, d, texts): texts that share a sketch, their words and distinct shingles, and how many share it."""
    rows = frames.stored(docs.select("text").mapInArrow(_sketched, "node binary, n int, d int, sketches array<bigint>").dropDuplicates(["node"]))
    rows = rows.select(F.explode(F.array_distinct("sketches")).alias("sketch"), "node", "n", "d")
    shared = rows.groupBy("sketch").agg(F.count("*").alias("texts")).where("texts > 1")
    return rows.join(shared.toDF("sketch", "texts"), "sketch")


def candidates(members: DataFrame) -> DataFrame:
    """(a, b): digests of texts that share a sketch and are close enough in words or in distinct shingles, each pair once; all pairs of small sketches."""
    # The original of many edits shares sketches with more of them than they do among themselves.
    large = (members.where(F.col("texts") > _WHOLE).groupBy("node", "n", "d")
             .agg(F.sort_array(F.collect_list(F.struct("texts", "sketch")), asc=False).alias("sharing"), F.sum("texts").alias("weight"))
             .select("node", "n", "d", "weight", F.posexplode("sharing").alias("nth", "at")).select("at.sketch", "at.texts", "nth", "weight", "node", "n", "d"))
    part = F.pmod(F.xxhash64("node", "sketch"), F.ceil(F.col("texts") / _SUBGROUP).cast("int"))
    grouped = (members.where(F.col("texts") <= _WHOLE).select("sketch", "node", "n", "d", F.lit(0).alias("part"))
               .union(large.where(F.col("nth") < _GROUPED).select("sketch", "node", "n", "d", part)))
    near = (grouped.groupBy("sketch", "part").agg(F.sort_array(F.collect_list(F.struct("node", "n", "d"))).alias("g"))
            .select(F.explode(F.flatten(F.transform("g", lambda x, i: F.transform(
                F.slice("g", i + 2, F.greatest(F.size("g") - i - 1, F.lit(0))), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
            .select("p.x", "p.y"))
    hub = (large.groupBy("sketch").agg(F.max(F.struct("weight", "node", "n", "d")).alias("hub"))
           .select("sketch", F.struct("hub.node", "hub.n", "hub.d").alias("hub")).toDF("sketch", "hub"))
    hubs = large.select("sketch", F.struct("node", "n", "d").alias("own")).join(hub, "sketch").select(F.least("hub", "own").alias("x"), F.greatest("hub", "own").alias("y"))
    pairs = near.union(hubs).where(F.col("x.node") != F.col("y.node"))
    words, shingles = (F.least(f"x.{c}", f"y.{c}") >= SIMILARITY * F.greatest(f"x.{c}", f"y.{c}") for c in ("n", "d"))
    return pairs.where(words | shingles).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _crossed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Texts of each large sketch that holds several classes: its largest class, and the rest, which meets all of them.

    `rare` marks the rest; `blocks` and `rare_blocks` are how many blocks all texts and the rest make.
    """
    members = members.where(F.col("texts") > _WHOLE).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = (members.groupBy("sketch", "root").agg(F.count("*").alias("own"), F.sum("n").alias("words"))
               .groupBy("sketch").agg(F.max(F.struct("own", "root", "words")).alias("most"), F.sum("own").alias("all"), F.sum("words").alias("words"))
               .where("all > most.own"))

    def blocks(texts: F.Column, words: F.Column) -> F.Column:
        return F.ceil(F.greatest(texts / _BLOCK, words / _BLOCK_WORDS)).cast("int")

    return (members.join(several, "sketch")
            .select("sketch", "node", "n", "d", "root", (F.col("root") != F.col("most.root")).alias("rare"), blocks(F.col("all"), F.col("words")).alias("blocks"),
                    blocks(F.col("all") - F.col("most.own"), F.col("words") - F.col("most.words")).alias("rare_blocks")))


def _across(docs: DataFrame, large: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b, similarity): links between classes of a large sketch.

    A block of few pairs hands them out, to be aligned as the `found` ones were; one of
    many gets its texts and hands out links only, one at most for two classes.
    """
    keys, held = ["sketch", "rare_block", "block"], ["node", "n", "d", "root", "rare", "blocks", "counts", "sketches"]
    counts = _texts(docs, large).mapInArrow(_counted, "node binary, counts binary")
    shared = large.groupBy("node").agg(F.sort_array(F.collect_list("sketch")).alias("sketches"))
    rows = frames.stored(large.join(counts.join(shared, "node"), "node"))

    def side(own: str, other: str, df: DataFrame) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64("node", "sketch"), own + "s").cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1))).select(*keys, *held).toDF(*keys, *held)

    # In a sketch of one block, the rest is among all texts.
    rare, every = side("rare_block", "block", rows.where("rare and blocks > 1")), side("block", "rare_block", rows)
    met, crowded = frames.stored_counting(rare.groupBy(*keys).cogroup(every.groupBy(*keys))
                                          .applyInArrow(_possible, "a binary, b binary, sketch long, rare_block int, block int"), "a is null")
    links = _aligned(docs, met.where("a is not null").select("a", "b").join(found, ["a", "b"], "left_anti"))
    if not crowded:
        return links
    where = met.where("a is null").select(*keys)
    rare, every = (x.join(where, keys, "left_semi") for x in (rare, every))
    texts = _texts(docs, every.select("node").union(rare.select("node")))
    rare, every = (x.join(texts, "node").select(*keys, *held, "text").toDF(*keys, *held, "text") for x in (rare, every))
    return links.union(rare.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInArrow(_joining, "a binary, b binary, similarity double"))


def sketches(words: np.ndarray) -> np.ndarray:
    """The order sketches of one text, from its word digests; a text no longer than a k-mer gives one."""
    return _sketches(words)[0]


def _sketches(words: np.ndarray) -> tuple[np.ndarray, int]:
    """The order sketches of one text, and how many distinct shingles it has."""
    out, done, distinct = [], 0, 0
    for k, count in SKETCHES.items():
        grams = window_digests(words, min(k, len(words)))
        order = np.argsort(grams, kind="stable")
        ordered = grams[order]
        runs = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        if k == WORDS:
            distinct = len(runs)
        nth = np.empty(len(grams), np.uint64)
        nth[order] = np.arange(len(grams)) - np.repeat(runs, np.diff(np.append(runs, len(grams))))
        labels = mixed(grams + nth * np.uint64(0xC2B2AE3D27D4EB4F))
        seeds = _SEEDS[:, done:done + count, None]
        for own in (labels, labels[nth == 0]) if k == WORDS and nth.any() else (labels,):
            ranks = (own ^ seeds[0]) * (seeds[1] | np.uint64(1))
            least = ranks.argmin(1)
            ranks[np.arange(count), least] = np.iinfo(np.uint64).max
            second = ranks.argmin(1)
            first, last = own[np.minimum(least, second)], own[np.maximum(least, second)]
            out.append(mixed(first * np.uint64(0x9E3779B97F4A7C15) + mixed(last) + np.arange(done, done + count, dtype=np.uint64)))
        done += count
    return np.concatenate(out), distinct


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = frames.binary_text(batch.column(0))
        for low, high in frames.slices(offsets, 2 << 20):
            part, own = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            starts, ends, firsts = word_spans(part, own)
            digests = word_digests(part, starts, ends)
            raw = part.tobytes()
            sketch, node, n, d = [], [], [], []
            for row in range(high - low):
                words = digests[firsts[row]:firsts[row + 1]]
                if len(words):
                    own_sketches, distinct = _sketches(words)
                    sketch.append(own_sketches)
                    node.append(hashlib.md5(raw[own[row]:own[row + 1]]).digest())
                    n.append(len(words))
                    d.append(distinct)
            if sketch:
                ends = np.cumsum([0, *map(len, sketch)])
                yield pa.record_batch({"node": pa.array(node, pa.binary()), "n": pa.array(n, pa.int32()), "d": pa.array(d, pa.int32()),
                                       "sketches": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sketch).view(np.int64)))})


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words, and how many distinct shingles, of each text fall into each bin."""
    most = np.iinfo(np.uint16).max
    for batch in batches:
        data, offsets = frames.binary_text(batch.column("text"))
        for low, high in frames.slices(offsets, 2 << 20):
            part, own = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
            starts, ends, firsts = word_spans(part, own)
            digests, counts = word_digests(part, starts, ends), []
            for row in range(high - low):
                words = digests[firsts[row]:firsts[row + 1]]
                grams = np.unique(window_digests(words, min(WORDS, len(words))))
                own_counts = np.concatenate([np.bincount((mixed(x) % np.uint64(_BINS)).astype(np.int64), minlength=_BINS) for x in (words, grams)])
                if own_counts.max() > most:                         # too many to tell: nothing is ruled out
                    own_counts[:] = most
                counts.append(own_counts.astype("<u2").tobytes())
            yield pa.record_batch({"node": batch.column("node")[low:high], "counts": pa.array(counts, pa.binary())})


def _sides(rare: pa.Table, every: pa.Table) -> tuple[pa.Table, pa.Table]:
    """A block's texts; those of `rare` are not sent twice where a sketch is one block."""
    return (every.filter(every.column("rare")) if every.num_rows and every.column("blocks")[0].as_py() == 1 else rare), every


def _meeting(rare: pa.Table, every: pa.Table) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
    """Per row of `rare` the rows of `every`, of other classes, whose counts allow a link, and whether those of shingles do.

    A pair is compared in one of the sketches that it shares, chosen by the pair's digests.
    """
    if not rare.num_rows or not every.num_rows:
        return
    sketch = rare.column("sketch")[0].as_py()
    rows = list(zip(*(rare.column(c).to_pylist() for c in ("node", "root", "n", "d", "counts", "sketches")), strict=True))
    nodes, roots, rares = (np.array(every.column(c).to_pylist(), object) for c in ("node", "root", "rare"))
    counts = np.stack([np.frombuffer(x, "<u2") for x in every.column("counts").to_pylist()])
    n, d, once = every.column("n").to_numpy(), every.column("d").to_numpy(), rares.astype(bool)
    heads = np.array([int.from_bytes(x[:8]) for x in nodes.tolist()], np.uint64)
    holding = {x: np.zeros(len(nodes), bool) for *_, held in rows for x in held}
    for i, held in enumerate(every.column("sketches").to_pylist()):
        for x in holding.keys() & held:
            holding[x][i] = True
    for row, (node, root, size, distinct, raw, held) in enumerate(rows):
        other = np.flatnonzero(roots != root)
        other = other[~once[other] | (nodes[other] > node)]
        keys = np.array(held).view(np.uint64)[:, None] ^ (heads[other] ^ np.uint64(int.from_bytes(node[:8])))
        keys[~np.stack([holding[x] for x in held])[:, other]] = np.iinfo(np.uint64).max
        other = other[np.array(held)[keys.argmin(0)] == sketch]
        other = other[(np.minimum(n[other], size) >= SIMILARITY * np.maximum(n[other], size) - 1e-9)
                      | (np.minimum(d[other], distinct) >= SIMILARITY * np.maximum(d[other], distinct) - 1e-9)]
        if len(other):
            both = np.minimum(counts[other], np.frombuffer(raw, "<u2"))
            in_words, in_shingles = both[:, :_BINS].sum(1, dtype=np.int64), both[:, _BINS:].sum(1, dtype=np.int64)
            by_shingles = in_shingles >= SIMILARITY * (d[other] + distinct - in_shingles) - 1e-9
            fits = by_shingles | (in_words >= SIMILARITY * np.maximum(n[other], size) - 1e-9)
            yield row, list(zip(other[fits].tolist(), by_shingles[fits].tolist(), strict=True))


def _possible(rare: pa.Table, every: pa.Table) -> pa.Table:
    """The pairs of a block, or one row without a pair where they are more than its texts."""
    rare, every = _sides(rare, every)
    a, b = [], []
    if rare.num_rows and every.num_rows:
        own, nodes = rare.column("node").to_pylist(), every.column("node").to_pylist()
        for row, near in _meeting(rare, every):
            for i, _ in near:
                a.append(min(own[row], nodes[i]))
                b.append(max(own[row], nodes[i]))
            if len(a) > every.num_rows:
                a, b = [None], [None]
                break
    keys = [rare.column(c)[0].as_py() for c in ("sketch", "rare_block", "block")] if a else [0] * 3
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())}
                    | {c: pa.array([x] * len(a), t) for c, x, t in zip(("sketch", "rare_block", "block"), keys, (pa.int64(), pa.int32(), pa.int32()), strict=True)})


def _joining(rare: pa.Table, every: pa.Table) -> pa.Table:
    """Links between a text of `rare` and one of `every`, of another class: the first that is found for two classes.

    By the words that match in order, len(x) + len(y) - 2 * matched is a metric, so texts near one of
    their class, the lead, are ruled out together where the lead itself is too far away.
    """
    rare, every = _sides(rare, every)
    a, b, s = [], [], []
    if rare.num_rows and every.num_rows:
        rows = list(zip(*(rare.column(c).to_pylist() for c in ("node", "root", "n", "text")), strict=True))
        nodes, roots, n, texts = every.column("node").to_pylist(), every.column("root").to_pylist(), every.column("n").to_pylist(), every.column("text")
        known: dict[int, list[bytes]] = {}
        leads: dict[int, tuple[int, int]] = {}
        of_class: dict[bytes, list[int]] = defaultdict(list)
        above: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        def words(i: int) -> list[bytes]:
            if i not in known:
                known[i] = texts[i].as_py().encode().split()
            return known[i]

        def lead(i: int) -> tuple[int, int]:
            """The text that stands for text `i`, and how far away it is at most."""
            if i not in leads:
                own = Aligner(words(i))
                for p in of_class[roots[i]]:
                    least = _least(n[i], n[p])
                    if (found := own.matched(words(p), least)) >= least:
                        leads[i] = p, n[i] + n[p] - 2 * found
                        break
                else:
                    leads[i] = i, 0
                    if len(of_class[roots[i]]) < _LEADS:
                        of_class[roots[i]].append(i)
            return leads[i]

        for row, near in _meeting(rare, every):
            node, root, size, text = rows[row]
            own, groups = Aligner(text.encode().split()), defaultdict(list)
            for i, by in near:
                groups[-1 if by else lead(i)[0] if len(near) >= _CROWD else i].append(i)
            for p, group in groups.items():
                if p >= 0 and len(group) > 1:
                    least = min(-((n_i - n_p + far) // 2 - _least(n_i, size)) for n_i, n_p, far in ((n[i], n[p], leads[i][1]) for i in group))
                    if own.matched(words(p), least) < least:
                        continue
                for i in group:
                    if top(root) != top(roots[i]):
                        if p < 0:
                            share = own.similar(words(i))
                        else:
                            found, least = own.matched(words(i), _least(n[i], size)), _least(n[i], size)
                            share = found / max(n[i], size) if found >= least else 0.0
                        if share:
                            above[top(root)] = top(roots[i])
                            a.append(min(node, nodes[i]))
                            b.append(max(node, nodes[i]))
                            s.append(share)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(s, pa.float64())})


def _least(n: int, m: int) -> int:
    """Words that texts of `n` and `m` words must match in order to be linked."""
    return -int(-SIMILARITY * max(n, m, 1) // 1)


class Aligner:
    """Longest common subsequence with one text, inside a band around the diagonal, on whole-number bits."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.places = words, None
        self.masks: dict[bytes, int] = {}
        self.wide = len(words) <= 1 << 16
        self.shingles: set | None = None

    def _band(self, word: bytes, low: int, high: int) -> int:
        """Bits of the places of `word` from `low` to `high`."""
        places = self.places.get(word)
        if places is None or high < low:
            return 0
        if self.wide and len(places) > 8:
            mask = self.masks.get(word)
            if mask is None:
                bits = np.zeros(len(self.words), np.uint8)
                bits[places] = 1
                mask = self.masks[word] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            return (mask >> low if low >= 0 else mask << -low) & ((1 << (high - low + 1)) - 1)
        found = 0
        for p in places[bisect_left(places, low):bisect_right(places, high)]:
            found |= 1 << (p - low)
        return found

    def matched(self, other: list[bytes], least: int) -> int:
        """Words matched in order, or -1 once `least` is out of reach.

        Words equal at the same place from one end, and common ends, are the answer
        where they reach `least`. A text may have at most `band` unmatched words, so no alignment
        that is good enough leaves the band.
        """
        a, b = self.words, other
        head, most = 0, min(len(a), len(b))
        if most < least:
            return -1
        for same in (sum(map(eq, a, b)), sum(map(eq, reversed(a), reversed(b)))):
            if same >= least:
                return same
        while head < most and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < most - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        n, m = len(a) - head - tail, len(b) - head - tail
        need = least - head - tail
        if need <= 0:
            return head + tail
        if min(n, m) < need:
            return -1
        if self.places is None:
            self.places = {}
            for i, w in enumerate(a):
                self.places.setdefault(w, []).append(i)
        band = max(n, m) - need
        width = 2 * band + 1
        full = (1 << width) - 1
        row, done = full, 0                 # bit i: the word j - band + i is not yet matched
        for j in range(m):
            low = j - band
            hit = row & self._band(b[head + j], head + low, head + min(j + band, n - 1))
            if low < 0:
                hit = hit >> -low << -low
            row = ((row + hit) | (row - hit)) & full
            done += ~row & 1
            row = (row >> 1) | (1 << (width - 1))
            if not j & 63 and done + (width - row.bit_count()) + m - j - 1 < need:
                return -1
        return head + tail + done + (width - row.bit_count())

    def similar(self, other: list[bytes]) -> float:
        """Matched share of the longer text, or the share of common shingles, where that is at least 0.8; else 0."""
        least = _least(len(self.words), len(other))
        found = self.matched(other, least)
        if found >= least:
            return found / max(len(self.words), len(other), 1)
        if self.shingles is None:
            self.shingles = _shingles(self.words)
        own = _shingles(other)
        if min(len(own), len(self.shingles)) < SIMILARITY * max(len(own), len(self.shingles)):
            return 0.0
        both = len(own & self.shingles)
        share = both / (len(own) + len(self.shingles) - both)
        return share if share >= SIMILARITY else 0.0


def _shingles(words: list[bytes]) -> set:
    return set(zip(*(words[i:] for i in range(WORDS)), strict=False)) if len(words) >= WORDS else {tuple(words)}


def _verified(head: pa.Table, tail: pa.Table) -> pa.Table:
    a, b, s = [], [], []
    if head.num_rows and tail.num_rows:
        own = head.column("a")[0].as_py()
        aligner = Aligner(head.column("text")[0].as_py().encode().split())
        for other, text in zip(tail.column("b"), tail.column("text"), strict=True):
            share = aligner.similar(text.as_py().encode().split())
            if share:
                a.append(own)
                b.append(other.as_py())
                s.append(share)
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "similarity": pa.array(s, pa.float64())})
