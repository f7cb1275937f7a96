"""Each operator on documents with nulls, empty and long texts, ties, repeats, clashing columns and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelint.llm import divergence_rules, frames, license_dice, line_spread, order_minhash, piece_codec, quality_bayes, repeat_blocks, residual_packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}x" for i in range(400)]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.1 else "") for _ in range(n))


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) if r.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def rows():
    base, long = prose(1, 300), prose(2, 6000)
    passage = prose(3, 60)
    texts = [base, base, edited(base, 4, 0.03), edited(base, 5, 0.03), prose(6, 200) + " " + passage, passage + " " + prose(7, 150), None, "", " \n\t ",
             "one", "one two three four five", long, edited(long, 8, 0.01), prose(9, 40) + "\n" + prose(9, 40), prose(10, 80), "ünïcödé 日本語 " * 30, "a " * 90]
    out = [(i, t, ("en", "de", None)[i % 3], f"s{i % 6}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    return out + [out[4], (None, prose(11, 70), "en", "s1", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use inside."""
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in ("chunk", "node", "w", "line", "bucket", "item", "evidence", "n_words", "root", "key", "id", "body", "c0", "in_0")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_repeats_equal_brute_force(docs, empty, rows):
    def brute(n):
        seen = Counter(tuple(w[i:i + n]) for w in (words(r[1]) for r in rows) for i in range(len(w) - n + 1))
        for r in rows:
            w = words(r[1])
            gone = {j for i in range(len(w) - n + 1) if seen[tuple(w[i:i + n])] > 1 for j in range(i, i + n)}
            yield r[0], len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()

    for n in (35, 6, 1):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in repeat_blocks.repeats(docs, n).collect()]
        assert sorted(got, key=str) == sorted(brute(n), key=str)
    kept = repeat_blocks.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert repeat_blocks.repeats(empty).count() == 0


def test_near_duplicates(docs, empty, rows):
    got = {}
    for r in order_minhash.classes(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    group = {i: got[i][0].class_id for i in range(17)}
    assert group[0] == group[1] == group[2] == group[3] == 0 and group[12] == 11
    assert group[6] == group[7] == 6 and group[8] == 8                   # null and empty; white space is another text
    assert all(group[i] == i for i in (4, 5, 9, 10, 14, 15, 16))
    assert got[0][0].class_docs == 4 and got[0][0].class_texts == 3 and got[2][0].links >= 1
    assert sum(r.kept for r in got[4]) == 2                              # the repeated row is marked with its equal
    kept = order_minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == [0, 4, 5, 6, 8, 9, 10, 11, 13, 14, 15, 16] and ids.count(None) == 1
    assert order_minhash.classes(empty).count() == 0 and order_minhash.deduplicated(empty).count() == 0


def test_alignment_equals_plain_lcs():
    r = random.Random(3)
    for _ in range(300):
        a = [b"%d" % r.randrange(20) for _ in range(r.randint(1, 50))]
        b = [w for w in a if r.random() > 0.15] or [b"x"]
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        least = -(-8 * max(len(a), len(b)) // 10)
        assert (order_minhash.Aligner(a).matched(b, least) >= least) == (table[-1, -1] >= least)


def test_edited_pairs_share_a_sketch():
    """Pairs at the limit of a link, 0.8 of the words equal, in short and long texts."""
    r = np.random.default_rng(8)
    for n in (20, 60, 200):
        met = 0
        for _ in range(400):
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            b = a.copy()
            b[r.choice(n, n // 5, replace=False)] = r.integers(0, 2**63, n // 5, dtype=np.uint64)
            met += bool(set(order_minhash.sketches(a).tolist()) & set(order_minhash.sketches(b).tolist()))
        assert met >= 0.97 * 400, (n, met)


def test_repeated_text_is_near_its_shingles(spark):
    """A text printed twice, or with its first part over and over, has the shingles of the text."""
    texts = [prose(50, 150), prose(51, 150), prose(52, 150)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(10, texts[0] + " " + texts[0], "en", "s", 0), (11, " ".join(texts[1].split()[:20] + [""]) * 30 + texts[1], "en", "s", 0)]
    got = {r.doc_id: r.class_id for r in order_minhash.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 10: 0, 1: 1, 11: 1, 2: 2}


def test_large_group_stays_one_class(spark):
    base = prose(20, 120)
    group = [(i, edited(base, i, 0.02), "en", "s", 0) for i in range(60)]
    got = order_minhash.classes(spark.createDataFrame(group + [(100 + i, prose(100 + i, 120), "en", "s", 0) for i in range(20)], SCHEMA)).collect()
    assert {r.class_id for r in got if r.doc_id < 60} == {0} and all(r.class_docs == 1 for r in got if r.doc_id >= 100)


def test_star_of_edits_is_one_class(spark):
    """Edits of one text that are near it but not near each other."""
    words_of, r = [f"v{i}" for i in range(20_000)], random.Random(77)
    base = [r.choice(words_of) for _ in range(200)]
    texts = [" ".join(base)]
    for _ in range(1500):
        own = list(base)
        for i in r.sample(range(200), r.randint(20, 30)):
            own[i] = r.choice(words_of)
        texts.append(" ".join(own))
    star = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = [r.class_id for r in order_minhash.classes(star).collect()]
    assert len(got) == 1501 and got.count(0) >= 0.999 * 1501


@pytest.mark.parametrize("blocks", [1, 2])
def test_comparison_across_classes_hands_out_links_only(spark, blocks):
    """Classes of one large sketch: those that a link joins are joined, and pairs are not handed out."""
    r = random.Random(12)

    def edit(base, share):
        return [r.choice("abcdefghijklmno") if r.random() < share else w for w in base]

    first, other = ([r.choice("abcdefghijklmno") for _ in range(120)] for _ in range(2))
    beside = edit(first, 0.1)
    groups = [[edit(base, 0.05) for _ in range(40)] for base in (first, beside, other, sorted(other))] + [[edit(first, 0.25)] for _ in range(30)]
    texts = {hashlib.md5(" ".join(t).encode()).digest(): (" ".join(t), g) for g, group in enumerate(groups) for t in group}
    rows = [(bytearray(node), t, 120, len(order_minhash._shingles(t.split())), bytearray([g])) for node, (t, g) in texts.items()]
    frame = spark.createDataFrame(rows, "node binary, text string, n int, d int, root binary")
    large = (frame.select("node", "n", "d", "root", F.explode(F.expr("array(-5L, 7L)")).alias("sketch"))
             .withColumn("rare", F.hex("root") != "00").withColumn("blocks", F.lit(blocks)).withColumn("rare_blocks", F.lit(blocks)))
    got = order_minhash._across(frame.select("text"), large, spark.createDataFrame([], "a binary, b binary")).collect()
    assert len(got) <= 2 * blocks**2 * (len(groups) - 1)                 # blocks of two sketches, not 40 * 40 pairs

    def joined(pairs):
        top = list(range(len(groups)))
        for x, y in pairs:
            top = [min(top[x], top[y]) if t in (top[x], top[y]) else t for t in top]
        return top

    assert all(row.similarity >= 0.8 for row in got)
    every, linked = list(texts.values()), []
    for i, (x, g) in enumerate(every):
        own = order_minhash.Aligner(x.encode().split())
        linked += [(g, h) for y, h in every[:i] if h != g and own.similar(y.encode().split())]
    found = [(texts[bytes(row.a)][1], texts[bytes(row.b)][1]) for row in got]
    assert set(found) <= {(g, h) for x, y in linked for g, h in ((x, y), (y, x))}
    assert joined(found) == joined(linked) and 2 < len(set(joined(found))) < len(groups) - 2


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in frames.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_piece_codec_equals_the_library(docs, empty, rows):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    own = piece_codec.codec(piece_codec.model_path())
    r = random.Random(7)
    letters = "ab the ing▁ \n\té日本😀.,!<s></s>019ſﬁ \x00"
    for text in ["", " ", "  a  b ", "</s>", *("".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(1500)), "x" * 5000]:
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids and own.decode(ids) == library.decode(ids)
    got = piece_codec.encoded(docs).collect()
    assert len(got) == len(rows) and all(r.n_tokens == len(r.ids) for r in got)
    assert Counter(tuple(r.ids) for r in got) == Counter(tuple(library.encode(t[1] or "", add_eos=True)) for t in rows)
    assert piece_codec.encoded(empty, keep=False).count() == 0


def test_packing(docs, empty, rows):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(residual_packing.tokenizer_path())
    want = Counter()
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.update((r[0], i // 512, i, len(ids[i:i + 512]), zlib.crc32(np.asarray(ids[i:i + 512], "<u4").tobytes())) for i in range(0, len(ids), 512))
    got = residual_packing.packed(docs.repartition(9), capacity=512).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 512
    assert len(bins) <= len(residual_packing.best_fit([r.length for r in got], 512)[2]) + 1
    filled = residual_packing.sequences(docs, capacity=512).collect()
    assert sum(len(r.ids) for r in filled) == sum(r.length for r in got)
    assert residual_packing.packed(empty).count() == 0


def test_packing_of_a_table_sorted_by_source(spark):
    """Long and short documents in different partitions fill each other's sequences."""
    pytest.importorskip("tokenizers")
    rows = [(i, "a " * (54 if i < 400 else 44), "en", f"s{i // 400}", 0) for i in range(800)]
    got = residual_packing.packed(spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), SCHEMA), capacity=100).collect()
    assert {r.length for r in got} == {55, 45} and len({r.sequence_id for r in got}) <= 1.1 * 400


def test_special_tokens_and_signs_are_encoded_as_in_the_whole_text():
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(residual_packing.tokenizer_path())
    own = residual_packing.WordEncoder(residual_packing.tokenizer_path())
    r = random.Random(9)
    texts = ["<|endoftext|>a x<|endoftext|>", "Don't.  STOP!!\n\"Éa\" €5.", *("".join(r.choice("aBé日 '.<|>s\n\t7€́") for _ in range(40)) for _ in range(500))]
    for text, ids in zip(texts, own.encoded([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_best_fit():
    r = random.Random(1)
    sizes = [r.randint(1, 100) for _ in range(2000)]
    at, offset, fill = residual_packing.best_fit(sizes, 100)
    assert max(fill) <= 100 and sum(fill) == sum(sizes) and len(fill) <= sum(sizes) / 100 * 1.02 + 1
    assert len({(a, o) for a, o in zip(at, offset, strict=True)}) == len(sizes)


def test_line_spread(spark, empty, docs):
    line = "Shared footer line here"
    rows = [(i, f"own text number {i}\n{line}{' ' * (i % 2)}\nlast of {i}", "en", f"s{i % 7}", 0) for i in range(14)] + [(50, "short words", "en", "s0", 0), (51, None, "en", None, 0)]
    got = {r.doc_id: r for r in line_spread.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert line in got[0].text and all(line not in got[i].text and f"own text number {i}\nlast of {i}" == got[i].text for i in range(1, 14))
    assert got[3].n_chars == len(got[3].text) and got[50].text == "short words" and got[51].text is None
    few = line_spread.deduplicated(spark.createDataFrame(rows[:4], SCHEMA)).collect()
    assert all(line in r.text for r in few)                              # four sites are too few
    out = line_spread.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert line_spread.deduplicated(empty).count() == 0 and line_spread.spread_report(docs).count() == docs.count()


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, "a line of many words", "en", f"s{i % n}", 0) for n, i in [(n, 100 * n + k) for n in (39, 40, 41) for k in range(60)]]
    for n in (39, 40, 41):
        own = spark.createDataFrame([r for r in rows if r[0] // 100 == n], SCHEMA)
        assert (line_spread.boilerplate(own, sites=40).count() > 0) == (n >= 40)


def test_license_scan(spark, empty, docs):
    notice = license_dice.TEMPLATES["BSD conditions"]
    rows = [(1, "text\nreleased under the MIT license\nmore", "en", "s", 0), (2, "Licensed under the Apache License", "en", "s", 0), (3, notice, "en", "s", 0),
            (4, prose(1, 30), "en", "s", 0), (5, None, "en", "s", 0), (6, "", "en", "s", 0), (7, "All rights reserved. " * 50, "en", "s", 0), (8, "All rights reserved", "en", "s", 0)]
    got = {(r.doc_id, r.kind, r.license) for r in license_dice.scanned(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (1, "line", "MIT") in got and (3, "paragraph", "BSD conditions") in got and (8, "line", "Proprietary") in got
    assert {g[0] for g in got} <= {1, 3, 7, 8}
    assert license_dice.scanned(empty).count() == 0 and license_dice.scanned(docs).count() == 0


def test_divergence_rules(docs, empty, rows):
    got = {r.doc_id: r for r in divergence_rules.judged(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()}
    for i, text, *_ in rows[:17]:
        w, r = [x.decode() for x in words(text)], got[i]
        grams = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
        again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k:k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\r\x0b\x0c")]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(again), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert divergence_rules.judged(empty).count() == 0


def test_quality(spark, docs, empty):
    good = [(i, " ".join(f"Plain words of number {i} flow on, line after line." for _ in range(5 + i % 3)), "en", f"s{i % 3}", 0) for i in range(120)]
    bad = [(1000 + i, "SHOUT!! *** ### " * (10 + i % 5), "en", f"s{i % 3}", 0) for i in range(60)]
    corpus = spark.createDataFrame(good + bad + [(None, None, None, None, None), (5000, "", None, "new", 0)], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 120, 2)] + [(1000 + i, 0) for i in range(0, 60, 2)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_bayes.judged(corpus, labels).collect()}
    held = [got[i].kept for i in range(1, 120, 2)], [not got[1000 + i].kept for i in range(1, 60, 2)]
    assert np.mean(held[0]) == 1 and np.mean(held[1]) == 1 and len(got) == 182
    kept = quality_bayes.filtered(corpus, labels)
    assert kept.columns == corpus.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    none = labels.where("quality = 1")
    assert quality_bayes.filtered(docs, none).count() == docs.count() and quality_bayes.judged(empty, labels).count() == 0


def test_posteriors_shrink_sparse_sites(spark):
    rows = [("big", "p", 0.9)] * 200 + [("big", "q", 0.2)] * 100 + [("small", "p", 0.1)] * 2 + [(None, None, 0.8)] * 50
    got = {(r.host, r.path): r for r in quality_bayes.posteriors(spark.createDataFrame(rows, "host string, path string, evidence double")).collect()}
    share = got["big", "p"].global_share
    assert share == pytest.approx((180 + 20 + 0.2 + 40) / 352)
    assert abs(got["small", "p"].path_share - share) < abs(0.1 - share) * 0.9       # two documents say little
    assert abs(got["big", "p"].path_share - 0.9) < 0.05 and (None, None) in got


def test_license_anchors_lose_no_match():
    r = random.Random(4)
    for text in license_dice.TEMPLATES.values():
        template = text.lower().split()
        need = license_dice.anchors(template, 0.8 / 1.2)
        whole = set(zip(template, template[1:]))
        for _ in range(200):
            unit = [w for w in template if r.random() > 0.25]
            own = set(zip(unit, unit[1:]))
            if 2 * len(own & whole) >= 0.8 * (len(own) + len(whole)):
                assert need & set(unit)
