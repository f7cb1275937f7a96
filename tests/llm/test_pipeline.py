"""The pipeline against a plain version of every stage, and the registered queries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidelint.llm import line_spread, piece_codec, residual_packing
from tidelint.llm.queries import QUERIES, SQL

FOOTER = "Read more on our pages today"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(f"word{r.randrange(500)}" for _ in range(n))


def rows():
    passage = prose(900, 55)
    out = [(i, prose(i, 120 + 5 * i) + "\n" + FOOTER, "en", f"s{i % 8}") for i in range(24)]
    for i in (1, 2, 3):                                                      # near copies of documents 1 to 3
        words = out[i][1].split(" ")
        words[40:42] = ["other", "words"]
        out.append((100 + i, " ".join(words), "en", f"s{(i + 3) % 8}"))
    out += [(200 + i, prose(300 + i, 80) + " " + passage + " " + prose(400 + i, 60), "de", f"s{i}") for i in range(4)]
    out += [(300 + i, "BUY NOW!! *** $$$ ### " * (20 + i), "en", f"s{i % 8}") for i in range(16)]
    return out + [out[5]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("sf")
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    df.repartition(5).write.parquet(f"{top}/documents.parquet")
    labels = [(r[0], int(r[0] < 300)) for r in data if r[0] % 2 == 0]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{top}/labels.parquet")
    return str(top)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def plain(data):
    docs = [r for r in data if r[0] < 300]                                    # the classifier's part: junk goes
    sites, first = {}, {}
    for i, text, _, site in docs:
        for line in set(text.split("\n")):
            if len(line.split()) >= line_spread.WORDS:
                sites.setdefault(line.strip().lower(), set()).add(site)
                first[line.strip().lower()] = min(i, first.get(line.strip().lower(), i))
    spread = {x for x, own in sites.items() if len(own) >= line_spread.SITES}
    docs = [(i, "\n".join(x for x in text.split("\n") if not (x.strip().lower() in spread and first[x.strip().lower()] != i))) for i, text, *_ in docs]
    kept = []
    for i, text in sorted(set(docs)):
        if not any(lcs(text.split(), other.split()) >= 0.8 * max(len(text.split()), len(other.split())) for _, other in kept):
            kept.append((i, text))
    seen = Counter(tuple(t.split()[k:k + 35]) for _, t in kept for k in range(len(t.split()) - 34))
    out = {}
    for i, text in kept:
        w = text.split()
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(35)}
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_pipeline_equals_plain_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns, name
    want = plain(rows())
    assert {r.doc_id: r.text.split() for r in docs.collect()} == want and docs.count() == len(want)
    assert docs.where("n_chars <> length(text)").count() == 0

    own = residual_packing.encoder(residual_packing.tokenizer_path())
    ids = {i: np.frombuffer(own.encoded([" ".join(w).encode()])[0], "<u4") for i, w in want.items()}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == {
        (i, k // 2048): (k, len(x[k:k + 2048]), zlib.crc32(x[k:k + 2048].tobytes())) for i, x in ids.items() for k in range(0, len(x), 2048)}
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in p) <= 2048 and [a for a, _ in sorted(p)] == list(np.cumsum([0, *(n for _, n in sorted(p))])[:-1]) for p in places.values())


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registration():
    names = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(names) and set(SQL) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    for part in (got, want):
        for c in part.select_dtypes("number").columns:
            part[c] = part[c].astype(float)
    rounded = lambda df: sorted(map(str, df[sorted(df.columns)].round(9).itertuples(index=False, name=None)))
    assert rounded(got) == rounded(want)


def test_queries_with_production_parameters(spark, folder):
    """Each query without SQL over the whole table of a folder, against its plain version."""
    sentencepiece, tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("tokenizers")
    data = rows()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    coded = [(r[0], library.encode(r[1], add_eos=True)) for r in data]
    got = QUERIES["op3_piece_codec"](spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter((i, len(x), sha(" ".join(map(str, x))), sha(library.decode(x))) for i, x in coded)

    library = tokenizers.Tokenizer.from_file(residual_packing.tokenizer_path())
    cut = Counter()
    for i, text, *_ in data:
        ids = np.asarray([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        cut.update((i, k // 2048, k, len(ids[k:k + 2048]), zlib.crc32(ids[k:k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    got = QUERIES["op7_residual_packing"](spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == cut
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 2048) + 1

    seen = Counter(tuple(r[1].split()[k:k + 35]) for r in data for k in range(len(r[1].split()) - 34))
    want = Counter()
    for i, text, *_ in data:
        w = text.split()
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(35)}
        want[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    assert Counter(map(tuple, QUERIES["op9_repeated_passages"](spark, folder).collect())) == want

    texts = sorted({(r[1], r[0]) for r in data}, key=lambda x: x[1])
    root = {i: i for _, i in texts}
    for n, (a, i) in enumerate(texts):
        for b, j in texts[:n]:
            if lcs(a.split(), b.split()) >= 0.8 * max(len(a.split()), len(b.split())) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert {(r.doc_id, r.class_id) for r in QUERIES["op6_near_duplicates"](spark, folder).collect()} == set(root.items())

    kept = {r.doc_id: r.kept for r in QUERIES["op2_quality_bayes"](spark, folder).collect()}
    assert kept == {r[0]: r[0] < 300 for r in data}
