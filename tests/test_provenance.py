"""Provenance files against a plain reader, and replacement of blocks by key."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelint.sources import provenance as pv


def plain(text):
    out = {}
    for block in text.split("\n\n"):
        lines = [x for x in block.split("\n") if x.strip()]
        if lines and not lines[0].startswith(" "):
            fields = [re.match(r"\s*(\w+)\s*:\s*(.*)", x) for x in lines[1:]]
            out[lines[0].strip()] = {m.group(1): m.group(2).strip() for m in fields if m}
    return out


def made(seed):
    r = random.Random(seed)
    blocks = []
    for i in range(60):
        fields = r.sample(["tipo", "campaign", "cast", "co2", "stations", "inputs", "other"], r.randrange(7))
        lines = [r.choice([f"P{r.randrange(40)}", f"P{r.randrange(40)} ", " indented", "inputs: odd name"])]
        lines += [f"{r.choice(['', '  ', chr(9)])}{f}{r.choice([':', ' : ', ' :'])}{r.choice(['x', 'a|b ', '2020-01-01 10:00:00', ''])}{i}" for f in fields + fields[:1]]
        lines += r.sample(["no field here", "   ", "two words : no"], r.randrange(3))
        blocks.append("\n".join(lines))
    return ("\n" * r.randrange(2)) + r.choice(["\n\n", "\n\n\n"]).join(blocks) + "\n" * r.randrange(3)


@pytest.mark.parametrize("split", [False, True])
def test_blocks_equal_a_plain_reader(spark, tmp_path, split):
    texts = {}
    for i in range(4):
        folder = tmp_path / f"site {i}"
        folder.mkdir()
        texts[f"site {i}"] = made(i) if i < 3 else ""
        (folder / "provenance.txt").write_text(texts[f"site {i}"])
        (folder / "other.txt").write_text("P1\n tipo: wrong\n")
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.tidelint.pieceRows", "40")
    try:
        rows = pv.read_provenance(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.tidelint.pieceRows")
    got = {(re.search(r"site(?:%20| )\d", r.file).group(0).replace("%20", " "), r.name): {f: r[c] for f, c in pv.FIELDS.items() if r[c] is not None} for r in rows}
    want = {(site, name): {f: v for f, v in fields.items() if f in pv.FIELDS} for site, text in texts.items() for name, fields in plain(text).items()}
    assert got == want and len(rows) == len(want)


def test_index_takes_the_block_of_its_folder(spark):
    index = spark.createDataFrame([("a/x/P1_QLF.csv", "P1_QLF"), ("a/y/P1_QLF.csv", "P1_QLF"), ("a/y/P2_QLF.csv", "P2_QLF")], "path string, product string")
    lines = [("a/x/provenance.txt", 0, "P1_QLF"), ("a/x/provenance.txt", 1, " inputs: one"), ("a/y/provenance.txt", 0, "P1_QLF"), ("a/y/provenance.txt", 1, " co2: c.txt"), ("a/y/provenance.txt", 2, "")]
    got = pv.with_provenance(index, pv.provenance_blocks(spark.createDataFrame(lines, "file string, line_no long, line string"))).collect()
    assert {(r.path, r.inputs, r.co2_file, r.campaign) for r in got} == {("a/x/P1_QLF.csv", "one", "-", ""), ("a/y/P1_QLF.csv", "", "c.txt", ""), ("a/y/P2_QLF.csv", "", "-", "")}
    empty = pv.provenance_blocks(spark.createDataFrame([], "file string, line_no long, line string"))
    assert pv.with_provenance(index, empty).count() == 3


def test_replacement_survives_a_failed_run(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "blocks")
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")
    rows = lambda: sorted((tuple(r) for r in pv.read_blocks(spark, path, "k").collect()), key=str)
    pv.replace_blocks(frame([("a", 1), ("a", 2), ("b", 3), (None, 4)]), path, "k")
    before = rows()
    assert sorted(map(str, before)) == sorted(map(str, [("a", 1), ("a", 2), ("b", 3), (None, 4)]))

    def lost(*_):
        raise RuntimeError("executor lost")

    with monkeypatch.context() as m:                           # rows are written, the switch is not
        m.setattr(pv, "_switch", lost)
        with pytest.raises(RuntimeError):
            pv.replace_blocks(frame([("a", 9)]), path, "k")
    assert rows() == before
    with pytest.raises(Exception):                             # the rows themselves fail midway
        pv.replace_blocks(frame([("a", 9)] * 50).repartition(5).withColumn("v", F.expr("assert_true(v < 0)").cast("int")), path, "k")
    assert rows() == before
    for _ in range(2):                                         # done, and done again
        pv.replace_blocks(frame([("a", 9), ("c", 5)]), path, "k")
        assert sorted(map(str, rows())) == sorted(map(str, [("a", 9), ("b", 3), ("c", 5), (None, 4)]))
