"""Words that collide under any polynomial modulo 2^64."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidelint.llm import order_minhash, repeat_blocks, residual_packing, wordhash

public_tokenizers = pytest.importorskip("public_tokenizers")


def pair(n):
    """The Thue-Morse word of n letters and its opposite."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_digests_differ(n):
    text = " ".join(pair(n)).encode()
    data, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    starts, ends, _ = wordhash.word_spans(data, offsets)
    assert len(set(wordhash.word_digests(data, starts, ends).tolist())) == 2


def test_packing_gives_each_word_its_ids(spark):
    texts = [" ".join(pair(n)) for n in (1024, 2048, 4096)]
    got = residual_packing.packed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in pieces] == [zlib.crc32(ids[r.start:r.start + r.length].tobytes()) for r in pieces]
        assert sum(r.length for r in pieces) == len(ids)


def test_windows_of_opposite_words_are_no_repeats(spark):
    one, other = pair(1024)
    fill = [f"w{i}" for i in range(34)]
    docs = [(0, " ".join([one, *fill])), (1, " ".join([other, *fill])), (2, " ".join([one, *fill]))]
    got = {r.doc_id: r.n_removed for r in repeat_blocks.repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {0: 35, 1: 0, 2: 35}


def test_near_duplicates_tell_them_apart(spark):
    one, other = pair(2048)
    docs = [(0, " ".join([one] * 9)), (1, " ".join([other] * 9)), (2, " ".join([one] * 9))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = order_minhash.deduplicated(frame).collect()
    assert sorted(r.doc_id for r in got) == [0, 1] and len({hashlib.md5(r.text.encode()).digest() for r in got}) == 2
