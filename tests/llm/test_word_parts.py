"""Words go to the tokenizer in parts, each part once, and give the ids of the whole text."""

import random

import numpy as np
import pytest

from tidelint.llm import residual_packing

tokenizers = pytest.importorskip("tokenizers")


def test_spellings_of_a_word_share_their_parts():
    """A word was remembered once more for each case and for each run of signs after it."""
    own = residual_packing.WordEncoder(residual_packing.tokenizer_path())
    own.encoded(["Word, word. WORD! word wOrd, Éa. <|x".encode()])
    assert set(own.known) == {b"word", b",", b".", b"!", b"\xc3\x89a", b"<|x"}


def test_letters_that_end_in_a_mark_in_lower_case_stay_with_the_signs_after_them():
    library = tokenizers.Tokenizer.from_file(residual_packing.tokenizer_path())
    own = residual_packing.WordEncoder(residual_packing.tokenizer_path())
    r = random.Random(4)
    texts = ["İ, İ.", "", " ", "é.É!", "漢。漢.", "a" * 70 + "...", *("".join(r.choice("aZéİÑß.,!<|>1٣ⅷ漢ª̈😀𐐀'sS- \n\\\"#") for _ in range(30)) for _ in range(400))]
    for text, ids in zip(texts, own.encoded([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]
