"""Byte-pair encoding with a merge-type prefix table, and decoding.

The encoding of a prefix ends in one token that the prefix alone determines. So
a table holds that last token for each prefix: among the vocabulary's matches
that end there (one automaton finds all), it is the one whose predecessor, the
last token of the shorter prefix, stays apart from it when the two are encoded
together. Following last tokens backwards from the end gives the ids. Time is
linear in the text, whatever its longest word.

No piece of the vocabulary has a space after another character, and some
characters are in no piece, so words between such places are encoded apart and
remembered in each worker (a bounded number of them).

Null counts as an empty text, whose only id is the end id. Texts are taken
whole; white space is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SPACE = "▁"
#: Words that a worker remembers, and the longest of them.
_REMEMBERED, _LONGEST = 400_000, 48
_CODECS: dict[str, PieceCodec] = {}


class PieceCodec:
    """Encoder and decoder of one model file; the file gives pieces, scores and kinds only."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.end = model.eos_id()
        self.pieces: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = {p: model.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.bytes_of = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.control = {i for i in range(len(self.pieces)) if model.is_control(i)}
        self.unknown = model.unk_id()
        self.matcher = ahocorasick.Automaton()
        for p in self.ids:
            self.matcher.add_word(p, p)
        self.matcher.make_automaton()
        self.apart: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}
        self.split: dict[str, tuple[str, str]] = {}
        if any(_SPACE in p.lstrip(_SPACE) for p in self.ids):
            raise ValueError("a piece with an inner space cannot be encoded word by word")
        self.lines = not any("\n" in p for p in self.ids)
        self.known: dict[str, tuple[str, str]] = {}

    def merged(self, text: str, down_to: int = 1) -> list[str]:
        """Plain merging of a short string until no neighbours merge: the best-scored first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > down_to:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two tokens that merge into a piece last; None for one character."""
        if len(piece) == 1:
            return None
        found = self.split.get(piece)
        if found is None:
            left, right = self.merged(piece, 2)
            found = self.split[piece] = left, right
        return found

    def compatible(self, before: str, piece: str) -> bool:
        """Whether two tokens stay apart when their text is encoded.

        Undoes the later of the two tokens' merges, again and again. The
        neighbours then seen at the border must not have a merge of their own
        that comes before the merge that ended that state.
        """
        found = self.apart.get((before, piece))
        if found is not None:
            return found
        x, y, until, also = before, piece, -float("inf"), False
        scores, found = self.scores, True
        while True:
            own = scores.get(x + y)
            if own is not None and (own > until or also and own == until):
                found = False
                break
            left, right = self.halves(x), self.halves(y)
            if left is None and right is None:
                break
            # The merge with the lower score came last; of equals, the one further right.
            if right is None or left is not None and scores[x] < scores[y]:
                until, also, x = scores[x], False, left[1]
            else:
                until, also, y = scores[y], True, right[0]
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        self.apart[before, piece] = found
        return found

    def alone(self, piece: str) -> bool:
        """Whether a piece is the encoding of its own text."""
        found = self.whole.get(piece)
        if found is None:
            found = self.whole[piece] = self.merged(piece) == [piece]
        return found

    def tokens(self, word: str) -> list[str]:
        """Tokens of a word, by the table of last tokens."""
        last, at = [""] * (len(word) + 1), 0
        for end, piece in self.matcher.iter(word):
            while at < end:                  # a character that is no piece of its own
                at += 1
                last[at] = last[at] or word[at - 1]
            if not last[end + 1]:
                start = end + 1 - len(piece)
                if (self.compatible(last[start], piece) if start else self.alone(piece)):
                    last[end + 1] = piece
        for at in range(at, len(word)):
            last[at + 1] = last[at + 1] or word[at]
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word_ids(self, word: str) -> list[int]:
        ids: list[int] = []
        for token in self.tokens(word):
            known = self.ids.get(token)
            if known is not None:
                ids.append(known)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in token.encode()]
            else:
                ids.append(self.unknown)
        return ids

    def words(self, text: str) -> list[str]:
        """Parts that are encoded apart; a dummy space stands before the text."""
        if not text:
            return []
        plain = _SPACE + text.replace(" ", _SPACE)
        lines = plain.split("\n") if self.lines else [plain]
        out: list[str] = []
        for i, line in enumerate(lines):
            if i:
                out.append("\n")
            if _SPACE + _SPACE in line or line.endswith(_SPACE):
                out += re.findall(f"{_SPACE}*[^{_SPACE}]+|{_SPACE}+", line)
            elif line:
                first, *rest = line.split(_SPACE)
                out += ([first] if first else []) + [_SPACE + w for w in rest]
        return out

    def coded(self, text: str) -> tuple[str, str]:
        """Decimal ids joined by spaces, the end id among them, and the text decoded from them."""
        found = []
        for word in self.words(text):
            entry = self.known.get(word)
            if entry is None:
                ids = self.word_ids(word)
                entry = " ".join(map(str, ids)), self.decoded(ids)
                if len(self.known) < _REMEMBERED and len(word) <= _LONGEST:
                    self.known[word] = entry
            found.append(entry)
        decoded = "".join([d for _, d in found])
        return " ".join([*[i for i, _ in found], str(self.end)]), decoded.removeprefix(" ")

    def decoded(self, ids: list[int]) -> str:
        """Text of the ids with the space of each piece; a run of byte tokens is read as UTF-8."""
        out = bytearray()
        for i in ids:
            if i in self.bytes_of:
                out += self.bytes_of[i]
            elif i not in self.control:
                out += self.pieces[i].replace(_SPACE, " ").encode()
        return out.decode("utf-8", "replace")

    def decode(self, ids: list[int]) -> str:
        return self.decoded(ids).removeprefix(" ")

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.coded(text)[0].split(" ")]


def codec(path: str) -> PieceCodec:
    """The codec of a file, one in each worker."""
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encoded(docs: DataFrame, path: str | None = None, keep: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, and either ids and the decoded text (`keep`) or their digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path or model_path())
        for batch in batches:
            joined, decoded = [], []
            for text in batch.column(1):
                i, d = own.coded(text.as_py() or "")
                joined.append(i)
                decoded.append(d)
            counts = pa.array([i.count(" ") + 1 for i in joined], pa.int64())
            if keep:
                rest = {"ids": pa.array([list(map(int, i.split(" "))) for i in joined], pa.list_(pa.int32())), "decoded": pa.array(decoded, pa.string())}
            else:
                rest = {"ids_sha256": pa.array([hashlib.sha256(i.encode()).hexdigest() for i in joined], pa.string()),
                        "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())}
            yield pa.record_batch({"doc_id": batch.column(0), "n_tokens": counts, **rest})

    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = "ids array<int>, decoded string" if keep else "ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {rest}")
