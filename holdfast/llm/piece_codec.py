"""SentencePiece encoding and decoding with a given model file.

Encoding is a Viterbi pass over the words of a batch: words of one length advance together, hashes of the substrings that
end at a position are looked up among the sorted hashes of the pieces of that length, and the best admissible piece and
the way back are stored for all of them. The model merges by score, so a piece is admissible where it may follow the
last piece before it; exactly one is, which makes the result the library's own.

Null and empty texts have no pieces; characters outside the vocabulary become byte pieces; a text that holds the model's
space sign decodes to one with a space there; repeated rows are encoded alike; a null ``doc_id`` stays null; an empty
table gives no rows. Texts are encoded whole; a very long one is cut at word ends into blocks of bounded size. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from holdfast.llm.common import texts
from holdfast.llm.tokens import MergeTable, merged_pieces, table_from_scores

SPACE = "▁"
LETTER = "A-Za-zÀ-ɏ"
#: Words kept per worker before the memory starts anew.
REMEMBERED = 600_000


class Codec:
    """Pieces of a model that merges by score, puts a space sign before the text and falls back to bytes."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        self.piece = [model.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = {self.piece[i]: i for i in plain}
        ranks = sorted({-model.get_score(i) for i in plain})
        place = {s: k for k, s in enumerate(ranks)}
        order = {i: place[-model.get_score(i)] for i in plain}
        self.pieces, self.order = pieces, order
        # runs of space signs are merged one by one; inside words each rank belongs to one piece
        words = {t: i for t, i in pieces.items() if len(t) == 1 or SPACE * 2 not in t}
        if any(SPACE in t[1:] for t in words):
            raise ValueError("a piece runs from one word into the next")
        # where no piece holds a letter before such a mark, a word can also be cut there
        marks = [m for m in "!#$%&*,.:;?|" if not any(re.search(f"[{LETTER}]{re.escape(m)}", t) for t in pieces)]
        stop = f"{SPACE}*[{LETTER}]+(?=[{re.escape(''.join(marks))}])|" if marks else ""
        self.word = re.compile(f"{stop}{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.table: MergeTable = table_from_scores(words, order)
        self.size = np.array([len(t) for t in self.piece])
        self.byte = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
        self.byte_of = {i: int(t[3:5], 16) for t, i in self.byte.items()}
        self.known: dict[str, bytes] = {}

    def _ids(self, parts: list[str]) -> list[int]:
        out = []
        for p in parts:
            if p in self.pieces:
                out.append(self.pieces[p])
            else:
                out += [self.byte[f"<0x{b:02X}>"] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def learn(self, words: set[str]) -> None:
        spaced = [w for w in words if w.startswith(SPACE * 2)]
        plain = [w for w in words if not w.startswith(SPACE * 2)]
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
        for w in spaced:  # leading runs of space signs: rare and short, merged one by one
            self.known[w] = np.array(self._ids(_merge_long(w, self.pieces, self.order)), "<i4").tobytes()
        for which, last, _ in self.table.prefix_tokens(plain):
            tokens, counts = self.table.spell(last, self.size)
            odd = (last[:, 1:] < 0).any(1).tolist()
            raw, width = tokens.tobytes(), 4 * tokens.shape[1]
            for r, (i, count) in enumerate(zip(which.tolist(), counts.tolist())):
                end = (r + 1) * width
                self.known[plain[i]] = raw[end - 4 * count:end]
                if odd[r]:
                    ids = self._with_bytes(plain[i], tokens[r, tokens.shape[1] - count:].tolist())
                    self.known[plain[i]] = np.array(ids, "<i4").tobytes()

    def _with_bytes(self, word: str, tokens: list[int]) -> list[int]:
        out, at = [], 0
        for t in tokens:
            size = int(self.size[t]) if t >= 0 else 1
            out += [t] if t >= 0 else self._ids([word[at]])
            at += size
        return out

    def encode(self, found: list[str]) -> list[bytes]:
        """Ids of each text, as 32-bit little-endian numbers."""
        words = [self.word.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in found]
        out = []
        for first in range(0, len(words), 2000):
            part = words[first:first + 2000]
            needed = set().union(*part)
            missing = needed.difference(self.known)
            if missing:
                self.learn(missing)
                if not needed <= self.known.keys():  # the memory was started anew
                    self.learn(needed)
            out += [b"".join(map(self.known.__getitem__, w)) for w in part]
        return out

    def decode(self, ids: list[int]) -> str:
        byte_of, piece = self.byte_of, self.piece
        if byte_of.keys().isdisjoint(ids):
            text = "".join(map(piece.__getitem__, ids))
        else:
            raw = b"".join(bytes([byte_of[i]]) if i in byte_of else piece[i].encode() for i in ids)
            text = raw.decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


def _merge_long(word: str, pieces: dict[str, int], order: dict[int, int]) -> list[str]:
    """Merge the longest stretch that needs care; symbols outside the vocabulary end a stretch."""
    out, now = [], ""
    for c in word:
        if c in pieces:
            now += c
        else:
            out += merged_pieces(now, pieces, order) + [c] if now else [c]
            now = ""
    return out + merged_pieces(now, pieces, order) if now else out


_CODECS: dict[str, Codec] = {}


def _codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, ids, n_pieces, round_trip`` per row; the last tells whether decoding gives the text back.

    ``model`` is a path that every executor has.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            for first in range(0, b.num_rows, 2000):
                part = b.slice(first, 2000)
                found = part.column("text").to_pylist()
                ids = [np.frombuffer(x, "<i4") for x in codec.encode(found)]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                same = [codec.decode(x.tolist()) == t for x, t in zip(ids, found)]
                values = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), values),
                     pa.array(np.diff(ends).astype(np.int64)), pa.array(same, pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "round_trip"])

    return texts(docs).mapInArrow(encode, "doc_id long, ids array<int>, n_pieces long, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; null ids give a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            found = [None if x is None else codec.decode(x) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
