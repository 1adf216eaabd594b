"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every byte is mapped to one printable character, so a piece is a string; its score is its negative rank, which makes the
best-scored merge the lowest-ranked one. The model does no normalisation and adds no prefix.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulane.llm.common import over_batches, read_ranks

MEMO_PIECES = 200_000  # encoded pre-tokens a task remembers; it forgets all of them beyond that
MEMO_LENGTH = 64  # longer pre-tokens are encoded each time

# The bytes that stand for themselves; the others take the characters from U+0100 on, in order.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHER = [b for b in range(256) if b not in _PLAIN]
CHAR_OF = {**{b: chr(b) for b in _PLAIN}, **{b: chr(0x100 + i) for i, b in enumerate(_OTHER)}}
BYTE_OF = {c: b for b, c in CHAR_OF.items()}
_TO_CHARS = {b: CHAR_OF[b] for b in range(256)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_TO_CHARS)


def to_bytes(chars: str) -> bytes:
    return bytes(BYTE_OF[c] for c in chars)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


# Fixed values of the model format: kinds of pieces and the BPE model type.
NORMAL, UNKNOWN, BPE = 1, 2, 2


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The bytes of a sentencepiece BPE model whose ids are the ranks; the unknown piece it must have comes last.

    Ranks have to be 0 ... n-1, since a model numbers its pieces by their place.
    """
    ordered = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in ordered] != list(range(len(ordered))):
        raise ValueError("ranks have to run from 0 without gaps")

    def piece(text: str, score: float, kind: int) -> bytes:
        return _message(1, _message(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))

    pieces = [piece(to_chars(p), -float(i), NORMAL) for i, p in enumerate(ordered)]
    pieces.append(piece("<unk>", 0.0, UNKNOWN))
    trainer = _message(2, _number(3, BPE))
    normaliser = _message(3, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return b"".join(pieces) + trainer + normaliser


class ByteBpe:
    """Encodes pre-tokens to ids and decodes ids to bytes.

    A pre-token that is a vocabulary entry is that entry; any other is merged by the model.
    """

    def __init__(self, model: bytes, pattern: str):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.model.get_piece_size() - 1
        self.pieces = [to_bytes(self.model.id_to_piece(i)) for i in range(size)]
        self.ids = {p: struct.pack("<I", i) for i, p in enumerate(self.pieces)}
        self.find = regex.compile(pattern).findall
        self.memo: dict[str, bytes] = {}

    def _merge(self, words: list[str]) -> list[bytes]:
        """Packed ids of each pre-token."""
        out, chars = [], []
        for word in words:
            whole = self.ids.get(word.encode())
            out.append(whole)
            if whole is None:
                chars.append(to_chars(word.encode()))
        merged = iter(self.model.encode(chars, num_threads=1) if chars else [])
        return [np.array(next(merged), dtype="<u4").tobytes() if x is None else x for x in out]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers, one after the other."""
        words, memo = self.find(text), self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if not new:
            return b"".join(map(memo.__getitem__, words))
        made = dict(zip(new, self._merge(new)))
        packed = b"".join([memo[w] if w in memo else made[w] for w in words])
        if len(memo) + len(made) > MEMO_PIECES:
            memo.clear()
        if len(made) <= MEMO_PIECES:
            memo.update((w, ids) for w, ids in made.items() if len(w) <= MEMO_LENGTH)
        return packed

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(packed, dtype="<u4").tolist()))


def _coder(model, pattern):
    return ByteBpe(model.value, pattern)


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text: each match of `pattern` encoded separately, no special tokens.

    Null and empty texts give an empty array; repeated rows and null ids give one row each.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))  # as large as the vocabulary

    def work(batches):
        coder = _coder(model, pattern)
        for batch in batches:
            ids = [np.frombuffer(coder.encode(t or ""), dtype="<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
            yield {"id": batch.column(0), "ids": ids}

    kind = docs.schema[id_col].dataType.simpleString()
    return over_batches(docs.select(id_col, text_col), work, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, data binary): the bytes the ids stand for; null ids read as none."""
    model = tokens.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    def work(batches):
        coder = _coder(model, pattern)
        for batch in batches:
            yield {"id": batch.column(0), "data": [coder.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]}

    kind = tokens.schema[id_col].dataType.simpleString()
    return over_batches(tokens.select(id_col, ids_col), work, f"id {kind}, data binary").withColumnRenamed("id", id_col)


def token_digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text, encoded and decoded again, keeping no ids.

    Null and empty texts have no tokens and the digests of no bytes; repeated rows and null ids give one row each;
    an empty table gives none; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(serialise_model(read_ranks(vocabulary)))

    def work(batches):
        coder = _coder(model, pattern)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                packed = coder.encode(text or "")
                n.append(len(packed) // 4)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(coder.decode(packed)).hexdigest())
            yield {"id": batch.column(0), "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    kind = docs.schema[id_col].dataType.simpleString()
    out = over_batches(docs.select(F.col(id_col), F.col(text_col)), work, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
