"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

The vocabulary's byte strings are written as pieces of printable characters, one per byte, each
scored by its negative rank, with identity normalisation; sentencepiece then merges exactly as
the ranks say: the best-scored pair first, the leftmost on ties. Text is cut by the tokenizer's
pattern, each match is encoded on its own, and a match that is itself in the vocabulary is that
one id. Texts of ASCII alone are cut by the standard library's form of the pattern, in half the time.
Decoding maps ids back to bytes.

The model is about a megabyte; its file is read on the driver and broadcast, after a check of
its size. Workers remember the ids of up to ``MEMO`` matches, and whole batches are written and
read as flat numbers. Each document is one row in and one row out: nothing is shuffled.

Defined cases: a null or empty text has no ids and decodes to no bytes; null ids decode to no
bytes; an id outside the vocabulary fails with its value; a match of any length (a word of a
million letters) is encoded whole and not remembered; repeated rows come back alike; an empty
table stays empty; input columns named like an added one are replaced.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomwatch.llm.names import col

#: A rank file larger than this is no vocabulary and isn't broadcast.
MAX_VOCABULARY_BYTES = 64_000_000
#: Remembered matches in a worker, of up to ``MEMO_LENGTH`` characters: some 60 MB at most.
MEMO, MEMO_LENGTH = 200_000, 64
#: Texts whose matches are looked up together, and ids that are decoded together.
TEXTS, PART = 64, 1 << 16


def read_ranks(path: str) -> list[bytes]:
    """The byte strings of a rank file (base64 and rank a line), by rank; ranks start at 0."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, data.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError(f"the ranks in {path} have gaps")
    return [ranks[i] for i in range(len(ranks))]


def byte_characters() -> dict[int, str]:
    """A printable character for each byte: itself where printable, else the next from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _bytes(field: int, value: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(value)) + value


def _float(field: int, value: float) -> bytes:
    return _varint(field << 3 | 5) + np.float32(value).tobytes()


def serialize_model(pieces: list[bytes]) -> bytes:
    """A sentencepiece model whose ids are the ranks; the unknown piece comes after them."""
    # Field numbers and enums of the public model format.
    piece, trainer, normalizer = 1, 2, 3
    text, score, kind, normal, unknown = 1, 2, 3, 1, 2
    model_type, bpe, vocab_size, unk_id, bos_id, eos_id, pad_id = 3, 2, 4, 40, 41, 42, 43
    name, charsmap, dummy_prefix, strip_spaces, escape_spaces = 1, 2, 3, 4, 5

    letters = byte_characters()
    out = [
        _bytes(piece, _bytes(text, "".join(map(letters.get, p)).encode()) + _float(score, -rank) + _number(kind, normal))
        for rank, p in enumerate(pieces)
    ]
    out.append(_bytes(piece, _bytes(text, b"<unk>") + _float(score, 0) + _number(kind, unknown)))
    spec = _number(model_type, bpe) + _number(vocab_size, len(pieces) + 1) + _number(unk_id, len(pieces))
    out.append(_bytes(trainer, spec + b"".join(_number(k, -1) for k in (bos_id, eos_id, pad_id))))
    plain = _bytes(name, b"identity") + _bytes(charsmap, b"")
    out.append(_bytes(normalizer, plain + b"".join(_number(k, 0) for k in (dummy_prefix, strip_spaces, escape_spaces))))
    return b"".join(out)


def ascii_pattern(pattern: str) -> str | None:
    """A pattern for the standard library that cuts ASCII text as ``pattern`` does; None where it uses more than letters, numbers and white space."""
    # What these classes hold of ASCII.
    held = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r" \t\n\r\x0b\x0c"}
    out, inside, rest = "", False, pattern
    while rest:
        name = next((n for n in held if rest.startswith(n)), None)
        if name:
            out += held[name] if inside else f"[{held[name]}]"
        elif rest.startswith(r"\S") and not inside:
            name, out = r"\S", out + rf"[^{held[chr(92) + 's']}]"
        elif rest[0] == "\\":
            return None
        else:
            name, out = rest[0], out + rest[0]
            inside = name == "[" or (inside and name != "]")
        rest = rest[len(name) :]
    return out


class Encoder:
    """Encodes texts with a serialised model; remembers the ids of matches, as int32 bytes."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.find_any = regex.compile(pattern).findall
        plain = ascii_pattern(pattern)
        self.find_ascii = re.compile(plain).findall if plain else self.find_any
        self.letters = byte_characters()
        self.memo: dict[str, bytes] = {}
        self.size = self.pieces.get_piece_size() - 1

    def _coded(self, matches: list[str]) -> Iterable[tuple[str, bytes]]:
        mapped = [m.encode().decode("latin-1").translate(self.letters) for m in matches]
        wholes = self.pieces.piece_to_id(mapped) if mapped else []
        for m, whole, ids in zip(matches, wholes, self.pieces.encode(mapped, num_threads=1), strict=True):
            yield m, array("i", (whole,) if whole < self.size else ids).tobytes()

    def encode_all(self, texts: Iterable[str | None]) -> list[bytes]:
        """The ids of each text, as int32 bytes."""
        matches = [(self.find_ascii if t.isascii() else self.find_any)(t) if t else [] for t in texts]
        memo = self.memo
        new = set().union(*matches).difference(memo)
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = set().union(*matches)
        memo.update(self._coded(list(new)))
        out = [b"".join(map(memo.__getitem__, m)) for m in matches]
        for m in new if len(new) > MEMO else [m for m in new if len(m) > MEMO_LENGTH]:
            del memo[m]
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], dtype=np.int32).tolist()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(model: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(model, pattern)
    return _ENCODERS[key]


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """``docs`` with ``ids_col``, the ids (array<int>) of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(serialize_model(read_ranks(vocabulary)))

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoder = _encoder(shared.value, pattern)
        parts: list[bytes] = []
        for start in range(0, len(texts), TEXTS):
            parts += encoder.encode_all(texts[start : start + TEXTS].to_pylist())
        offsets = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), dtype=np.int32)))

    return docs.withColumn(ids_col, encode(col(text_col)))


def _bytes_of(ids: np.ndarray, pool: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes that ids stand for, gathered from the pieces' pool."""
    if len(ids) and not 0 <= ids.min() <= ids.max() < len(lengths):
        raise ValueError(f"ids from {ids.min()} to {ids.max()}; the vocabulary has {len(lengths)}")
    size = lengths[ids]
    before = np.cumsum(size) - size
    return pool[np.repeat(first[ids] - before, size) + np.arange(size.sum())].tobytes()


def decode_ids(docs: DataFrame, vocabulary: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``docs`` with ``bytes_col``, the bytes (binary) that the ids stand for."""
    pieces = read_ranks(vocabulary)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    # The pieces' bytes one after the other, and where each begins and how long it is.
    shared = docs.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(lengths) - lengths, lengths))

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        numbers, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        out = []
        for i, valid in enumerate(ids.is_valid().to_pylist()):
            row = numbers[ends[i] : ends[i + 1]] if valid else numbers[:0]
            parts = (row[at : at + PART] for at in range(0, len(row), PART))
            out.append(b"".join(_bytes_of(part, *shared.value) for part in parts))
        return pa.array(out, pa.binary())

    return docs.withColumn(bytes_col, decode(col(ids_col)))
