"""Byte-level BPE through a sentencepiece model written straight from the ranks.

Each byte is mapped to a character of its own, each token of the vocabulary to
the piece of those characters, scored by its negative rank. The model has no
normalisation and adds nothing, so sentencepiece merges the best-ranked
neighbours first, as a rank file asks. Pre-tokens are encoded one by one, but
for those that are in the vocabulary as a whole: the library that the ranks
come from gives these their own id, whatever merges lead to. Ids are decoded by
the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import Cache, slices

#: From here the 256 byte characters stand in a row; none of them is a blank or sentencepiece's own mark.
FIRST = 0x4E00
#: Bytes of each of the two caches of a task.
CACHE = 64 << 20
#: Unicode white space, as the pattern's \s has it.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
BLANK_ENDS = {*BLANKS}
#: ASCII punctuation but for the apostrophe, which starts pre-tokens of its own.
CLOSING = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_coders: dict[tuple[str, str], Coder] = {}


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value) -> bytes:
    """A protobuf field: int or bool as varint, float as 32 bits, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def model_bytes(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece i is token i; the unknown piece comes last."""
    out = []
    for rank, token in enumerate(tokens):
        piece = "".join(chr(FIRST + b) for b in token)
        out.append(_field(1, _field(1, piece.encode()) + _field(2, -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = -1
    trainer = _field(3, 2) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(n, none) for n in (41, 42, 43))
    plain = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, plain)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    return [found[i] for i in range(len(found))]


class Coder:
    """Encodes texts to ids and decodes them."""

    def __init__(self, path: str, pattern: str):
        import regex
        import sentencepiece

        self.tokens = read_ranks(path)
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.pattern = regex.compile(pattern)
        self.to_char = {b: chr(FIRST + b) for b in range(256)}
        self.decimal = [str(i) for i in range(len(self.tokens))]
        self.chunks = re.compile(f" ?[^{BLANKS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]")
        self.forget()

    def forget(self) -> None:
        """Start with empty caches, as each task does."""
        self.spaced, self.pretokens = Cache(CACHE), Cache(CACHE)

    def _learn(self, pretokens: list[str]) -> list[bytes]:
        """The ids of pre-tokens: a token of the vocabulary is one id, others are merged by the model."""
        raw = [p.encode() for p in pretokens]
        unknown = [r.decode("latin-1").translate(self.to_char) for r in raw if r not in self.rank]
        merged = iter(self.model.encode(unknown, num_threads=1) if unknown else ())
        return [array("I", [self.rank[r]] if r in self.rank else next(merged)).tobytes() for r in raw]

    def _split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk that none of them reaches over."""
        body = chunk.rstrip(CLOSING)
        if body[body[:1] == " " :].isalpha():  # letters and closing punctuation, the usual case
            return [body, chunk[len(body) :]] if len(body) < len(chunk) else [body]
        return self.pattern.findall(chunk)

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        parts = [self._split(c) for c in chunks]
        known = self.pretokens.fill({p for c in parts for p in c}, self._learn)
        return [b"".join([known[p] for p in c]) for c in parts]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words after a space; empty where white space touches a word's ends, so that it can't stand alone."""
        chunks = [self.chunks.findall(" " + w) if w and w[0] not in BLANK_ENDS and w[-1] not in BLANK_ENDS else [] for w in words]
        got = iter(self._chunks([c for own in chunks for c in own]))
        return [b"".join([next(got) for _ in own]) for own in chunks]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for part in slices(texts):
            split = [(t or "").split(" ") for t in part]
            known = self.spaced.fill({w for words in split for w in words[1:]}, self._spaced)
            for text, words in zip(part, split, strict=True):
                found = [known[w] for w in words[1:]]
                if b"" in found or words[0][-1:] in BLANK_ENDS:
                    yield np.frombuffer(b"".join(self._chunks(self.chunks.findall(text or ""))), "<u4")
                else:
                    yield np.frombuffer(b"".join([*self._chunks(self.chunks.findall(words[0])), *found]), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@contextmanager
def coder(path: str, pattern: str) -> Iterator[Coder]:
    """The worker's coder; its caches go when the task ends."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(path, pattern)
    use = _coders[path, pattern]
    try:
        yield use
    finally:
        use.forget()


def _encode(batches, path: str, pattern: str):
    with coder(path, pattern) as use:
        for batch in batches:
            ids = [i.astype(np.int32) for i in use.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decode(batches, path: str, pattern: str):
    with coder(path, pattern) as use:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([use.decode(i or ()) for i in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"])


def encode_documents(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each text, as array<int>.

    A null or empty text has no ids. Texts are taken whole; null and repeated
    doc_ids are kept row by row; other columns are ignored; an empty table
    gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _encode(b, ranks, pattern), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, decoded): the bytes that the ids of ``encode_documents`` stand for; null ids are none."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, ranks, pattern), "doc_id long, decoded binary")


def _digests(batches, path: str, pattern: str):
    """Both ways on one batch, as passing the ids on between them would copy each of them."""
    with coder(path, pattern) as use:
        for batch in batches:
            n, coded, back = [], [], []
            for ids in map(np.ndarray.tolist, use.encode(batch.column(1).to_pylist())):
                n.append(len(ids))
                coded.append(hashlib.sha256(" ".join(map(use.decimal.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(use.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, decodes and hashes both; cases as in ``encode_documents``."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _digests(b, ranks, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
