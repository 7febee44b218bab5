"""Vector bin packing of tokenised examples into fixed-length sequences.

A sequence has three limits: tokens, segments and loss-bearing tokens. A bin is
filled by the dot-product heuristic: of the examples that fit, the one whose
demand has the largest dot product with what the bin has left goes in. Where
none fits, one is cut to fill the bin. Examples of one demand are one class, so
a placement looks at the classes, whose number the pool bounds, not at all
examples that wait. Each task packs the rows of its own partition, a bounded
pool at a time, and carries the rest on. The one sequence that a partition
leaves open meets those of other partitions in a second packing.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from contextlib import contextmanager
from unicodedata import is_normalized

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import Cache, slices, stored

LENGTH = 4096
SEGMENTS = 512
END = 2
#: Bytes of a task's caches of blank-separated pieces and of words.
PIECES_CACHE, WORDS_CACHE = 56 << 20, 16 << 20
POOL_TOKENS = 1 << 20
#: Open sequences of so many partitions are packed together.
LEFT_PARTITIONS = 1024
#: ASCII punctuation but for the apostrophe, with which the splitter knows words.
CLOSING = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
_readers: dict[str, WordReader] = {}


class WordReader:
    """Token ids by a ``tokenizers`` file whose normaliser and splitter never join text across ASCII blanks.

    The ids of a text are those of its blank-separated pieces, which are looked
    up in a bounded cache. A new piece of letters and closing punctuation is
    normalised and split here, as the file's rules ask (NFC, lower case, runs
    of letters and of punctuation, bytes as characters); any other goes through
    the file's own normaliser and splitter. The file's model encodes both. A
    text that holds one of the file's added tokens is left to the library as a
    whole, which gives that token's id, as it does by default.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        self.normal, self.split, self.model = self.whole.normalizer, self.whole.pre_tokenizer, self.whole.model
        self.as_bytes = dict(enumerate(_byte_characters()))
        self.forget()

    def forget(self) -> None:
        """Start with empty caches, as each task does."""
        self.pieces, self.words = Cache(PIECES_CACHE), Cache(WORDS_CACHE)

    def _word(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _piece(self, raw: bytes) -> bytes:
        text = raw.decode()
        body = text.rstrip(CLOSING)
        if not body or body.isalpha() and "Σ" not in body and is_normalized("NFC", body):
            low = body.lower()
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.as_bytes) if low.isalpha() and is_normalized("NFC", low) else ""
            parts = [p for p in (low, text[len(body) :]) if p] if low or not body else self._split(text)
        else:
            parts = self._split(text)
        return b"".join([self.words.get(p, self._word) for p in parts])

    def _split(self, text: str) -> list[str]:
        return [p for p, _ in self.split.pre_tokenize_str(self.normal.normalize_str(text))]

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for part in slices(texts):
            held = [bool(t and self.added.search(t)) for t in part]
            raw = [[] if h else (t or "").encode().split() for t, h in zip(part, held, strict=True)]
            known = self.pieces.fill({r for rs in raw for r in rs}, lambda new: [self._piece(r) for r in new])
            for t, h, rs in zip(part, held, raw, strict=True):
                yield np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4") if h else np.frombuffer(b"".join([known[r] for r in rs]), "<u4")


def _byte_characters() -> list[str]:
    """The printable character for each byte in byte-level vocabularies: itself, or one from 256 on where it isn't printable."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@contextmanager
def reader(path: str) -> Iterator[WordReader]:
    """The worker's reader; its caches go when the task ends."""
    if path not in _readers:
        _readers[path] = WordReader(path)
    use = _readers[path]
    try:
        yield use
    finally:
        use.forget()


class Classes:
    """What waits, by demand: (tokens, tokens without loss) of an example's rest, and a stack of the examples alike."""

    def __init__(self, limits: np.ndarray):
        self.limits, self.place, self.stacks = limits, {}, []
        self.demand = np.zeros((64, 2), np.int64)
        self.count = np.zeros(64, np.int64)

    def push(self, tokens: int, free: int, item) -> None:
        k = self.place.get((tokens, free))
        if k is None:
            k = self.place[tokens, free] = len(self.stacks)
            if k == len(self.count):
                self.demand, self.count = np.r_[self.demand, np.zeros_like(self.demand)], np.r_[self.count, np.zeros_like(self.count)]
            self.demand[k] = tokens, free
            self.stacks.append([])
        self.stacks[k].append(item)
        self.count[k] += 1

    def pop(self, k: int):
        self.count[k] -= 1
        return self.stacks[k].pop()

    def tidied(self) -> Classes:
        """Without classes that have run empty."""
        kept = Classes(self.limits)
        for k in np.flatnonzero(self.count[: len(self.stacks)]).tolist():
            for item in self.stacks[k]:
                kept.push(*self.demand[k].tolist(), item)
        return kept

    def best(self, left: np.ndarray) -> tuple[int, int]:
        """(class, tokens) to place next; (-1, 0) if nothing goes in. Of equal products the class that came first wins."""
        n = len(self.stacks)
        size, free, some = self.demand[:n, 0], self.demand[:n, 1], self.count[:n] > 0
        bears = size - free
        fits = some & (size <= left[0]) & (bears <= left[2])
        length, segments, loss = self.limits
        if left[1] > 1 or not (some & ~fits).any():
            if fits.any():
                score = np.where(fits, size * (left[0] / length**2) + left[1] / segments**2 + bears * (left[2] / loss**2), -1.0)
                k = int(np.argmax(score))
                return k, int(size[k])
        # nothing fits whole, or the last segment is to fill the rest: cut the largest
        k = int(np.argmax(np.where(some & ~fits, size, -1)))
        n = int(min(left[0], size[k], free[k] + left[2]))
        return (k, n) if some[k] and n > 0 else (-1, 0)


class Pool:
    """Examples waiting in one task; ``prompt`` tokens at the start of an example bear no loss.

    Of equal examples the one that came last goes first.
    """

    def __init__(self, length: int, segments: int, loss: int):
        self.limits = np.array([length, segments, loss], float)
        self.waiting, self.tokens, self.sequence, self.out = Classes(self.limits), 0, 0, []

    def add(self, key, ids: np.ndarray, prompt: int = 0) -> None:
        if len(ids):
            prompt = min(prompt, len(ids))
            self.waiting.push(len(ids), prompt, (key, ids, 0, prompt))
            self.tokens += len(ids)

    def pack(self, last: bool) -> list[tuple]:
        """Pieces (key, start, length, crc, example's tokens, sequence, offset, loss) of the sequences closed now.

        Without ``last`` a sequence is begun only while there are tokens to fill it.
        """
        while self.tokens and (last or self.tokens >= self.limits[0]):
            left, offset = self.limits.copy(), 0
            while left[0] > 0 and left[1] > 0 and self.tokens:
                k, n = self.waiting.best(left)
                if k < 0:
                    break
                key, ids, start, prompt = self.waiting.pop(k)
                bears = n - max(0, min(prompt - start, n))
                self.out.append((key, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.sequence, offset, bears))
                left -= (n, 1, bears)
                offset += n
                self.tokens -= n
                if start + n < len(ids):
                    self.waiting.push(len(ids) - start - n, max(0, prompt - start - n), (key, ids, start + n, prompt))
            self.sequence += 1
        self.waiting = self.waiting.tidied()
        out, self.out = self.out, []
        return out


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
PIECES = ", ".join(f"`{n}` long" for n in NAMES)


def _batch(rows, base: int, limits) -> pa.RecordBatch:
    """Rows of pieces; the sequences that have room are marked open."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
    sequence, sizes = np.array(columns[5], np.int64), np.array([columns[2], columns[7]], np.int64)
    filled = np.zeros((3, int(sequence.max(initial=-1)) + 1))
    for row, worth in ((0, sizes[0]), (1, np.ones(len(sequence))), (2, sizes[1])):
        np.add.at(filled[row], sequence, worth)
    room = (filled < np.reshape(limits, (3, 1))).all(axis=0)
    columns[5] = base + sequence
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(room[sequence] if rows else [], pa.bool_())], [*NAMES, "bears", "open"])


def _pack(batches, path: str, length: int, segments: int, loss: int):
    base = TaskContext.get().partitionId() << 40
    pool, limits = Pool(length, segments, loss), (length, segments, loss)
    with reader(path) as read:
        for batch in batches:
            keys, texts, prompts = (c.to_pylist() for c in batch.columns)
            for key, body, head in zip(keys, read.ids(texts), read.ids(prompts), strict=True):
                pool.add(key, np.concatenate([head, body, [END]]).astype("<u4"), len(head))
                if pool.tokens >= POOL_TOKENS:
                    yield _batch(pool.pack(False), base, limits)
    yield _batch(pool.pack(True), base, limits)


def _repacked(frame: pd.DataFrame, length: int, segments: int, loss: int) -> pd.DataFrame:
    """Open sequences put together, the fullest first, each where the dot product with what is left is largest."""
    frame = frame.sort_values(["sequence_id", "offset"], kind="stable")
    own = frame.groupby("sequence_id", sort=True).agg(length=("length", "sum"), n=("length", "size"), bears=("bears", "sum"))
    limits, demand = np.array([length, segments, loss], float), own.to_numpy(float)
    left, target, shift = np.zeros((len(own), 3)), {}, {}
    for i in np.argsort(-demand[:, 0], kind="stable").tolist():
        score = np.where((left >= demand[i]).all(axis=1), left / limits**2 @ demand[i], -1.0)
        k = int(np.argmax(score)) if score.max(initial=-1) >= 0 else i
        if k == i:
            left[i] = limits
        target[own.index[i]], shift[own.index[i]] = own.index[k], length - int(left[k][0])
        left[k] -= demand[i]
    return frame.assign(offset=frame["offset"] + frame["sequence_id"].map(shift), sequence_id=frame["sequence_id"].map(target))[NAMES]


def pack_documents(docs: DataFrame, tokenizer: str, *, prompt: str | None = None, length: int = LENGTH, segments: int = SEGMENTS, loss: int = LENGTH) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row a piece.

    ``docs`` has doc_id and text; ``prompt`` names a column of text that is put
    before it and bears no loss (instruction data). An example's ids are those
    of prompt and text, then id 2. Each id is in exactly one piece. A sequence
    has at most ``length`` tokens, ``segments`` pieces and ``loss``
    loss-bearing tokens. sequence_id is the task's partition times 2**40 and a
    running number: the same files, split alike, give the same ids.

    A null or empty text has the end id alone. Null and repeated doc_ids are
    kept as they are, each row an example of its own. Texts of any length are
    cut as needed. Equal dot products go to the demand that was seen first, and
    of equal examples the last goes in first. Other columns are ignored. An
    empty table gives no rows.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(prompt) if prompt else F.lit(None).cast("string")).alias("prompt"))
    made = stored(plain.mapInArrow(lambda b: _pack(b, tokenizer, length, segments, loss), PIECES + ", bears long, open boolean"), "pieces")
    left = made.where("open").withColumn("lot", F.expr(f"shiftright(sequence_id, 40) div {LEFT_PARTITIONS}"))
    left = left.groupBy("lot").applyInPandas(lambda f: _repacked(f, length, segments, loss), PIECES)
    return made.where("not open").select(NAMES).unionByName(left)
