"""Fill-in-middle transformation of texts held as ropes.

A text is a balanced tree whose leaves are slices of it. Each node caches how
many units (blanks and the word behind them) and how many code points it
covers, so that a cut at a rank walks one path of the tree and shares all other
subtrees. The pieces are joined in a new order with sentinels between them; the
inverse cuts the output's tree where its sentinels stand.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
LEAF_UNITS = 64
LEAF = re.compile(r"(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){1,%d}+|[\x20\x09-\x0D]++" % LEAF_UNITS)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points that are worked on at a time, one text at least.
SLICE_CHARS = 2_000_000
FORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Rope:
    """A leaf with its text, or two subtrees."""

    __slots__ = ("left", "right", "text", "units", "chars")

    def __init__(self, text: str | None, units: int, chars: int, left: Rope | None = None, right: Rope | None = None):
        self.text, self.units, self.chars, self.left, self.right = text, units, chars, left, right

    @classmethod
    def of(cls, text: str) -> Rope:
        """All leaves but the last have LEAF_UNITS units; trailing blanks are a leaf of one."""
        slices = LEAF.findall(text)
        if not slices:
            return cls("", 0, 0)
        units = [LEAF_UNITS] * len(slices)
        for i in range(max(0, len(slices) - 2), len(slices)):
            units[i] = len(UNIT.findall(slices[i]))
        row = [cls(s, n, len(s)) for s, n in zip(slices, units, strict=True)]
        while len(row) > 1:
            pairs = [a + b for a, b in zip(row[::2], row[1::2], strict=False)]
            row = pairs + row[len(pairs) * 2 :]
        return row[0]

    def __add__(self, other: Rope) -> Rope:
        if not self.chars or not other.chars:
            return self if self.chars else other
        return Rope(None, self.units + other.units, self.chars + other.chars, self, other)

    def split(self, rank: int, by: str = "units") -> tuple[Rope, Rope]:
        """The first ``rank`` units (or ``chars``) and the rest."""
        if rank <= 0 or rank >= getattr(self, by):
            return (Rope("", 0, 0), self) if rank <= 0 else (self, Rope("", 0, 0))
        if self.text is None:
            inside = rank - getattr(self.left, by)
            if inside <= 0:
                a, b = self.left.split(rank, by)
                return a, b + self.right
            a, b = self.right.split(inside, by)
            return self.left + a, b
        if by == "units":
            at = next(islice(UNIT.finditer(self.text), rank - 1, None)).end()
            return Rope(self.text[:at], rank, at), Rope(self.text[at:], self.units - rank, self.chars - at)
        parts = self.text[:rank], self.text[rank:]
        return tuple(Rope(p, len(UNIT.findall(p)), len(p)) for p in parts)

    def __str__(self) -> str:
        parts, open_ = [], [self]
        while open_:
            node = open_.pop()
            if node.text is None:
                open_ += (node.right, node.left)
            else:
                parts.append(node.text)
        return "".join(parts)


def mark(sentinel: str) -> Rope:
    """A sentinel's leaf; it counts no units."""
    return Rope(sentinel, 0, len(sentinel))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers of 32 bits for a document; one without an id draws as the empty id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]


def formed(text: str, doc_id: int | None, *, seed: int, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    rope = Rope.of(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)):
        return rope.units, "plain", None, None, text
    low, high = sorted((h1 % (rope.units + 1), h2 % (rope.units + 1)))
    before, suffix = rope.split(high)
    prefix, middle = before.split(low)
    if h4 % 100 < spm:
        form, output = "spm", mark(SUFFIX) + suffix + mark(PREFIX) + prefix + mark(MIDDLE) + middle
    else:
        form, output = "psm", mark(PREFIX) + prefix + mark(SUFFIX) + suffix + mark(MIDDLE) + middle
    return rope.units, form, prefix.chars, middle.chars, str(output)


def restored(output: str | None, form: str | None) -> str | None:
    """The text that an output was made from; null where the output lacks its form's sentinels.

    The text holds no sentinel, and no part of one before a true one makes a
    second, so the first found behind another is the true one.
    """
    if output is None or form == "plain":
        return output
    order = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}.get(form)
    if order is None or not output.startswith(order[0]):
        return None
    second = output.find(order[1], len(order[0]))
    third = output.find(order[2], second + len(order[1]))
    if second < 0 or third < 0:
        return None
    rest, middle = Rope.of(output).split(third, "chars")
    one, two = rest.split(second, "chars")
    one, two, middle = (part.split(len(s), "chars")[1] for part, s in zip((one, two, middle), order, strict=True))
    return str(one + middle + two if form == "psm" else two + middle + one)


def _slices(batch: pa.RecordBatch, column: str):
    """Parts of a batch of about SLICE_CHARS bytes of text at most, one row at least."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    lo = 0
    while lo < len(batch):
        hi = max(lo + 1, int(ends.searchsorted((ends[lo - 1] if lo else 0) + SLICE_CHARS, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def _form(batches, options: dict):
    for whole in batches:
        for batch in _slices(whole, "text"):
            ids = batch.column("doc_id").to_pylist()
            n, form, prefix, middle, output = zip(*(formed(t or "", i, **options) for i, t in zip(ids, batch.column("text").to_pylist(), strict=True)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n,)), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def _restore(batches):
    for whole in batches:
        for batch in _slices(whole, "output"):
            back = [restored(o, f) for o, f in zip(batch.column("output").to_pylist(), batch.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], [*batch.schema.names, "restored"])


def form_documents(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text, plain or with its middle moved behind the rest.

    ``rate`` per cent of the documents are rearranged, ``spm`` per cent of them
    with the suffix first; a document's draws follow from its id and ``seed``
    alone. A null text counts as empty; an empty text, or one that holds a
    sentinel, stays plain. Whole texts are cut, whatever their length. Rows
    that share a doc_id share their draws, and a null doc_id draws as an empty
    one; equal draws give an empty middle. Other columns of ``docs`` are
    ignored. An empty table gives an empty result.
    """
    options = {"seed": seed, "rate": rate, "spm": spm}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _form(b, options), FORMED)


def restore_documents(outputs: DataFrame) -> DataFrame:
    """The rows of ``form_documents``, with the text each ``output`` was made from as ``restored``.

    Only ``output`` and ``form`` are read. An output without its form's
    sentinels, an unknown form or a null output gives null.
    """
    return outputs.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output").mapInArrow(_restore, f"{FORMED}, restored string")
