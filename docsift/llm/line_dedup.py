"""Exact removal of repeated lines with two Bloom filters.

The filters are cut into blocks by hash range, so that they grow with the lines
while a block keeps its size. The first pass hashes each document's distinct
lines to positions; a task that holds a block's range fills its once-seen bits
and, where a position was set by an earlier document, its twice-seen bits. The
second pass probes the twice-seen filter: it is broadcast while it is small;
beyond that the lines' digests meet the block of their range. Only suspects are
shuffled as rows, to be counted exactly and to choose the document that keeps
the line. The text itself moves once, to meet the decisions on it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import LOWER, UPPER, small, stored

BLANK = b" \t\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 16
#: Bits of a block, and the bytes of a twice-seen filter that is broadcast.
BLOCK_BITS = 1 << 22
BROADCAST_BYTES = 32 << 20
NO_ID = -(1 << 63)


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """The key of each line, None where it is too short to count."""
    keys = []
    for line in (text or "").encode().translate(FOLD).split(b"\n"):
        key = line.strip(BLANK)
        enough = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        keys.append(key if enough else None)
    return keys


def digest(key: bytes) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(key), "<i8").tolist())


def _digests(texts: list[str | None], min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, digest as two longs) of each document's distinct keys."""
    found = [{digest(k) for k in line_keys(t, min_chars) if k} for t in texts]
    pairs = np.array([p for own in found for p in own], np.int64).reshape(-1, 2)
    return np.repeat(np.arange(len(found)), [len(own) for own in found]), pairs


def _places(pairs: np.ndarray, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The block of each digest, by its second half, and its two positions there, by its first."""
    first = pairs[:, 0].view(np.uint64)
    return (pairs[:, 1].view(np.uint64) % np.uint64(blocks)).astype(np.int64), np.stack([first & np.uint64(bits - 1), first >> np.uint64(32) & np.uint64(bits - 1)], 1).astype(np.uint32)


def _dealt(block: np.ndarray):
    """(block, rows of that block) for each block that occurs."""
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0]) if len(block) else []
    for rows in np.split(order, starts[1:]) if len(block) else ():
        yield int(block[rows[0]]), rows


def _positions(batches, blocks: int, bits: int, min_chars: int):
    """(block, once, twice): the positions that one document of a batch set, and those that several did."""
    for batch in batches:
        row, pairs = _digests(batch.column(0).to_pylist(), min_chars)
        block, spots = _places(pairs, blocks, bits)
        out = []
        for k, rows in _dealt(block):
            at = np.unique(np.stack([np.repeat(row[rows], 2), spots[rows].ravel()]), axis=1)[1]
            at, n = np.unique(at.astype(np.uint32), return_counts=True)
            out.append((k, at[n == 1].tobytes(), at[n > 1].tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "once", "twice"])


def _filled(frame: pd.DataFrame, bits: int) -> pd.DataFrame:
    """The twice-seen bits of a block, by way of its once-seen bits."""
    once, twice = np.zeros(bits, bool), np.zeros(bits, bool)
    for one, more in zip(frame["once"], frame["twice"], strict=True):
        at = np.frombuffer(one, np.uint32)
        twice[at[once[at]]] = True
        once[at] = True
        at = np.frombuffer(more, np.uint32)
        once[at] = twice[at] = True
    return pd.DataFrame({"block": frame["block"].iloc[:1], "bits": [np.packbits(twice, bitorder="little").tobytes()]})


def _set(words: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Which rows of positions are set in a block's bytes."""
    return (words[spots >> 3] >> (spots & 7).astype(np.uint8) & 1).all(axis=1)


SUSPECT = "doc long, h1 long, h2 long"


def _suspects(batches, sent, blocks: int, bits: int, min_chars: int):
    """Digests whose positions are all in the broadcast filter."""
    twice = sent.value
    for batch in batches:
        row, pairs = _digests(batch.column(1).to_pylist(), min_chars)
        block, spots = _places(pairs, blocks, bits)
        hit = (twice[block[:, None], spots >> 3] >> (spots & 7).astype(np.uint8) & 1).all(axis=1) if len(block) else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[hit])), pa.array(pairs[hit, 0]), pa.array(pairs[hit, 1])], ["doc", "h1", "h2"])


def _filed(batches, blocks: int, bits: int, min_chars: int):
    """(block, documents, digests) of a batch, packed."""
    for batch in batches:
        row, pairs = _digests(batch.column(1).to_pylist(), min_chars)
        docs = np.array(batch.column(0).to_pylist(), np.int64)
        out = [(k, docs[row[rows]].tobytes(), pairs[rows].tobytes()) for k, rows in _dealt(_places(pairs, blocks, bits)[0])]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "docs", "pairs"])


def _met(lines: pd.DataFrame, twice: pd.DataFrame, blocks: int, bits: int) -> pd.DataFrame:
    """The suspects among the digests of one block's range."""
    if not len(lines) or not len(twice):
        return pd.DataFrame({c: pd.Series([], dtype="int64") for c in ("doc", "h1", "h2")})
    words, docs, found = np.frombuffer(twice["bits"].iloc[0], np.uint8), [], []
    for ids, packed in zip(lines["docs"], lines["pairs"], strict=True):
        pairs = np.frombuffer(packed, np.int64).reshape(-1, 2)
        hit = _set(words, _places(pairs, blocks, bits)[1])
        docs.append(np.frombuffer(ids, np.int64)[hit])
        found.append(pairs[hit])
    pairs = np.concatenate(found)
    return pd.DataFrame({"doc": np.concatenate(docs), "h1": pairs[:, 0], "h2": pairs[:, 1]})


def suspects(docs: DataFrame, min_chars: int, block_bits: int, broadcast_bytes: int) -> DataFrame:
    """(doc, h1, h2) of the lines that the twice-seen filter holds, from rows (doc, text)."""
    lines = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = min(block_bits, 1 << max(10, (lines * BITS_PER_LINE - 1).bit_length()))
    blocks = -(-lines * BITS_PER_LINE // bits)
    placed = docs.select("text").mapInArrow(lambda b: _positions(b, blocks, bits, min_chars), "block long, once binary, twice binary")
    twice = placed.groupBy("block").applyInPandas(lambda f: _filled(f, bits), "block long, bits binary")
    if blocks * bits // 8 <= broadcast_bytes:
        words = np.zeros((blocks, bits // 8), np.uint8)
        for row in twice.toLocalIterator():
            words[row["block"]] = np.frombuffer(row["bits"], np.uint8)
        sent = docs.sparkSession.sparkContext.broadcast(words)
        return docs.mapInArrow(lambda b: _suspects(b, sent, blocks, bits, min_chars), SUSPECT)
    filed = docs.mapInArrow(lambda b: _filed(b, blocks, bits, min_chars), "block long, docs binary, pairs binary")
    return filed.groupBy("block").cogroup(twice.groupBy("block")).applyInPandas(lambda a, b: _met(a, b, blocks, bits), SUSPECT)


def _apply(batches, min_chars: int):
    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, drop in zip(batch.column("text").to_pylist(), batch.column("drop").to_pylist(), strict=True):
            text = text or ""
            gone = {(d["h1"], d["h2"]) for d in drop or ()}
            parts = text.split("\n")
            if gone:
                stay = [p for p, k in zip(parts, line_keys(text, min_chars), strict=True) if k is None or digest(k) not in gone]
            else:
                stay = parts
            kept.append("\n".join(stay))
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
        rest = batch.column("row")
        yield pa.RecordBatch.from_arrays([rest, pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["row", "kept_text", "n_lines", "n_dropped"])


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, block_bits: int = BLOCK_BITS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop lines that at least ``min_docs`` documents hold, but for the largest doc_id.

    ``docs`` has doc_id and text; a struct column ``row`` carries all its other
    columns on, whatever their names. Result: row, kept_text, n_lines (before
    dropping), n_dropped; one row for each input row.

    A null or empty text is one empty line. Rows with one doc_id are one
    document, and a null doc_id counts as the smallest id. Lines of any length
    count as a whole. Equal keys in the keeping document all stay. An empty
    table gives an empty result. The sizes of blocks and broadcast change the
    plan, never the result.
    """
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    found = stored(suspects(plain, min_chars, block_bits, broadcast_bytes), "suspect-lines")
    held = found.groupBy("h1", "h2", "doc").agg(F.lit(1).alias("one"))
    repeated = held.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where(F.col("n") >= min_docs)
    repeated = stored(repeated.drop("n"), "repeated-lines")
    drops = found.join(small(repeated), ["h1", "h2"]).where("doc <> keeper")
    drops = drops.groupBy("doc").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    carried = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    met = carried.join(drops, "doc", "left")
    out = carried.select("row").schema.add("kept_text", "string").add("n_lines", "long").add("n_dropped", "long")
    return met.select("row", "text", "drop").mapInArrow(lambda b: _apply(b, min_chars), out)
