"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV files, to resampled PCM.

mu-law and A-law expand by lookup tables. ADPCM is sequential within a block,
so numpy decodes one sample of all blocks of a batch at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import slices

RATE, OUT_RATE = 8_000, 16_000
MU_LAW, A_LAW, ADPCM, PCM = 7, 6, 0x11, 1
UNIT = 576
BLOCK = 64
SLICE_BYTES = 4_000_000
#: Quantiser steps and index changes of IMA ADPCM.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def _tables() -> dict[int, np.ndarray]:
    code = np.arange(256)
    u = ~code & 255
    mu = ((((u & 15) << 3) + 132) << ((u >> 4) & 7)) - 132
    a = code ^ 0x55
    exponent, mantissa = (a >> 4) & 7, a & 15
    linear = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return {MU_LAW: np.where(u & 128, -mu, mu).astype(np.int16), A_LAW: np.where(a & 128, linear, -linear).astype(np.int16)}


EXPAND = _tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA blocks, (blocks, samples), from bytes (blocks, block size).

    A block starts with its first sample (16 bits), its step index and a spare
    byte; low nibbles come first. A step index past the table counts as its end.
    """
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2").ravel().astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), len(STEPS) - 1)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((2 * len(body) + 1, len(blocks)), np.int16)
    out[0] = value = head
    for k in range(2 * len(body)):
        nibble = (body[k >> 1] >> 4 if k & 1 else body[k >> 1] & 15).astype(np.int32)
        step = STEPS[index]
        # (2 * magnitude + 1) * step / 8, by the shifts that the format prescribes
        change = (step >> 3) + np.where(nibble & 4, step, 0) + np.where(nibble & 2, step >> 1, 0) + np.where(nibble & 1, step >> 2, 0)
        value = np.clip(value + np.where(nibble & 8, -change, change), -32768, 32767)
        out[k + 1] = value
        index = np.clip(index + MOVES[nibble], 0, len(STEPS) - 1)
    return out.T


def resample(pcm: np.ndarray, rate: int, out_rate: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation to another rate; the last sample is held."""
    if rate == out_rate or not len(pcm):
        return pcm.astype("<i2")
    if out_rate == 2 * rate:
        wide = pcm.astype(np.int32)
        out = np.empty(2 * len(pcm), "<i2")
        out[0::2] = pcm
        out[1:-1:2] = (wide[:-1] + wide[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * out_rate // rate) * (rate / out_rate)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype("<i2")


def wav(payload: bytes, codec: int, rate: int = RATE) -> bytes:
    """A mono WAV file that holds the payload as it is."""
    bits, align = {PCM: (16, 2), ADPCM: (4, BLOCK)}.get(codec, (8, 1))
    per_block = 2 * (BLOCK - 4) + 1
    extra = struct.pack("<HH", 2, per_block) if codec == ADPCM else b"" if codec == PCM else struct.pack("<H", 0)
    speed = rate * BLOCK // per_block if codec == ADPCM else rate * align
    form = struct.pack("<HHIIHH", codec, 1, rate, speed, align, bits) + extra
    samples = len(payload) // BLOCK * per_block if codec == ADPCM else len(payload) // align
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form
    body += b"" if codec == PCM else b"fact" + struct.pack("<II", 4, samples)
    body += b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, int, bytes]:
    """(codec, rate, block size, payload) of a mono WAV file; other bytes raise ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        if data[at : at + 4] == b"fmt ":
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        elif data[at : at + 4] == b"data" and form:
            if form[1] != 1:
                raise ValueError("not mono")
            return form[0], form[2], form[4], data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no audio data")


def to_pcm(codec: int, block: int, payload: bytes) -> np.ndarray:
    raw = np.frombuffer(payload, np.uint8)
    if codec in EXPAND:
        return EXPAND[codec][raw]
    if codec == ADPCM:
        if block <= 4:
            raise ValueError(f"ADPCM blocks of {block} bytes hold no samples")
        return decode_adpcm(raw[: len(raw) // block * block].reshape(-1, block)).ravel()
    if codec == PCM:
        return raw[: len(raw) // 2 * 2].view("<i2")
    raise ValueError(f"codec {codec} is not a telephony codec")


def padded(text: str | None) -> bytes:
    """UTF-8 bytes, filled with bytes 255 to a positive multiple of UNIT."""
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


def _store(batches):
    for batch in batches:
        texts = batch.column(1).to_pylist()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([wav(padded(t), MU_LAW) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def _pcm(batches, out_rate: int):
    for batch in batches:
        for part in slices(batch.column(1).to_pylist(), SLICE_BYTES):
            out, errors = [], []
            for data in part:
                pcm, error = None, None
                if data is not None:
                    try:
                        codec, rate, block, payload = read_wav(data)
                        if not rate:
                            raise ValueError("a rate of 0")
                        pcm = resample(to_pcm(codec, block, payload), rate, out_rate).tobytes()
                    except (ValueError, struct.error) as found:
                        error = str(found)
                out.append(pcm)
                errors.append(error)
            done = len(part)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, done), pa.array(out, pa.binary()), pa.array(errors, pa.string())], ["doc_id", "pcm", "error"])
            batch = batch.slice(done)


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's bytes as the 8-bit samples of a mu-law WAV file.

    A null or empty text is one unit of bytes 255. Texts are stored whole; null
    and repeated doc_ids are kept row by row; other columns are ignored; an
    empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame, *, out_rate: int = OUT_RATE) -> DataFrame:
    """(doc_id, pcm, error): 16-bit PCM at ``out_rate`` of mu-law, A-law, IMA ADPCM or PCM mono WAV files in ``media``.

    Null media give null; bytes that aren't such a file give null and say why
    in error. Null and repeated doc_ids are kept row by row; a last block or
    sample that isn't whole is left out; other columns are ignored; an empty
    table gives an empty result.
    """
    return media.select("doc_id", "media").mapInArrow(lambda b: _pcm(b, out_rate), "doc_id long, pcm binary, error string")


def _features(payload: np.ndarray, adpcm: np.ndarray, pcm: np.ndarray) -> str:
    """The payload's loudness under each codec, and zero crossings, length and checksum of its stored resampled PCM."""
    parts = []
    if len(payload):
        counts = np.bincount(payload, minlength=256)
        for name, codec in (("mu", MU_LAW), ("a", A_LAW)):
            table = EXPAND[codec].astype(np.int64)
            parts.append(f"{name}_rms={(counts @ (table * table) / len(payload)) ** 0.5:.3f};{name}_peak={np.abs(table[counts > 0]).max()}")
    if len(adpcm):
        wide = adpcm.astype(np.float64)
        parts.append(f"adpcm_rms={(wide @ wide / len(wide)) ** 0.5:.3f};adpcm_peak={int(np.abs(wide).max())}")
    crossings = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
    return ";".join([*parts, f"crossings={crossings};pcm_bytes={2 * len(pcm)};pcm_crc32={zlib.crc32(pcm)}"])


COLUMNS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())


def _opened(media: bytes | None):
    """(payload, error) of a stored mu-law file."""
    if media is None:
        return None, None
    try:
        codec, _, _, payload = read_wav(media)
        if codec != MU_LAW:
            raise ValueError(f"codec {codec} is not mu-law")
        return np.frombuffer(payload, np.uint8), None
    except (ValueError, struct.error) as found:
        return None, str(found)


def _measured(rows: list[tuple]) -> pa.RecordBatch:
    """Digests, features and resampled PCM; the ADPCM blocks of all rows are decoded at once."""
    read = [_opened(media) for _, _, media in rows]
    whole = [p[: len(p) // BLOCK * BLOCK] if p is not None else np.empty(0, np.uint8) for p, _ in read]
    adpcm = decode_adpcm(np.concatenate(whole).reshape(-1, BLOCK)) if sum(map(len, whole)) else np.empty((0, 0), np.int16)
    ends, out = np.cumsum([len(w) // BLOCK for w in whole]), []
    for (doc, n, media), (payload, error), part, end in zip(rows, read, whole, ends, strict=True):
        if payload is None:
            out.append((doc, n, None, None, None, None if media is None else len(media), None if media is None else hashlib.sha256(media).hexdigest(), None, None, error))
            continue
        own, pcm = payload.tobytes(), resample(EXPAND[MU_LAW][payload], RATE)
        feature = _features(payload, adpcm[end - len(part) // BLOCK : end].ravel(), pcm)
        out.append((doc, n, len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, pcm.tobytes(), None))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), KINDS, strict=True)], [*COLUMNS, "pcm", "error"])


def _measure(batches):
    for batch in batches:
        rows, size = [], 0
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append(row)
            size += len(row[2] or b"")
            if size >= SLICE_BYTES:
                yield _measured(rows)
                rows, size = [], 0
        if rows:
            yield _measured(rows)


def measure_media(media: DataFrame) -> DataFrame:
    """Digests and features of what ``store_texts`` stored, read back from the stored bytes, with its resampled PCM.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, pcm (16-bit at 16 kHz), error. Null
    media have no digests; bytes that aren't a mu-law file have those of the
    media alone and say why in error. Whole ADPCM blocks count for its
    loudness. Repeated rows give equal rows, null doc_ids are kept, an empty
    table gives an empty result.
    """
    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm binary, error string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_measure, kinds)
