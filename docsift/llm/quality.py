"""Text quality as ordinal cumulative-link (proportional odds) regression.

Grades 0 < 1 < ... < K-1 share one weight for each hashed text feature and are
told apart by ordered thresholds: P(grade >= k) = sigmoid(w.x - c_k). The
expected grade is the sum of these tail probabilities.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import Cache, small, stored

BITS = 18
TRAIN_ROWS = 6_000
GRADES = 3
#: Features of fewer documents aren't learned from.
LEAST_DOCS = 4
WORD = re.compile(r"[^\W_]+")


def _slot(name: str, bits: int) -> int:
    return xxhash.xxh3_64_intdigest(name.encode()) & (1 << bits) - 1


def _shape(piece: str) -> str:
    """A piece of text by its kinds of characters: case of its letters, digits, and punctuation as it is."""
    return WORD.sub(lambda m: "9" if m[0][0].isdigit() else "A" if len(m[0]) > 1 and m[0].isupper() else "a", piece)


def _piece(piece: str, bits: int) -> bytes:
    """The slots of a piece's words and that of its shape, which is told by being 2**bits higher."""
    return np.array([*(_slot("w:" + w.lower(), bits) for w in WORD.findall(piece)), _slot("s:" + _shape(piece), bits) + (1 << bits)], "<i4").tobytes()


def text_features(text: str | None, bits: int, known: Cache) -> tuple[np.ndarray, np.ndarray]:
    """(slots, values): which words a text has, and the shares of its shapes and of repeats.

    Words count once, whatever the length of the text; shares do not depend on
    it either. ``known`` serves one task and goes with it.
    """
    pieces = (text or "").split()
    new = known.fill({*pieces}, lambda unknown: [_piece(p, bits) for p in unknown])
    found, counts = np.unique(np.frombuffer(b"".join([new[p] for p in pieces]), "<i4"), return_counts=True)
    shaped = found >= 1 << bits
    words, shapes, counts = found[~shaped].astype(np.int64), found[shaped].astype(np.int64) - (1 << bits), counts[shaped]
    n = max(1, len(pieces))
    repeats = sum(a == b for a, b in zip(pieces, pieces[1:], strict=False))
    values = np.array([4 * repeats / n, len({*pieces}) / n, 1 / (1 + len(pieces))])
    return np.concatenate([words, shapes, _dense(bits)]), np.concatenate([np.ones(len(words)), 4 * counts / n, values])


@lru_cache
def _dense(bits: int) -> np.ndarray:
    """Slots of the shares that every text has."""
    return np.array([_slot("x:" + name, bits) for name in ("repeats", "variety", "short")])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray, bits: int):
        self.weights, self.cuts, self.bits = weights, cuts, bits

    def tails(self, texts: list[str | None], known: Cache | None = None) -> np.ndarray:
        """P(grade >= k) for k = 1 .. K-1, a row for each text."""
        scores, known = [], known or Cache()
        for t in texts:
            slots, values = text_features(t, self.bits, known)
            scores.append(float(self.weights[slots] @ values))
        return _sigmoid(np.array(scores, float).reshape(-1, 1) - self.cuts)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, *, bits: int = BITS, n_grades: int = GRADES, rounds: int = 150, rate: float = 0.05, penalty: float = 1e-3) -> Model:
    """Maximum likelihood by Adam over all rows; the order of thresholds is kept by summing positive gaps.

    Without rows all texts get the same tails, 0.73 and, for the best of three grades, 0.5.
    """
    weights, cut = np.zeros(1 << bits), np.r_[-1.0, np.zeros(n_grades - 2)]
    cuts = lambda c: np.cumsum(np.r_[c[0], np.exp(c[1:])])
    if rows:
        sizes = np.array([len(s) for s, _ in rows])
        slots, values = (np.concatenate(x) for x in zip(*rows, strict=True))
        # a feature's scale is how unevenly it splits the grades, so that a few telling words outweigh many others
        seen = np.bincount(slots, minlength=1 << bits)
        top = np.bincount(slots[np.repeat(grades == n_grades - 1, sizes)], minlength=1 << bits)
        n_top = max(1, int((grades == n_grades - 1).sum()))
        odds = np.abs(np.log((top + 1) / (n_top + 2)) - np.log((seen - top + 1) / (len(rows) - min(n_top, len(rows)) + 2)))
        scale = np.where(seen >= LEAST_DOCS, np.minimum(odds, 4.0), 0.0)
        scale[_dense(bits)] = 1.0
        values = values * scale[slots]
        used, slots = np.unique(slots, return_inverse=True)
        slots = slots.astype(np.int32)
        owner, starts = np.repeat(np.arange(len(rows), dtype=np.int32), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
        w = np.zeros(len(used))
        state = [np.zeros_like(x) for x in (w, w, cut, cut)]
        for t in range(1, rounds + 1):
            score = np.add.reduceat(w[slots] * values, starts)
            c = cuts(cut)
            tail = _sigmoid(score[:, None] - c)
            full = np.c_[np.ones(len(rows)), tail, np.zeros(len(rows))]
            p = np.maximum(full[np.arange(len(rows)), grades] - full[np.arange(len(rows)), grades + 1], 1e-9)
            slope = tail * (1 - tail)
            edge = np.c_[np.zeros(len(rows)), slope, np.zeros(len(rows))]
            low, high = edge[np.arange(len(rows)), grades], edge[np.arange(len(rows)), grades + 1]
            by_score = -(low - high) / p / len(rows)
            by_cut = np.zeros(n_grades - 1)
            for k in range(1, n_grades):
                by_cut[k - 1] = (((grades == k) * low - (grades == k - 1) * high) / p).mean()
            grad_cut = np.r_[by_cut.sum(), [by_cut[j:].sum() * np.exp(cut[j]) for j in range(1, n_grades - 1)]]
            grad = np.bincount(slots, values * by_score[owner], len(used)) + penalty * w
            for x, g, m, v in ((w, grad, state[0], state[1]), (cut, grad_cut, state[2], state[3])):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= rate * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights[used] = w * scale[used]
    return Model(weights, cuts(cut), bits)


def _featurised(batches, bits: int):
    known = Cache()
    for batch in batches:
        found = [text_features(t, bits, known) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), pa.array([s.astype("<i4").tobytes() for s, _ in found], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in found], pa.binary())], ["doc_id", "grade", "slots", "values"])


def train(docs: DataFrame, graded: DataFrame, *, rows: int = TRAIN_ROWS, bits: int = BITS, n_grades: int = GRADES) -> Model:
    """A model from ``graded`` (doc_id, grade int from 0) and the documents' texts.

    At most ``rows`` graded documents are used, the first by a hash of their
    ids, so that the choice follows neither the partitions nor the order of
    rows. Rows without id or grade are left out; of repeated ids one is used.
    """
    clean = graded.where("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("grade").cast("int")).alias("grade"))
    chosen = stored(clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "graded")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(small(chosen), "doc_id")
    found = texts.mapInArrow(lambda b: _featurised(b, bits), "doc_id long, grade int, slots binary, values binary").toPandas()
    found = found.sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    pairs = [(np.frombuffer(s, "<i4"), np.frombuffer(v, "<f4")) for s, v in zip(found["slots"], found["values"], strict=True)]
    return fit(pairs, found["grade"].to_numpy(np.int64), bits=bits, n_grades=n_grades)


def _scored(batches, sent):
    model, known = sent.value, Cache()
    for batch in batches:
        rows = batch.column("row")
        tails = model.tails(rows.field("text").to_pylist(), known)
        yield pa.RecordBatch.from_arrays([rows, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["row", "expected_grade", "tail_probability"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(row, expected_grade, tail_probability): the tail is that of the best grade.

    ``row`` is a struct of all columns of ``docs``, whatever their names. A
    null or empty text is scored by its lack of words; texts are read whole;
    null and repeated ids are kept row by row; an empty table gives an empty
    result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = packed.select("row").schema.add("expected_grade", "double").add("tail_probability", "double")
    return packed.mapInArrow(lambda b: _scored(b, sent), kind)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labels: 0 for toxic, 1 for poor quality, 2 for neither; null without labels."""
    return labels.select("doc_id", F.expr("case when toxic = 1 then 0 when quality = 0 then 1 when quality = 1 then 2 end").alias("grade"))
