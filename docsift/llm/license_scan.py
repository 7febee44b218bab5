"""Fuzzy search for short licence notices.

Texts are folded to lower-case words joined by one space. A notice that may
hold k edits is split into k+1 seeds, one of which stands unedited in any
match (pigeonhole). An Aho-Corasick automaton finds the seeds, and only the
window around a seed is given to the ``regex`` library, whose bounded-error
matching verifies the edits and gives the span.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.common import LOWER, UPPER

#: Phrase of whole words and its label.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
#: Notices as folded words, and the label each stands for.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("this program is free software you can redistribute it and or modify", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution", "cc-by"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved worldwide", "reserved"),
)
CHARS_PER_EDIT = 10
#: Every ASCII byte but digits and letters is a blank; capitals fold.
FOLD = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()) + UPPER.encode(),
    b" " * sum(not chr(c).isalnum() for c in range(128)) + LOWER.encode(),
)


class Notices:
    """Seeds and verifying patterns of a list of (notice, label)."""

    def __init__(self, notices, chars_per_edit: int):
        self.notices = []
        self.seeds = ahocorasick.Automaton()
        seeds = {}
        for k, (text, label) in enumerate(notices):
            edits = len(text) // chars_per_edit
            self.notices.append((label, len(text), edits, regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={edits}}}")))
            cuts = [len(text) * i // (edits + 1) for i in range(edits + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                seeds.setdefault(text[lo:hi], []).append((k, lo))
        for seed, places in seeds.items():
            self.seeds.add_word(seed, (len(seed), places))
        self.seeds.make_automaton()

    def find(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of each verified match, by notice and place."""
        windows: dict[int, list[list[int]]] = {}
        for end, (size, places) in self.seeds.iter(text):
            for k, offset in places:
                _, length, edits, _ = self.notices[k]
                start = end + 1 - size - offset
                lo, hi = max(0, start - edits), min(len(text), start + length + edits)
                own = windows.setdefault(k, [])
                if own and lo <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], hi)
                else:
                    own.append([lo, hi])
        found = []
        for k in sorted(windows):
            label, _, _, pattern = self.notices[k]
            for lo, hi in windows[k]:
                found += sorted((label, m.start(), m.end(), sum(m.fuzzy_counts)) for m in self._matches(k, text, lo, hi))
        return found

    def _matches(self, k: int, text: str, lo: int, hi: int):
        """The best match of the stretch, then those before and behind it, as long as a match fits in."""
        _, length, edits, pattern = self.notices[k]
        stretches = [(lo, hi)]
        while stretches:
            lo, hi = stretches.pop()
            if hi - lo >= length - edits and (m := pattern.search(text, lo, hi)):
                yield m
                stretches += [(lo, m.start()), (m.end(), hi)]


def folded(text: str | None) -> str:
    return b" ".join((text or "").encode().translate(FOLD).split()).decode()


def places(words: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand consecutively."""
    padded, sought, out = f" {words} ", f" {phrase} ", []
    at, seen, n = padded.find(sought), 0, 0
    while at >= 0:
        n, seen = n + padded.count(" ", seen, at), at
        out.append(n)
        at = padded.find(sought, at + 1)
    return out


def word_numbers(words: str, spots: list[int]) -> dict[int, int]:
    """The number of the word that stands at each spot of the text, counted in one pass."""
    out, seen, n = {}, 0, 0
    for at in sorted(set(spots)):
        n, seen = n + words.count(" ", seen, at), at
        out[at] = n
    return out


KIND = "doc_id long, n_words long, phrases array<struct<label:string,word:bigint>>, matches array<struct<label:string,first_word:bigint,last_word:bigint,edits:int,score:double>>"


def _scan(batches, phrases, notices, chars_per_edit: int):
    search = Notices(notices, chars_per_edit)
    sizes = [n for _, n, _, _ in search.notices]
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("phrases", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))), ("matches", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())])))])
    least = min(sizes)
    for batch in batches:
        counts, exact, fuzzy = [], [], []
        for text in batch.column(1).to_pylist():
            words = folded(text)
            counts.append(words.count(" ") + 1 if words else 0)
            exact.append([{"label": label, "word": w} for phrase, label in phrases if phrase in words for w in places(words, phrase)])
            found = search.find(words)
            number = word_numbers(words, [at for _, lo, hi, _ in found for at in (lo, hi)])
            fuzzy.append([{"label": label, "first_word": number[lo], "last_word": number[hi], "edits": edits, "score": max(0.0, 1 - edits / max(least, hi - lo))} for label, lo, hi, edits in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(exact, kind.field("phrases").type), pa.array(fuzzy, kind.field("matches").type)], schema=kind)


def scan_licenses(docs: DataFrame, *, phrases=PHRASES, notices=NOTICES, chars_per_edit: int = CHARS_PER_EDIT) -> DataFrame:
    """(doc_id, n_words, phrases, matches), one row for each row of ``docs``.

    Words are runs of ASCII letters and digits and of non-ASCII characters,
    with A-Z folded. ``phrases`` lists each place where a phrase's words stand
    consecutively, overlapping ones too; ``matches`` each verified notice with
    its words, edits and score (1 for no edit). A null or empty text has no
    words; texts are searched whole; null and repeated doc_ids are kept row by
    row; other columns are ignored; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _scan(b, phrases, notices, chars_per_edit), KIND)
