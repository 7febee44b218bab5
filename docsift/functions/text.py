"""Column functions for labels, values and their comparison.

All are built-in expressions; ``compat`` stands for NFKC, which Spark has no
expression for. Values are strings; null means that nothing was read.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands for "none", "unreadable" and "empty" in each of the places that ask.
NA_TOKENS = ("", "NA", "N/A", "N.A.", "NONE", "-", "—", "없음")
UNREADABLE_TOKENS = ("판독불가", "ILLEGIBLE", "UNREADABLE")
EMPTY_VALUES = ("", "N/A", "NA", "-", "없음", "판독불가")
#: Units that a comparison of numbers leaves out.
UNITS = (
    "m3", "m³", "cm2", "cm²", "mm2", "kg", "kgf", "lb", "ton", "h", "hr", "hrs", "hour", "min", "sec", "s", "d",
    "in", "inch", "mm", "cm", "m", "ft", "c", "f", "k", "℃", "℉", "°c", "°f", "degc", "degf",
    "cp", "cst", "dba", "psi", "psig", "bar", "barg", "mpa", "kpa", "l", "gal", "ma", "v", "sg", "g", "gr", "spgr", "pa",
)
TOKEN = r"[A-Za-z°℃℉]+\d*|\d+(?:\.\d+)?|."
NUMBER = r"-?\d+(?:\.\d+)?"
BLANKS = r"[\s\x1c-\x1f\x85\xa0]"
BLANK_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"


def _compatible() -> dict[str, str]:
    """Characters that NFKC replaces, by themselves, and what by."""
    every = map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x30000)))
    return {x: n for x in every if (n := unicodedata.normalize("NFKC", x)) != x}


_COMPATIBLE = _compatible()
_ONE = {x: n for x, n in _COMPATIBLE.items() if len(n) == 1}
_MORE = {x: n for x, n in _COMPATIBLE.items() if len(n) != 1}


def compat(c: Column) -> Column:
    """NFKC, character by character: full width, superscripts, unit signs and the like as plain characters.

    Unlike NFKC it composes no sequences with combining marks. Texts of ASCII
    alone pass through.
    """
    table = F.from_json(F.lit(json.dumps(_MORE)), "map<string,string>")
    spread = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    several = "[" + "".join(f"\\x{{{ord(x):X}}}" for x in _MORE) + "]"
    plain = lambda t: F.translate(t, "".join(_ONE), "".join(_ONE.values()))
    return F.when(~c.rlike(r"[^\x00-\x7F]"), c).when(c.rlike(several), plain(spread)).otherwise(plain(c))


def strip(c: Column | str) -> Column:
    """All white space at both ends; Spark's trim takes spaces alone. A column given by its name goes without a pattern."""
    if isinstance(c, str):
        # $ also stands before a separator that ends the text, which isn't white space here
        separator = F.endswith(F.col(c), F.lit("\u2028")) | F.endswith(F.col(c), F.lit("\u2029"))
        return F.when(separator, strip(F.col(c))).otherwise(F.btrim(F.col(c), F.lit(BLANK_CHARS)))
    return F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")


def found(c: Column | str) -> Column:
    """True where a value is neither null nor blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def norm_label(c: Column) -> Column:
    """Upper case, letters and digits of any script."""
    return F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")


def norm_alias(c: Column, punctuation: Column) -> Column:
    """As ``norm_label``; where ``punctuation`` is true, / . - count, so that 12" isn't 1/2"."""
    return F.when(punctuation, F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}/.\-]", "")).otherwise(norm_label(c))


def ascii_label(c: Column) -> Column:
    """Upper case ASCII letters and digits; null gives an empty label."""
    return F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9A-Z]+", "")


def bare_label(c: Column) -> Column:
    """The label without what stands in parentheses."""
    return F.regexp_replace(c, r"\([^()]*\)", " ")


def clean(c: Column) -> Column:
    """In compatible characters, stripped, without one leading question mark. Null gives ''."""
    text = F.coalesce(c, F.lit(""))
    # printed ASCII with nothing to take off, as most values are, is clean as it is
    return F.when(text.rlike(r"\A[!->@-~](?:[ -~]*[!-~])?\z"), text).otherwise(strip(F.regexp_replace(strip(compat(text)), r"^\?", "")))


def _token_in(c: Column, tokens) -> Column:
    return F.upper(c).isin(*tokens)


def is_na(cleaned: Column) -> Column:
    return _token_in(cleaned, NA_TOKENS)


def is_unreadable(cleaned: Column) -> Column:
    return _token_in(cleaned, UNREADABLE_TOKENS)


def uncertain(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))).startswith("?")


def _roman() -> dict[str, str]:
    """Roman tokens up to XXIX. XIV and XXIV, XIX and XXIX read XI first and so come out two higher, which results rely on."""
    ones = {"": 0, "I": 1, "II": 2, "III": 3, "IV": 4, "V": 5, "VI": 6, "VII": 7, "VIII": 8, "IX": 9}
    return {"X" * tens + unit: str(10 * tens + n + (2 if tens and unit in ("IV", "IX") else 0)) for tens in range(3) for unit, n in ones.items() if tens or unit}


ROMAN = _roman()


def roman_to_arabic(c: Column) -> Column:
    """Upper case, with words that are roman numbers up to XXIX as digits; a lone X or I counts."""
    table, upper = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair]), F.upper(c)
    words = F.split(upper, r"(?U)\b")
    replaced = F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), "")
    # without a word of these letters alone the words are joined as they were
    return F.when(~upper.rlike(r"(?U)(?=[IVX])\b[IVX]+\b"), upper).otherwise(replaced)


def norm_text(cleaned: Column) -> Column:
    """Roman numbers as digits, then ASCII letters and digits and Hangul alone."""
    return _plain_text(roman_to_arabic(cleaned))


def _plain_text(arabic: Column) -> Column:
    return F.regexp_replace(arabic, "[^A-Z0-9가-힣]+", "")


def _kept_tokens(arabic: Column, all_letters: bool) -> Column:
    """What numbers are read from: '' for a text without digits, which holds none."""
    tokens = F.regexp_extract_all(arabic, F.lit(f"({TOKEN})"), 1)
    worded = lambda t: t.rlike(r"^[\p{L}°℃℉]")
    gone = worded if all_letters else (lambda t: worded(t) & F.lower(t).isin(*UNITS))
    return F.when(~arabic.rlike("[0-9]"), "").otherwise(F.array_join(F.filter(tokens, lambda t: ~gone(t)), ""))


def _numbers(kept: Column) -> Column:
    text = F.regexp_replace(kept, r"(?<=\d)\s*-\s*(?=\d)", " ")
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), 1), lambda x: x.cast("double"))


def numbers(cleaned: Column, *, all_letters: bool = False) -> Column:
    """Numbers of a value as array<double>, without those within units; a hyphen between digits divides."""
    return _numbers(_kept_tokens(roman_to_arabic(cleaned), all_letters))


def _is_numeric(kept: Column) -> Column:
    return kept.rlike(NUMBER) & ~kept.rlike("[A-Za-z가-힣]")


def looks_numeric(cleaned: Column) -> Column:
    return _is_numeric(_kept_tokens(roman_to_arabic(cleaned), False))


@dataclass(frozen=True)
class Forms:
    """A value as comparisons need it: cleaned, with arabic numbers, as plain text, and without units."""

    cleaned: Column
    arabic: Column
    text: Column
    kept: Column

    @classmethod
    def of(cls, c: Column) -> Forms:
        cleaned = clean(c)
        arabic = roman_to_arabic(cleaned)
        return cls(cleaned, arabic, _plain_text(arabic), _kept_tokens(arabic, False))


def with_forms(df: DataFrame, *names: str) -> tuple[DataFrame, list[Forms]]:
    """``df`` with the forms of the named columns as columns, so that each is computed once a row; drop them by ``FORM``."""
    step = lambda make: {f"{FORM}{n}_{part}": c for n in names for part, c in make(n).items()}
    at = lambda n, part: F.col(f"{FORM}{n}_{part}")
    df = df.withColumns(step(lambda n: {"cleaned": clean(F.col(n))})).withColumns(step(lambda n: {"arabic": roman_to_arabic(at(n, "cleaned"))}))
    df = df.withColumns(step(lambda n: {"text": _plain_text(at(n, "arabic")), "kept": _kept_tokens(at(n, "arabic"), False)}))
    return df, [Forms(*(at(n, part) for part in ("cleaned", "arabic", "text", "kept"))) for n in names]


FORM = "__form_"


def without_forms(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(FORM)])


def same_forms(a: Forms, b: Forms, numeric: Column | None = None) -> Column:
    """Whether a read value equals the true one.

    Two values for "none" are equal, and two unreadable ones. ``numeric`` true
    compares numbers alone and needs one; false compares text; null compares
    numbers if both values are numbers and units, else text.
    """
    text = a.text == b.text
    auto = F.when(_is_numeric(a.kept) & _is_numeric(b.kept), _numbers(a.kept) == _numbers(b.kept)).otherwise(text)
    rest = auto
    if numeric is not None:
        forced_a, forced_b = (_numbers(_kept_tokens(x.arabic, True)) for x in (a, b))
        rest = F.when(numeric.isNull(), auto).when(numeric, (F.size(forced_a) > 0) & (forced_a == forced_b)).otherwise(text)
    none_a, none_b, blur_a, blur_b = is_na(a.cleaned), is_na(b.cleaned), is_unreadable(a.cleaned), is_unreadable(b.cleaned)
    return F.when(none_a | none_b, none_a & none_b).when(blur_a | blur_b, blur_a & blur_b).otherwise(rest)


def same_value(gold: Column, got: Column, numeric: Column | None = None) -> Column:
    """``same_forms`` of two columns; in plans with several comparisons ``with_forms`` shares their work."""
    return same_forms(Forms.of(gold), Forms.of(got), numeric)


def reason(gold: Column, got: Column, numeric: Column | None = None) -> Column:
    """Why two values differ, '' if they don't: NOT_NONE, NONE, UNREADABLE, NUMBER or TEXT, and both values."""
    a, b = clean(gold), clean(got)
    kind = F.when(is_na(a), "NOT_NONE").when(is_na(b), "NONE").when(is_unreadable(a), "UNREADABLE")
    numbers_differ = looks_numeric(a) & looks_numeric(b) if numeric is None else F.coalesce(numeric, looks_numeric(a) & looks_numeric(b))
    kind = kind.when(numbers_differ, "NUMBER").otherwise("TEXT")
    return F.when(same_value(gold, got, numeric), "").otherwise(F.concat_ws(" | ", kind, a, b))


def norm_number(c: Column) -> Column:
    """.933 as 0.933; zeros at the end stay, as 14.000 may be fourteen thousand."""
    return F.regexp_replace(c, r"(?<!\d)\.(\d+)", r"0.$1")


def join_notes(*parts: Column) -> Column:
    """Stripped notes that aren't blank, joined by ' | '."""
    return F.concat_ws(" | ", *[F.nullif(strip(p), F.lit("")) for p in parts])


def document_id(path: Column) -> Column:
    """File name without folder and extension, white space as _, 80 characters, 'doc' if nothing is left."""
    name = F.regexp_replace(F.regexp_extract(path, r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    short = F.substring(F.regexp_replace(name, r"\s+", "_"), 1, 80)
    return F.when(short == "", "doc").otherwise(short)


def clean_gold_label(c: Column) -> Column:
    """A labelled source label without a closing note in Hangul or of over 14 characters, and without marks."""
    note = F.regexp_extract(c, r"\(([^()]*)\)\s*$", 1)
    cut = F.when(note.rlike("[가-힣]") | (F.length(note) > 14), F.regexp_replace(c, r"\([^()]*\)\s*$", "")).otherwise(c)
    return strip(F.regexp_replace(cut, "※.*$|·", ""))


def inches(c: Column) -> Column:
    """1-1/2 and 1 1/2 as 1.5, 3/4 as 0.75, else the first number; null without one."""
    whole, top, bottom = (F.regexp_extract(c, r"(\d+)\s*[- ]\s*(\d+)/(\d+)", g).try_cast("double") for g in (1, 2, 3))
    over, under = (F.regexp_extract(c, r"(\d+)/(\d+)", g).try_cast("double") for g in (1, 2))
    return F.coalesce(whole + F.try_divide(top, bottom), F.try_divide(over, under), F.regexp_extract(c, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def first_number(c: Column) -> Column:
    return F.regexp_extract(c, f"({NUMBER})", 1).try_cast("double")


def flow_coefficient(flow: Column, gravity: Column, drop: Column, factor: float = 1.156) -> Column:
    """Cv = factor * Q * sqrt(SG / dP) for liquids; null unless all are above 0."""
    good = (flow > 0) & (gravity > 0) & (drop > 0)
    return F.when(good, factor * flow * F.sqrt(F.try_divide(gravity, drop)))


def cache_key(content_hash: Column, page: Column, version: Column) -> Column:
    """The key under which a reader's answer is stored: it changes with content, page and reader version."""
    return F.sha2(F.concat(content_hash, F.lit("|p"), page.cast("string"), F.lit("|"), version), 256)


#: Why a model gave no value, by the reason it states.
ABSENCES = {
    "no_evidence": "no evidence: the document lacks the item",
    "unreadable": "not read: the item is there, its value can't be read",
    "checkbox_ambiguous": "not read: no mark, several marks or an unclear one",
}


def absence_note(value: Column, absence: Column, row_text: Column, note: Column) -> Column:
    """Why there is no value, then the row it was looked for in and the model's own note, joined by ' | '."""
    table = F.create_map(*[F.lit(x) for pair in ABSENCES.items() for x in pair])
    why = F.when(value.isNull(), F.coalesce(F.try_element_at(table, strip(absence)), F.lit("not found in the document")))
    row = F.when(found(row_text), F.concat(F.lit("row: "), strip(row_text)))
    return F.concat_ws(" | ", why, row, F.when(found(note), strip(note)))
