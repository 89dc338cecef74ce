"""Scalar text functions (P6-P19) as JVM-side Column expressions.

All of them are built from ``pyspark.sql.functions`` so they stay inside
whole-stage codegen (or, for the higher-order ones, inside the JVM); none of
them calls back into Python.
"""
from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from termspark.functions import constants as K


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_str(s: str) -> str:
    """Quote a Python string as a Spark SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def regex_escape_class(chars: str) -> str:
    """Escape characters for use inside a regex character class."""
    out = []
    for ch in chars:
        if ch in "\\]^-[&":
            out.append("\\" + ch)
        else:
            out.append(ch)
    return "".join(out)


# -- script predicates ------------------------------------------------------

# Java's trim takes off every character up to U+0020, and in Java "$" also
# matches before a final line terminator; "\z" is the end of the string alone.
BLANK_CHARS = r"\x00-\x20"


def java_trim(c) -> Column:
    """Leading and trailing characters up to U+0020 removed."""
    return F.regexp_replace(col(c), rf"^[{BLANK_CHARS}]+|[{BLANK_CHARS}]+\z", "")


def not_blank(c) -> Column:
    """True if anything is left after :func:`java_trim` (null: null)."""
    return col(c).rlike(rf"[^{BLANK_CHARS}]")


def is_script(c, script_class: str = K.SCRIPT_CLASS_CJK) -> Column:
    """Single character lies in the script range."""
    return col(c).rlike(rf"^[{script_class}]\z")


def all_script(c, script_class: str = K.SCRIPT_CLASS_CJK, empty_is_true: bool = True) -> Column:
    """Every character lies in the script range.

    ``empty_is_true`` selects the fold variant (vacuously true for "");
    False selects the strict variant where null/blank strings are false.
    """
    c = col(c)
    if empty_is_true:
        return c.rlike(rf"^[{script_class}]*\z")
    return F.coalesce(c.rlike(rf"^[{script_class}]+\z") & not_blank(c), F.lit(False))


def replace_non_script(c, replacement: str, script_class: str = K.SCRIPT_CLASS_CJK) -> Column:
    """Map every character outside the script to one replacement char."""
    return F.regexp_replace(col(c), f"[^{script_class}]", replacement)


def replace_emoji(c, replacement: str, emoji_class: str = K.EMOJI_CLASS) -> Column:
    """Emoji and private-use characters -> replacement; null passes."""
    return F.regexp_replace(col(c), f"[{emoji_class}]", replacement)


def half_width(c) -> Column:
    """P10: full-width ASCII variants (U+FF01..U+FF5E) and the ideographic
    space -> their half-width forms."""
    full = "".join(chr(cp) for cp in range(0xFF01, 0xFF5F)) + "　"
    half = "".join(chr(cp) for cp in range(0x21, 0x7F)) + " "
    return F.translate(col(c), full, half)


def map_chars(c, source: str, target: str) -> Column:
    """P10 (variant table): character mapping supplied by the caller."""
    return F.translate(col(c), source, target)


def map_phrases(c, mapping: Mapping[str, str]) -> Column:
    """P10 for strings of several characters: from left to right, at each place the longest
    phrase that starts there is replaced, and reading goes on after it.  The mapping becomes
    one expression, so it is meant for tables of some thousand phrases."""
    phrases = sorted((p for p in mapping if p), key=lambda p: (-len(p), p))
    if not phrases:
        return col(c)
    starts = regex_escape_class("".join(sorted({p[0] for p in phrases})))
    literal = "|".join(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", p) for p in phrases)
    pieces = F.regexp_extract_all(col(c), F.lit(f"{literal}|[^{starts}]+|[\\s\\S]"), 0)
    table = F.create_map(*[F.lit(x) for p in phrases for x in (p, mapping[p])])
    return F.array_join(F.transform(pieces, lambda x: F.coalesce(F.try_element_at(table, x), x)), "")


def mask_chars(c, chars: str = K.STOP_CHARS, sep: str = ",") -> Column:
    """Every character of ``chars`` -> ``sep``."""
    return F.translate(col(c), chars, sep * len(chars))


# explicit classes (Java's \p{Punct} etc. are ASCII classes)
ASCII_PUNCT = r"!-/:-@\[-`{-~"
ASCII_ALNUM = r"0-9A-Za-z"
UNICODE_PUNCT = r"\p{P}"
BLANK = r" \t"
SPACE = r" \t\n\x0B\f\r"
CNTRL = r"\x00-\x1F\x7F"


def clean_classes(c, sep: str = ",", alnum: bool = True) -> Column:
    """Punctuation, (alnum), unicode punctuation, ideographic space,
    blank, space and control characters -> ``sep``."""
    cls = ASCII_PUNCT + (ASCII_ALNUM if alnum else "") + UNICODE_PUNCT + "　" + SPACE + CNTRL
    return F.regexp_replace(col(c), f"[{cls}]", sep)


def is_reduplication(c) -> Column:
    """More than one character, all the same."""
    c = col(c)
    return (F.length(c) > 1) & (F.size(F.array_distinct(F.split(c, ""))) == 1)


def strip_special(c, special: str = K.SPECIAL_KEY_CHARS) -> Column:
    """First tab field with special characters removed."""
    return F.regexp_replace(F.split(col(c), "\t").getItem(0), special, "")


def tail_concat(c, start: int = K.TAIL_FIELD_START) -> Column:
    """Comma-split, concatenate fields ``start``.. with no separator."""
    parts = F.split(col(c), ",")
    return F.array_join(F.slice(parts, start, F.greatest(F.size(parts) - (start - 1), F.lit(0))), "")


def reverse_str(c) -> Column:
    """Character reverse."""
    return F.reverse(col(c))


def is_alnum_only(c) -> Column:
    """ASCII letters/digits only after lower-casing (empty -> true)."""
    return F.lower(col(c)).rlike(r"^[a-z0-9]*\z")


def length_factor(c, center: float = K.LENGTH_CENTER, decay: float = K.LENGTH_DECAY) -> Column:
    """1 / exp(|len - center| * decay)."""
    return F.lit(1.0) / F.exp(F.abs(F.length(col(c)) - F.lit(center)) * F.lit(decay))


def first_marker_index(c, markers: Sequence[str]) -> Column:
    """Smallest 0-based index of any marker in the string, else -1."""
    c = col(c)
    idx = F.filter(
        F.transform(F.array(*[F.lit(m) for m in markers]), lambda m: F.instr(c, m) - 1),
        lambda i: i >= 0,
    )
    return F.coalesce(F.array_min(idx), F.lit(-1))


def contains_any(c, needles: Sequence[str]) -> Column:
    c = col(c)
    if not needles:
        return F.lit(False)
    out = None
    for n in needles:
        e = c.contains(n)
        out = e if out is None else (out | e)
    return out


def starts_with_any(c, prefixes: Sequence[str]) -> Column:
    c = col(c)
    if not prefixes:
        return F.lit(False)
    out = None
    for p in prefixes:
        e = c.startswith(p)
        out = e if out is None else (out | e)
    return out


def ends_with_any(c, suffixes: Sequence[str]) -> Column:
    c = col(c)
    if not suffixes:
        return F.lit(False)
    out = None
    for s in suffixes:
        e = c.endswith(s)
        out = e if out is None else (out | e)
    return out
