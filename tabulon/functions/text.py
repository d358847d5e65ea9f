"""Text normalisation as Column expressions: cleaning, script folding, slugs, keys, similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as scripts on the web know it: Unicode's, with the byte order mark and without U+0085.
BLANK = r"[\t\n\x0B\f\r    -     　﻿]"
WORD = "[A-Za-z0-9_]"
LEFT, RIGHT = f"(?<!{WORD})", f"(?!{WORD})"

_PAIRS = dict(zip("љњђџ", ("lj", "nj", "dj", "dz")))
_CYRILLIC = "абвгдежзијклмнопрстћуфхцчш"
_LATIN = "abvgdezzijklmnoprstcufhccs"


def _decomposed() -> dict[str, str]:
    """Letters that are a base letter and marks, by what is left without the marks, over the scripts expected."""
    out = {}
    for c in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        bare = "".join(x for x in unicodedata.normalize("NFD", chr(c)) if not 0x300 <= ord(x) <= 0x36F)
        if bare != chr(c) and len(bare) == 1:
            out[chr(c)] = bare
    return out


_MARKS = _decomposed()
#: Cyrillic letters and letters with marks, to what is left of them.
_FOLDED = dict(zip(_CYRILLIC, _LATIN)) | {k: dict(zip(_CYRILLIC, _LATIN)).get(v, v) for k, v in _MARKS.items()}
LOOKALIKES = dict(zip("ТГІILЗ56ABCO", "11111" + "3" + "ББАБЦ0"))


def clean_text(c: Column) -> Column:
    """Runs of white space, no-break spaces among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, BLANK + "+", " "))


def strip_marks(c: Column) -> Column:
    """Letters without their diacritics; letters that aren't composed, such as the Latin d with stroke, stay."""
    return F.regexp_replace(F.translate(c, "".join(_MARKS), "".join(_MARKS.values())), "[\\u0300-\\u036F]", "")


def latin_search_text(c: Column) -> Column:
    """Cleaned lower-case text with Cyrillic letters in Latin and no diacritics. ASCII texts are done after cleaning; the text is bound once, so that what is built on this isn't computed again for each use."""

    def fold(plain: Column) -> Column:
        out = plain
        for letter, two in _PAIRS.items():
            out = F.replace(out, F.lit(letter), F.lit(two))
        return F.regexp_replace(F.translate(out, "".join(_FOLDED), "".join(_FOLDED.values())), "[\\u0300-\\u036F]", "")

    return once(F.lower(clean_text(c)), lambda plain: F.when(plain.rlike("[^\\x00-\\x7F]"), fold(plain)).otherwise(plain))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def slugify(c: Column) -> Column:
    joined = F.regexp_replace(F.replace(latin_search_text(c), F.lit("đ"), F.lit("dj")), "[^a-z0-9]+", "-")
    return F.regexp_replace(joined, "^-|-$", "")


def or_null(c: Column) -> Column:
    """NULL for the empty string that a regular expression gives where it doesn't match."""
    return F.nullif(c, F.lit(""))


def clean_recognized(c: Column) -> Column:
    """Text from character recognition, without stray bars and punctuation around it."""
    bars = F.regexp_replace(F.regexp_replace(c, BLANK + "+", " "), "[|¦!]", " ")
    loose = "".join(("\\s", "_~`", "\"'", "\\^", ":;", ".,"))
    ends = F.regexp_replace(F.regexp_replace(bars, f"^[{loose}-]+", ""), f"[{loose}]+$", "")
    return clean_text(ends)


def canonical_group(c: Column) -> Column:
    """Upper case, with letters and digits that look alike as one."""
    return F.translate(F.upper(c), "".join(LOOKALIKES), "".join(LOOKALIKES.values()))


def explicit_room(c: Column) -> Column:
    """A room named by its kind, such as a hall and its number; NULL without one."""
    kinds = "|".join(("сала", "лабораторија", "лаб", "амфитеатар", "учионица"))
    pattern = f"(?iu)({kinds})\\s*[:.]?\\s*([0-9\\p{{L}}]{{1,6}})"
    return or_null(clean_text(F.concat_ws(" ", F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2))))


def letter_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\p{L}"))


def note_in_parens(c: Column) -> Column:
    return F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def tokens(c: Column) -> Column:
    """Distinct lower-case words of letters and digits, as a simple full-text index has them."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1))


def trigrams(c: Column) -> Column:
    """Distinct three-letter pieces of each word, padded by two spaces before and one after it."""
    pad = F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    cut = F.transform(pad, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(cut))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all; 0 where neither has any."""
    x, y = trigrams(a), trigrams(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)
