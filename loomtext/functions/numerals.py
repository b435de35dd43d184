"""Chapter numbers: digits, Chinese numerals below a thousand, canonical Roman numerals; and evaluator numerals.

Every numeral is one written form of a fixed grammar, so a column expression reads it by extracting the form's parts;
nothing leaves the JVM.  The scalar functions state the same grammar for single values on the driver.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
HAN_DIGITS = {"零": 0, "〇": 0, "○": 0, "Ｏ": 0, "０": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
HAN_CHAPTER = "第\\s*([零〇○Ｏ０一二三四五六七八九十百两\\d]+)\\s*(?:章|回|节)"
LATIN_CHAPTER = "chapter\\s+(\\d+|[ivxlcdm]+)"
CHAPTER_LINE = "(?i)^(?:第([零〇○Ｏ０一二三四五六七八九十两百\\d]+)(?:章|回|节)|chapter\\s+(\\d+|[ivxlcdm]+))(?:\\s+.*)?$"
BARE_NUMBER = "(?:第\\s*)?(\\d+)\\s*(?:章|chapter)?"
ROMAN_VALUES = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}
EVALUATOR_DIGITS, EVALUATOR_UNITS = "零一两二三四五六七八九", {"十": 10, "百": 100, "千": 1000}

_D = "[" + "".join(HAN_DIGITS) + "]"
# One row for each written form: its pattern, and what its groups are worth (weight, and the digit an empty group stands for).
_FORMS = (
    (f"^({_D})$", ((1, 0),)),
    (f"^({_D}?)十({_D}?)$", ((10, 1), (1, 0))),
    (f"^({_D}?)百$", ((100, 1),)),
    (f"^({_D}?)百零({_D})$", ((100, 1), (1, 0))),
    (f"^({_D}?)百({_D})$", ((100, 1), (1, 0))),
    (f"^({_D}?)百({_D}?)十({_D}?)$", ((100, 1), (10, 1), (1, 0))),
)
_ROMAN = "^(?=.)m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$"


def _rest_counts(weights: tuple[tuple[int, int], ...]) -> bool:
    """Behind a written hundred something other than nought has to follow."""
    return weights[0][0] == 100 and len(weights) > 1


def chapter_number(text: str) -> int | None:
    if re.fullmatch("[0-9]+", text):
        return int(text)
    for pattern, weights in _FORMS:
        if m := re.match(pattern, text):
            parts = [w * HAN_DIGITS.get(g, d) for g, (w, d) in zip(m.groups(), weights, strict=True)]
            return None if _rest_counts(weights) and not sum(parts[1:]) else sum(parts)
    if not re.match(_ROMAN, text.lower()):
        return None
    values = [ROMAN_VALUES[c] for c in text.lower()]
    return sum(v if v >= after else -v for v, after in zip(values, [*values[1:], 0], strict=True))


def chapter_of(title: str) -> int | None:
    """The chapter number that a title states, if it does."""
    for pattern, number in ((HAN_CHAPTER, chapter_number), ("(?i)" + LATIN_CHAPTER, chapter_number), ("(?i)" + BARE_NUMBER, int)):
        if (m := re.search(pattern, title)) and (n := number(m[1])):
            return n
    return None


_TERM = f"([{EVALUATOR_DIGITS}]*)([{''.join(EVALUATOR_UNITS)}]?)"


def evaluator_number(text: str) -> int | None:
    """Digits, or a Chinese numeral with thousands: the sum of its terms, a digit times the unit behind it (or the unit)."""
    if re.fullmatch("[0-9]+", text):
        return int(text)
    if not re.fullmatch(f"(?:{_TERM})*", text):
        return None
    return sum(max(HAN_DIGITS.get(d[-1:], 0), 1 if u else 0) * EVALUATOR_UNITS.get(u, 1) for d, u in re.findall(_TERM, text))


def _digit(c: Column, empty: int) -> Column:
    values = F.create_map(*[F.lit(x) for pair in HAN_DIGITS.items() for x in pair])
    return F.when(c == "", F.lit(empty)).otherwise(F.element_at(values, c))


def _written(c: Column, pattern: str, weights: tuple[tuple[int, int], ...]) -> Column:
    parts = [_digit(F.regexp_extract(c, pattern, k + 1), empty) * weight for k, (weight, empty) in enumerate(weights)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.when(total > parts[0], total) if _rest_counts(weights) else total


def chapter_number_col(c: Column) -> Column:
    """The number a numeral means; null if it is none."""
    out = F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int"))
    for pattern, weights in _FORMS:
        out = out.when(c.rlike(pattern), _written(c, pattern, weights))
    values = F.create_map(*[F.lit(x) for pair in ROMAN_VALUES.items() for x in pair])
    each = F.transform(F.split(F.lower(c), ""), lambda x: F.element_at(values, x))
    signed = F.zip_with(each, F.slice(F.concat(each, F.array(F.lit(0))), 2, F.size(each)), lambda v, after: F.when(v >= after, v).otherwise(-v))
    return out.when(F.lower(c).rlike(_ROMAN), F.aggregate(signed, F.lit(0), lambda s, v: s + v)).cast("int")


def chapter_of_col(title: Column) -> Column:
    han, latin = chapter_number_col(F.regexp_extract(title, HAN_CHAPTER, 1)), chapter_number_col(F.regexp_extract(title, "(?i)" + LATIN_CHAPTER, 1))
    bare = F.regexp_extract(title, "(?i)" + BARE_NUMBER, 1)
    number = F.when(F.length(bare).between(1, 9), bare.cast("int"))
    return F.coalesce(*[F.when(n > 0, n) for n in (han, latin, number)])


def evaluator_number_col(c: Column) -> Column:
    """:func:`evaluator_number` of a column."""
    digits = F.create_map(*[F.lit(x) for d in EVALUATOR_DIGITS for x in (d, HAN_DIGITS[d])])
    units = F.create_map(*[F.lit(x) for pair in EVALUATOR_UNITS.items() for x in pair])

    def term(d: Column, u: Column) -> Column:
        digit, unit = F.element_at(digits, F.right(d, F.lit(1))), F.element_at(units, u)
        return F.greatest(F.coalesce(digit, F.lit(0)), F.when(unit.isNotNull(), 1).otherwise(0)) * F.coalesce(unit, F.lit(1))

    terms = F.zip_with(F.regexp_extract_all(c, F.lit(_TERM), 1), F.regexp_extract_all(c, F.lit(_TERM), 2), term)
    return F.when(c.rlike("^[0-9]{1,9}$"), c.cast("int")).when(c.rlike(f"^(?:{_TERM})*$"), F.aggregate(terms, F.lit(0), lambda s, x: s + x))
