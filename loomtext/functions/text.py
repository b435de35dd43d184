"""Column functions over text: identity, hashes, token estimates, byte and UTF-16 limits, redaction."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The white space of ECMAScript, CJK ranges of the estimator, and its two weights.
JS_SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
CJK = "[\\u3400-\\u9FFF\\uF900-\\uFAFF]"
CJK_TOKENS, WORD_TOKENS = 1.15, 1.3
NUL = "\0"


def nul_joined(*parts: Column) -> Column:
    return F.concat_ws(NUL, *[p.cast("string") for p in parts])


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix:`` and 24 hex digits of the SHA-256 of the NUL-joined parts."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha2(nul_joined(*parts), 256), 1, 24))


def identity_hash(*parts: Column) -> Column:
    return F.sha2(nul_joined(*parts), 256)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{JS_SPACE}]+|[{JS_SPACE}]+$", "")


def lines_of(c: Column) -> Column:
    """Lines after CRLF and CR have become LF."""
    return F.split(F.regexp_replace(c, "\\r\\n?", "\n"), "\n", -1)


def estimate_tokens(c: Column) -> Column:
    """max(1, ceil(1.15 * CJK characters + 1.3 * other words)), in binary doubles."""
    cjk = F.regexp_count(c, F.lit(CJK)).cast("double")
    words = F.size(F.filter(F.split(F.regexp_replace(c, CJK, " "), f"[{JS_SPACE}]+"), lambda w: w != "")).cast("double")
    return F.greatest(F.lit(1), F.ceil(cjk * F.lit(CJK_TOKENS) + words * F.lit(WORD_TOKENS))).cast("long")


def fold_ascii(c: Column) -> Column:
    """Lower case for A to Z only, as SQLite's LIKE compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def contains_folded(c: Column, needle: str | Column) -> Column:
    """A literal substring test without regard to ASCII case; wildcard characters mean themselves."""
    needle = F.lit(needle) if isinstance(needle, str) else needle
    return F.contains(fold_ascii(c), fold_ascii(needle))


def truncate_utf8(c: Column, limit: int) -> Column:
    """The longest prefix of whole code points with at most ``limit`` UTF-8 bytes."""
    keep = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(limit)), lambda i: F.octet_length(F.left(c, i)) <= limit))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.left(c, keep))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def over_limit(c: Column, code_points: int) -> Column:
    return F.length(c) > code_points


def escape_markdown(c: Column) -> Column:
    """Markdown's active characters with a backslash, line breaks as spaces."""
    return F.regexp_replace(F.regexp_replace(c, "([\\\\`*_{}\\[\\]()#+.!|<>-])", "\\\\$1"), "\\s*[\\r\\n]+\\s*", " ")


def clean_label(c: Column, limit: int = 80) -> Column:
    return F.left(js_trim(F.regexp_replace(c, "[\\x00-\\x1F\\x7F]+", " ")), F.lit(limit))


def redacted(c: Column) -> Column:
    """Type, length in code points and SHA-256 of a string that must not be shown."""
    return F.struct(F.lit("string").alias("type"), F.length(c).cast("long").alias("length"), F.sha2(c, 256).alias("sha256"))


def snapshot_hash(refs: Column, hashes: Column) -> Column:
    """Aggregate: SHA-256 of the sorted ``ref:hash`` lines."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", refs, hashes))), "\n"), 256)


def normal_name(value: str) -> str:
    return unicodedata.normalize("NFC", value).strip("\t\n\x0b\f\r \xa0     　﻿" + "".join(map(chr, range(0x2000, 0x200B)))).lower()


@F.pandas_udf(StringType())
def _normal_names(names: pd.Series) -> pd.Series:
    return names.map(normal_name, na_action="ignore")


def normalize_name(c: Column) -> Column:
    """NFC, trimmed, lower case; ASCII names, nearly all, stay in the JVM."""
    return F.when(c.rlike("^[\\x00-\\x7F]*$"), F.lower(js_trim(c))).otherwise(_normal_names(c))


def utf16_slice(value: str, start: int, end: int) -> str:
    """``value[start:end]`` in UTF-16 units; half a surrogate pair at either end is left out."""
    return value.encode("utf-16-le")[2 * start : 2 * end].decode("utf-16-le", "ignore") if any(c > "￿" for c in value) else value[start:end]


def utf16_size(value: str) -> int:
    return len(value) + sum(c > "￿" for c in value)
