"""Numeric coercion where every unusable value becomes NULL."""
from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F, types as T

from ..fixed_values import FLOOR_CODES

# Whitespace as Python's str.strip sees it; Java's \s is narrower.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"


def is_finite(c: Column) -> Column:
    """True only for a present, ordinary number (never NULL itself)."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def coerce_numeric(c: Column, dtype: T.DataType) -> Column:
    """Number, numeric text or boolean to DOUBLE; anything else and NaN to NULL."""
    if isinstance(dtype, T.StringType):
        return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return nan_to_null(c.cast("double"))
    return F.lit(None).cast("double")


def strip(c: Column) -> Column:
    """Trim every Unicode space from both ends."""
    return F.regexp_replace(c, f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


@lru_cache
def _decimal_digits() -> tuple[str, str]:
    pairs = [(chr(i), str(unicodedata.decimal(chr(i)))) for i in range(128, sys.maxunicode + 1)
             if unicodedata.decimal(chr(i), None) is not None]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def parse_floor(c: Column) -> Column:
    """Floor code or integer text to DOUBLE; '2.0' and unknown codes are NULL."""
    text = F.lower(strip(c))
    ascii_text = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, *_decimal_digits())).otherwise(text)
    codes = F.lit(None).cast("double")
    for code, floor in FLOOR_CODES.items():
        codes = F.when(text == code, F.lit(float(floor))).otherwise(codes)
    integer = F.when(ascii_text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"),
                     F.replace(ascii_text, F.lit("_"), F.lit("")).try_cast("double"))
    return F.coalesce(codes, integer)
