"""Numbers in texts, and texts of numbers, as Column expressions.

Null in, null out, unless stated; nothing raises under ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A decimal number and nothing else: no blanks, no suffix, no NaN or infinity.
PLAIN = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"


def number(text: Column) -> Column:
    """The double a text holds; null where it is not a plain decimal number.

    ``text`` occurs once in the expression, so that chains of such functions
    don't grow with every step.
    """
    return F.regexp_extract(text, PLAIN, 0).try_cast("double")


def rendered(value: Column) -> Column:
    """A double in its shortest decimal form, without trailing zeros; below a millionth with an exponent."""
    digits = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), "^0E-18$", "0")
    return F.regexp_replace(F.regexp_replace(digits, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def half_up(value: Column) -> Column:
    """The nearest bigint, halves away from zero."""
    return F.round(value).try_cast("bigint")


def cents_truncated(text: Column) -> Column:
    """Minor units of a decimal text: digits beyond two are cut. Null where it is no price."""
    plain = F.trim(text)
    plain = F.when(plain.rlike(r"^-?[0-9]*(?:\.[0-9]*)?$") & plain.rlike("[0-9]"), plain)
    whole = F.coalesce(F.nullif(F.regexp_extract(plain, r"^-?([0-9]*)", 1), F.lit("")), F.lit("0")).try_cast("bigint")
    part = F.rpad(F.substring(F.regexp_extract(plain, r"\.([0-9]*)$", 1), 1, 2), 2, "0").try_cast("bigint")
    return F.when(plain.startswith("-"), -(whole * 100 + part)).otherwise(whole * 100 + part)


def cents_rounded(value: Column) -> Column:
    """Minor units of a double, rounded half up; 0, for unknown, where it is null, not finite or not positive."""
    usable = value.isNotNull() & ~F.isnan(value) & (value > 0) & (value < 9e15)
    return F.when(usable, F.floor(value * 100 + 0.5).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
