"""Measured quantities in canonical units.

The grammar of :mod:`skeinworks.functions.units` reads a value that stands
beside its unit, a unit that only a text names, or both in one text. Python
sees each distinct unit text once and gives its scale as a fraction; the rows
are joined to the scales and their values scaled in decimals in the JVM.

Defined results: an unknown unit, another dimension, a value that is missing,
not finite or not positive gives null; a text is read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from skeinworks.functions import units
from skeinworks.functions.text import trim_all

#: Words beside an amount of information that make it something else than a capacity, and words that make it a range.
OTHER_USE = re.compile(r"\b(?:cache|buffer|puffer|tampon|dram|ram)\b", re.I)
RANGE = re.compile(r"\b(?:under|below|over|above|up\s+to|less\s+than|more\s+than|at\s+least|at\s+most|from|unter|über|ab|bis|moins\s+de|plus\s+de|and\s+(?:greater|over|above|up|more|larger|bigger|under|below|less|smaller)|or\s+(?:greater|over|above|more|larger|bigger|under|below|less|smaller))\b|[<>≤≥]\s*\d|\d\s*\+", re.I)
#: Marks between the values of a text; hyphen and slash only with blanks around them, a comma not between digits.
SEPARATOR = re.compile(r"->|::|[|;»>\n\r\t]|\s[-–/]\s|(?<!\d),|,(?!\d)")


def stated_capacity(text: str | None) -> Fraction | None:
    """The capacity in bytes that ``text`` states as one of its values: no cache, no speed, no range."""
    for value in SEPARATOR.split(text or ""):
        if OTHER_USE.search(value):
            continue
        found = [q for q in units.quantities(value) if q.unit.dims == units.INFORMATION and q.number > 0]
        if len(found) == 1 and not RANGE.search(value):
            return found[0].value
    return None


def _read_texts(texts: DataFrame, columns: list[str], schema: str, read) -> DataFrame:
    """The distinct rows of ``texts`` with what ``read`` makes of each, those without a result left out: the only part in Python."""
    kinds = to_arrow_schema(texts.select(*columns).schema)
    made = to_arrow_schema(texts.sparkSession.createDataFrame([], schema).schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            got = [(*r, *x) for r in rows if (x := read(*r)) is not None]
            fields = [*kinds, *made]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*got) if got else [[]] * len(fields), fields, strict=True)], names=[f.name for f in fields])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.select(*columns).schema)
    return texts.select(*columns).distinct().mapInArrow(each, f"{names}, {schema}")


#: Values from here on are in no unit that is meant; amounts stay within a bigint.
LARGEST = 1e13


def _scaled(value: Column, over: Column, under: Column) -> Column:
    """value * over / under rounded to the nearest integer, halves up, in decimals: exact for values of up to ten decimal places."""
    product = F.try_multiply(value.cast("string").try_cast("decimal(24,10)"), over.cast("decimal(14,0)"))
    whole = F.floor(product.cast("double") / under.cast("double")).try_cast("decimal(18,0)")
    rest = product - F.try_multiply(whole, under.cast("decimal(14,0)"))
    # The quotient of doubles may be off by one next to an integer.
    off = F.when(rest < 0, F.lit(-1)).when(rest >= under, F.lit(1)).otherwise(F.lit(0))
    left = rest - F.try_multiply(off.cast("decimal(2,0)"), under.cast("decimal(14,0)"))
    return (whole + off + F.when(left * 2 >= under, F.lit(1)).otherwise(F.lit(0))).try_cast("bigint")


def amounts(rows: DataFrame, key: str, value: Column, unit: Column, text: Column, dims: tuple[int, ...], target: Fraction) -> DataFrame:
    """(key, amount): the rows' values in multiples of ``target``, rounded; rows without a known unit or a positive value are left out.

    Each distinct unit text is read once; the numbers are scaled in the JVM. A
    blank unit is looked for in ``text``; where the value is null, the unit may
    hold number and unit.
    """
    v, u = F.col("_v"), trim_all(F.coalesce(F.col("_u"), F.lit("")))
    base = rows.select(F.col(key).alias("_key"), value.cast("double").alias("_v"), unit.cast("string").alias("_u"), text.cast("string").alias("_t"))
    # The number that a text begins with doesn't matter for its unit.
    named = F.regexp_replace(F.coalesce("_t", F.lit("")), r"^\s*[0-9][0-9.,]*", "1")
    base = base.where(v.isNull() | ((v > 0) & (v < LARGEST)))
    base = base.select("_key", "_v", F.when(v.isNull(), "whole").when(u != "", "unit").otherwise("named").alias("_mode"), F.when(v.isNull() | (u != ""), u).otherwise(named).alias("_text")).where("_text <> ''")

    def read(mode: str, words: str) -> tuple[int | None, int | None, int | None] | None:
        if mode == "whole":
            q = next((q for q in units.quantities(words) if q.unit.dims == dims), None)
            amount = units.rounded(q.value / target) if q and q.number > 0 else None
            return (None, None, amount) if amount is not None and amount < 2**63 else None
        found = units.parse_unit(words) if mode == "unit" else next((q.unit for q in units.quantities(words) if q.unit.dims == dims), None)
        if found is None or found.dims != dims or found.offset:
            return None
        scale = found.factor / target
        if max(scale.numerator, scale.denominator) >= 10**14:
            scale = scale.limit_denominator(10**12)
        return (scale.numerator, scale.denominator, None) if 0 < scale.numerator < 10**14 else None

    known = _read_texts(base, ["_mode", "_text"], "_over bigint, _under bigint, _amount bigint", read)
    amount = F.coalesce("_amount", _scaled(v, F.col("_over"), F.col("_under")))
    return base.join(known, ["_mode", "_text"]).select(F.col("_key").alias(key), amount.alias("amount")).where("amount is not null")


def gigabytes(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, amount): gigabytes of the capacity that a row's text states, rounded; each distinct text is read once."""

    def read(words: str) -> tuple[int] | None:
        got = stated_capacity(words)
        return None if got is None or got >= 2**63 else (units.rounded(got / 10**9),)

    base = rows.select(F.col(key).alias("_key"), text.cast("string").alias("_text")).where("_text is not null")
    return base.join(_read_texts(base, ["_text"], "amount bigint", read), "_text").select(F.col("_key").alias(key), "amount")
