"""Quantities in texts: numbers, unit expressions and their dimensions.

A unit expression is parsed by a small grammar:

    expression := term (("/" | "per") term)*
    term       := factor+
    factor     := scale* [("square" | "cubic" | "sq" | "cu")] unit [power]
    scale      := a plain number | "k" | "thousand" | "million"
    power      := "^" integer | integer | a raised digit

Its value is a factor and an offset to canonical units and a vector of
exponents, one for each base dimension, so that "1000 sqft", "ft2" and "square
feet" have the same dimension as "acre", while "Gb/s" has another one than
"GB". Factors are exact fractions.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

DIMENSIONS = ("length", "time", "information", "mass", "temperature", "turns")
NONE = (0,) * len(DIMENSIONS)


def _dims(**exponents: int) -> tuple[int, ...]:
    return tuple(exponents.get(d, 0) for d in DIMENSIONS)


LENGTH, AREA, TIME, INFORMATION = _dims(length=1), _dims(length=2), _dims(time=1), _dims(information=1)
MASS, TEMPERATURE, TURNS = _dims(mass=1), _dims(temperature=1), _dims(turns=1)


@dataclass(frozen=True)
class Unit:
    """value in canonical units = value * factor + offset. Canonical are metre, second, byte, gram, kelvin, turn."""

    factor: Fraction
    dims: tuple[int, ...]
    offset: Fraction = Fraction(0)


FOOT = Fraction(3048, 10000)
ACRE = Fraction(43560) * FOOT * FOOT
BYTE = Fraction(1)

# The units by name, as (names, factor to the canonical unit, dimension, offset).
_UNITS = (
    ("m meter meters metre metres", Fraction(1), LENGTH, 0),
    ("km kilometer kilometers kilometre kilometres", Fraction(1000), LENGTH, 0),
    ("cm centimeter centimeters centimetre centimetres", Fraction(1, 100), LENGTH, 0),
    ("mm millimeter millimeters millimetre millimetres", Fraction(1, 1000), LENGTH, 0),
    ("in inch inches zoll pouce pouces", Fraction(254, 10000), LENGTH, 0),
    ("ft foot feet", FOOT, LENGTH, 0),
    ("yd yard yards", 3 * FOOT, LENGTH, 0),
    ("mi mile miles", 5280 * FOOT, LENGTH, 0),
    ("acre acres ac acre(s) acreage", ACRE, AREA, 0),
    ("ha hectare hectares hectare(s) hektar", Fraction(10000), AREA, 0),
    ("are ares", Fraction(100), AREA, 0),
    ("sf sqft", FOOT * FOOT, AREA, 0),
    ("sqm", Fraction(1), AREA, 0),
    ("sqyd", 9 * FOOT * FOOT, AREA, 0),
    ("sqmi", 640 * ACRE, AREA, 0),
    ("sqkm", Fraction(10**6), AREA, 0),
    ("s sec second seconds", Fraction(1), TIME, 0),
    ("ms millisecond milliseconds", Fraction(1, 1000), TIME, 0),
    ("min minute minutes", Fraction(60), TIME, 0),
    ("h hr hour hours", Fraction(3600), TIME, 0),
    ("day days", Fraction(86400), TIME, 0),
    ("g gram grams", Fraction(1), MASS, 0),
    ("kg kilogram kilograms", Fraction(1000), MASS, 0),
    ("lb lbs pound pounds", Fraction(45359237, 100000), MASS, 0),
    ("oz ounce ounces", Fraction(45359237, 1600000), MASS, 0),
    ("k kelvin", Fraction(1), TEMPERATURE, 0),
    ("°c celsius", Fraction(1), TEMPERATURE, Fraction(27315, 100)),
    ("°f fahrenheit", Fraction(5, 9), TEMPERATURE, Fraction(45967, 180)),
    ("rpm", Fraction(1, 60), _dims(turns=1, time=-1), 0),
    ("turn turns revolution revolutions", Fraction(1), TURNS, 0),
    ("gt transfers", Fraction(10**9), NONE, 0),
)
# Prefixes of amounts of information; (short name, long name, factor).
_DECIMAL = (("", "", 1), ("k", "kilo", 10**3), ("m", "mega", 10**6), ("g", "giga", 10**9), ("t", "tera", 10**12), ("p", "peta", 10**15))
_BINARY = (("ki", "kibi", 2**10), ("mi", "mebi", 2**20), ("gi", "gibi", 2**30), ("ti", "tebi", 2**40), ("pi", "pebi", 2**50))
# Words that scale the unit after them, and words that raise it.
_SCALES = {"k": 1000, "thousand": 1000, "tsd": 1000, "million": 10**6, "mio": 10**6}
_RAISING = {"sq": 2, "sq.": 2, "square": 2, "cu": 3, "cu.": 3, "cubic": 3}
_RAISED = {"²": 2, "³": 3}


def _catalogue() -> dict[str, Unit]:
    out = {name: Unit(factor, dims, Fraction(offset)) for names, factor, dims, offset in _UNITS for name in names.split()}
    for short, long, scale in (*_DECIMAL, *_BINARY):
        byte, bit = Unit(Fraction(scale), INFORMATION), Unit(Fraction(scale, 8), INFORMATION)
        out |= {f"{short}b": byte, f"{long}byte": byte, f"{long}bytes": byte, f"{long}bit": bit, f"{long}bits": bit, f"{short}bit": bit}
        if scale > 1:
            out |= {f"{short}o": byte, f"{long}octet": byte, f"{long}octets": byte}
    accents = {k.replace("mega", "méga").replace("tera", "téra"): v for k, v in out.items() if k.endswith(("octet", "octets"))}
    return out | accents


UNITS = _catalogue()
_BITS = re.compile(r"^(?:[KMGTPkmgtp]i?)b$")
#: A number: groups of three split by one mark, or digits with an optional fraction.
NUMBER = re.compile(r"(?<![\w.,])[+-]?(?:\d{1,3}(?:[, '’  ]\d{3})+(?:\.\d+)?(?!\d)|\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?(?!\d)|\d+(?:[.,]\d+)?|[.,]\d+)(?:\s*/\s*\d+(?=\s))?(?:[½¼¾])?|[½¼¾]")
_TOKEN = re.compile(r"\s*(?:(?P<number>\d+(?:\.\d+)?)|(?P<word>(?:sq|cu)\.|[°]?(?:(?![²³½¼¾])[^\W\d_])+(?:\(s\))?)|(?P<raised>[²³])|(?P<mark>[/^*·.\-]))")
_PARTS = {"½": Fraction(1, 2), "¼": Fraction(1, 4), "¾": Fraction(3, 4)}


def number(text: str) -> Fraction | None:
    """The value of a number as written: marks that group thousands, a decimal comma or point, simple fractions."""
    text = text.strip()
    extra = _PARTS.get(text[-1:], None)
    if extra is not None:
        text = text[:-1].strip()
        if not text:
            return extra
    over = 1
    if "/" in text:
        text, _, below = text.partition("/")
        over = int(below) or 1
    text = re.sub(r"[ '’  ]", "", text.strip())
    if re.fullmatch(r"[+-]?[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", text):
        text = text.replace(",", "")
    elif re.fullmatch(r"[+-]?\d{1,3}(?:\.\d{3}){2,}(?:,\d+)?", text):
        text = text.replace(".", "").replace(",", ".")
    else:
        text = text.replace(",", ".")
    try:
        return Fraction(text) / over + (extra or 0)
    except (ValueError, ZeroDivisionError):
        return None


def _unit_word(word: str) -> Unit | None:
    if _BITS.match(word) and word[0].isupper() != word[-1].isupper() and word[0].isupper():
        return Unit(UNITS[word.lower()].factor / 8, INFORMATION)  # "Gb" counts bits, "GB" and "gb" bytes
    return UNITS.get(word.lower())


def _factor(text: str, at: int) -> tuple[Unit, int] | None:
    """One factor from ``at``; the unit and where it ends."""
    scale, raise_ = Fraction(1), 1
    while m := _TOKEN.match(text, at):
        word = (m["word"] or "").lower()
        if m["number"]:
            scale, at = scale * Fraction(m["number"]), m.end()
        elif word in _RAISING and raise_ == 1:
            raise_, at = _RAISING[word], m.end()
        elif word in _SCALES and raise_ == 1 and (rest := _factor(text, m.end())):
            return Unit(rest[0].factor * _SCALES[word] * scale, rest[0].dims), rest[1]
        elif m["mark"] == "-" and scale == 1 and raise_ == 1:
            at = m.end()
        elif m["word"]:
            unit = _unit_word(m["word"])
            if unit is None:
                return None
            at = m.end()
            p = re.compile(r"\s*\^\s*([+-]?\d)|([23])(?!\d)|\s*([²³])").match(text, at)
            if p:
                raise_, at = raise_ * (int(p[1] or p[2]) if not p[3] else _RAISED[p[3]]), p.end()
            if raise_ == 1:
                return Unit(unit.factor * scale, unit.dims, unit.offset), at
            return Unit(unit.factor**raise_ * scale, tuple(d * raise_ for d in unit.dims)), at
        else:
            return None
    return None


def _expression(text: str, at: int) -> tuple[Unit, int] | None:
    """The longest unit expression from ``at``."""
    got = _factor(text, at)
    if not got:
        return None
    unit, at = got
    while m := re.compile(r"\s*(/|\bper\b|·|\*)\s*").match(text, at):
        more = _factor(text, m.end())
        if not more:
            break
        sign = 1 if m[1] in "·*" else -1
        unit = Unit(unit.factor * more[0].factor**sign, tuple(a + sign * b for a, b in zip(unit.dims, more[0].dims, strict=True)))
        at = more[1]
    return unit, at


@lru_cache(maxsize=4096)
def parse_unit(text: str) -> Unit | None:
    """The unit that the whole of ``text`` names, or None."""
    got = _expression(text.strip(), 0)
    return got[0] if got and not text.strip()[got[1] :].strip(" .") else None


@dataclass(frozen=True)
class Quantity:
    """A number with its unit, and where it stands in the text."""

    number: Fraction
    unit: Unit
    start: int
    end: int

    @property
    def value(self) -> Fraction:
        """In canonical units."""
        return self.number * self.unit.factor + self.unit.offset


def quantities(text: str) -> list[Quantity]:
    """Every number of ``text`` that a unit follows."""
    out, at = [], 0
    while m := NUMBER.search(text, at):
        value, got = number(m[0]), _expression(text, m.end())
        if value is not None and got and got[0].dims != NONE:
            out.append(Quantity(value, got[0], m.start(), got[1]))
            at = got[1]
        else:
            at = m.end()
    return out


def rounded(value: Fraction) -> int:
    """To the nearest integer, halves away from zero."""
    whole = (abs(value) * 2 + 1) // 2
    return int(whole if value >= 0 else -whole)
