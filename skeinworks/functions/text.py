"""Text functions as Column expressions."""

from __future__ import annotations

from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points counted as white space at the ends of a text.
BLANKS = r"[\s\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"

#: The same code points, for trimming.
BLANK_CHARACTERS = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200C))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


def trim_all(text: Column | str) -> Column:
    """``text`` without white space of any kind at its ends; null stays null."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def tokens(text: Column) -> Column:
    """The distinct lower-case ASCII words of at least two characters, in order of first use. Null gives null."""
    return F.filter(F.array_distinct(F.split(F.lower(text), "[^a-z0-9]+")), lambda t: F.length(t) >= 2)


def contains_text(title: Column, words: Column | None, query: str) -> Column:
    """Whether ``query`` is, regardless of case, part of the title or of one word; its characters are all literal."""
    q = F.lit(query.lower())
    hit = F.coalesce(F.contains(F.lower(title), q), F.lit(False))
    return hit if words is None else hit | F.coalesce(F.exists(words, lambda w: F.contains(F.lower(w), q)), F.lit(False))


def stripped_html(html: Column) -> Column:
    """Text without tags, entities resolved, blanks collapsed.

    The common entities are resolved in the JVM. What holds others goes to
    Python, and only that: the texts without any are null there.
    """

    @F.pandas_udf("string")
    def unescaped(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unescape(t) if isinstance(t, str) else t)

    bare = F.regexp_replace(html, r"(?s)<[^>]*>", " ")
    plain = bare
    for name, character in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", "\u00a0"), ("amp", "&")):
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(character))
    common = F.regexp_replace(bare, "&(?:lt|gt|quot|#39|nbsp|amp);", "")
    rare = F.contains(common, F.lit("&"))
    return trim_all(F.regexp_replace(F.coalesce(unescaped(F.when(rare, bare)), plain), f"{BLANKS}+", " "))


def dollars(cents: Column) -> Column:
    """``$12.34``; a dash for an unknown price."""
    return F.when(cents > 0, F.format_string("$%.2f", cents / 100.0)).otherwise("-")


def dollars_per(cents: Column, amount: Column) -> Column:
    """``$12.34`` for one of ``amount`` (a text or number); a dash where price or amount is unknown."""
    n = amount.cast("string").try_cast("double")
    return F.when((cents > 0) & (n > 0), F.format_string("$%.2f", cents / 100.0 / n)).otherwise("-")


def first_filled(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(trim_all(t) != "", t) for t in texts])


def shortened(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last three of them dots where something was cut and there is room for them. No character is cut in two."""
    if length <= 3:
        return F.substring(text, 1, length)
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 3), F.lit("..."))).otherwise(text)
