"""Typed facts from titles, descriptions and tags, as Column expressions.

All patterns are fixed values. Word boundaries are written as ASCII
look-arounds, as the JVM's own boundary is Unicode-aware. An absent fact is
null, never false or empty, unless stated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinworks.functions.numbers import half_up, number, rendered
from skeinworks.functions.text import trim_all

_END = "(?![A-Za-z0-9_])"
_START = "(?<![A-Za-z0-9_])"
SQFT_PER_ACRE = 43_560.0


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _terabytes(value: Column, unit: Column) -> Column:
    return number(value) / F.when(F.upper(unit) == "GB", 1000.0).otherwise(1.0)


def capacity_tb(title: Column, stated: Column | None = None) -> Column:
    """Terabytes as text: a stated positive number first, else the first number with TB or GB in one case."""
    pattern = rf"([0-9]+(?:\.[0-9]+)?)\s*(TB|tb|GB|gb){_END}"
    of_title = rendered(_terabytes(F.regexp_extract(title, pattern, 1), F.regexp_extract(title, pattern, 2)))
    if stated is None:
        return of_title
    given = number(trim_all(stated))
    return F.coalesce(F.when(given > 0, rendered(given)), of_title)


def variant_capacity_tb(title: Column, option: Column, tags: Column, product_type: Column) -> Column:
    """Terabytes of a variant: its own title or option, else a capacity tag, else the path of the product type."""
    bare = rf"(?i){_START}([0-9]+(?:\.[0-9]+)?)\s*(TB|GB){_END}"

    def own(text: Column) -> Column:
        usable = F.when(F.lower(trim_all(text)) != "default title", text)
        return _terabytes(F.regexp_extract(usable, bare, 1), F.regexp_extract(usable, bare, 2))

    tag = r"(?i)^capacity:\s*([0-9]+(?:\.[0-9]+)?)\s*(TB|GB)$"
    tagged = F.try_element_at(F.filter(F.transform(tags, lambda t: _terabytes(F.regexp_extract(trim_all(t), tag, 1), F.regexp_extract(trim_all(t), tag, 2))), lambda v: v > 0), F.lit(1))
    path = r"(?i)>\s*([0-9]+(?:\.[0-9]+)?)\s*(TB|GB)\s*>"
    of_type = _terabytes(F.regexp_extract(product_type, path, 1), F.regexp_extract(product_type, path, 2))
    positive = lambda v: F.when(v > 0, v)
    first_tag = F.when(F.size(tags) > 0, tagged)
    return rendered(F.coalesce(positive(own(title)), positive(own(option)), first_tag, positive(of_type)))


def model_number(title: Column) -> Column:
    """The first model number of the known shapes, or empty."""
    shapes = (rf"({_START}ST[0-9]{{4,5}}[A-Z0-9]+{_END})", rf"({_START}WUH[0-9]+{_END})", rf"({_START}WD[0-9]+{_END})")
    return F.coalesce(*[found(title, s) for s in shapes], F.lit(""))


#: Condition codes, and words of a title in the order they are looked for.
CONDITION_CODES = {"1000": "new", "1500": "new", "2000": "refurb", "2010": "refurb", "2500": "refurb", "3000": "used", "7000": "parts"}
CONDITION_WORDS = (("parts", ("for parts", "as-is", "as is")), ("refurb", ("renewed", "refurbished", "recertified")), ("new", ("new",)), ("used", ("used",)))


def condition(code: Column, title: Column) -> Column:
    """The condition a code names, else the first that a word of the title names, else empty."""
    named = F.create_map(*[F.lit(x) for pair in CONDITION_CODES.items() for x in pair])[trim_all(F.coalesce(code, F.lit("")))]
    worded: Column = F.lit("")
    for name, words in reversed(CONDITION_WORDS):
        worded = F.when(F.coalesce(F.lower(title).rlike("|".join(words)), F.lit(False)), name).otherwise(worded)
    return F.coalesce(named, worded)


def feed_capacity_tb(*titles: Column) -> Column:
    """Terabytes as a double, from the first of several titles that states them."""
    return F.coalesce(*[number(F.regexp_extract(t, rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*TB{_END}", 1)) for t in titles])


def feed_condition(text: Column) -> Column:
    """refurb, used or new by words of title and tags; refurb where none is found."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words], F.lit(False))
    return F.when(has("refurb", "recert"), "refurb").when(has("used", "pull"), "used").when(has("new"), "new").otherwise("refurb")


def tagged_condition(tags: Column) -> Column:
    """Refurbished or Used by the first tag that says so, else New where any tag does, else empty."""
    low = F.transform(tags, lambda t: F.lower(t))
    said = F.transform(low, lambda t: F.when(F.contains(t, F.lit("refurbished")) | F.contains(t, F.lit("recertified")), "Refurbished").when(F.contains(t, F.lit("used")), "Used"))
    named = F.filter(said, lambda s: s.isNotNull())
    return F.when(F.size(named) > 0, F.try_element_at(named, F.lit(1))).when(F.exists(low, lambda t: F.contains(t, F.lit("new"))), "New").otherwise("")


def tag_value(tags: Column, prefix: str) -> Column:
    """What follows ``prefix`` in the first tag that begins with it, in any case, and has something there."""
    p = F.lit(prefix.lower())
    values = F.transform(F.filter(tags, lambda t: F.startswith(F.lower(trim_all(t)), p)), lambda t: trim_all(F.substring(trim_all(t), len(prefix) + 1, 10**6)))
    return F.try_element_at(F.filter(values, lambda v: v != ""), F.lit(1))


def without_suffix(sku: Column, suffixes: list[str]) -> Column:
    """A stock number without the first of ``suffixes`` it ends in, in any case."""
    plain = trim_all(sku)
    out = None
    for s in suffixes:
        hit, cut = F.endswith(F.upper(plain), F.lit(s.upper())), F.left(plain, F.length(plain) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return trim_all(plain if out is None else out.otherwise(plain))


def acreage(text: Column, stated: Column | None = None) -> Column:
    """Acres as text: a stated positive number, else acres, else ac, else square feet to two decimals."""
    acres = F.regexp_extract(text, rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*acres?{_END}", 1)
    short = F.regexp_extract(text, rf"(?i)([0-9]+(?:\.[0-9]+)?)\s*ac{_END}", 1)
    feet = number(F.regexp_replace(F.regexp_extract(text, rf"(?i)([0-9][0-9,]*)\s*(?:sq\.?\s*ft|sqft|square\s+feet){_END}", 1), ",", ""))
    from_feet = half_up(feet / SQFT_PER_ACRE * 100) / 100
    of_text = F.coalesce(rendered(number(acres)), rendered(number(short)), rendered(from_feet))
    if stated is None:
        return of_text
    given = number(trim_all(stated))
    return F.coalesce(F.when(given > 0, rendered(given)), of_text)


def acres(value: Column, unit: Column) -> Column:
    """A measured area in acres; square feet where the unit is blank, null where it is unknown."""
    u = F.lower(trim_all(F.coalesce(unit, F.lit(""))))
    return F.when(value > 0, F.when(u.isin("acres", "acre", "ac"), value).when(u.isin("sqft", "square feet", "sq ft", "sf", ""), value / SQFT_PER_ACRE))


#: Facts of a description that a phrase gives.
FLAGS = {
    "well": rf"(?i){_START}well{_END}",
    "septic": rf"(?i){_START}septic{_END}",
    "fixer": rf"(?i){_START}(?:fixer|teardown|tear-down|handyman|as-is|as is){_END}",
    "manufactured": rf"(?i){_START}(?:manufactured|mobile\s+home|modular){_END}",
    "owner_financing": rf"(?i){_START}(?:owner|seller)\s+financ",
}


def flags(text: Column) -> Column:
    """A map with ``true`` for every fact the text gives, and nothing for the others."""
    pairs = [x for name, pattern in FLAGS.items() for x in (F.lit(name), F.when(text.rlike(pattern), F.lit("true")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def parcel_number(text: Column) -> Column:
    """The parcel number after its label, or empty."""
    return F.coalesce(found(text, rf"(?i){_START}APN[:#]?\s*([0-9][0-9\-]{{4,}})"), F.lit(""))


def absolute_url(url: Column, host: str) -> Column:
    """A link with its host; empty stays empty."""
    plain = trim_all(F.coalesce(url, F.lit("")))
    return F.when((plain == "") | plain.startswith("http://") | plain.startswith("https://"), plain).when(plain.startswith("/"), F.concat(F.lit(host), plain)).otherwise(F.concat(F.lit(host + "/"), plain))


def tier(value: Column, bounds: list[tuple[float, str]], below: str) -> Column:
    """The name of the first lower bound that ``value`` reaches; null for null."""
    out = F.when(value.isNull(), F.lit(None))
    for bound, name in bounds:
        out = out.when(value >= bound, name)
    return out.otherwise(below)


def labelled(value: Column, groups: dict[str, tuple[str, ...]], other: str | None = None) -> Column:
    """The name of the group that holds ``value``; ``other`` for any other text, null for a blank one."""
    plain = trim_all(value)
    out = F.when(F.coalesce(plain, F.lit("")) == "", F.lit(None))
    for name, members in groups.items():
        out = out.when(plain.isin(*members), name)
    return out.otherwise(F.lit(other))


def instant(text: Column) -> Column:
    """The moment an ISO 8601 text names: with or without fraction, with Z, an offset or neither (then UTC)."""
    layouts = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd")
    return F.coalesce(*[F.try_to_timestamp(trim_all(text), F.lit(layout)) for layout in layouts])


def whole_days(since: Column, now: Column) -> Column:
    """Full days from a moment to ``now``; null where it lies ahead."""
    days = F.floor((F.unix_micros(now) - F.unix_micros(since)) / 86_400_000_000)
    return F.when(since <= now, days)


def placed(lat: Column, lon: Column) -> Column:
    """Whether two texts or numbers are a usable coordinate: both non-zero and in range."""
    y, x = number(trim_all(lat.cast("string"))), number(trim_all(lon.cast("string")))
    return F.coalesce((y != 0) & (x != 0) & F.abs(y).between(0, 90) & F.abs(x).between(0, 180), F.lit(False))
