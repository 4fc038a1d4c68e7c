"""Keys that identify and group listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def listing_id(source_id: Column, source_key: Column) -> Column:
    """16 hexadecimal digits of the SHA-256 of both parts with a zero byte between."""
    return F.substring(F.sha2(F.concat(source_id, F.char(F.lit(0)), source_key), 256), 1, 16)


def squeezed(text: Column) -> Column:
    """Lower-case ASCII letters and digits only; null becomes empty."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def product_key(mpn: Column, brand: Column, model: Column) -> Column:
    """``mpn:<part>``, else ``bm:<brand>:<model>`` where both are known, else empty, which is no group."""
    part, make, kind = squeezed(mpn), squeezed(brand), squeezed(model)
    return F.when(part != "", F.concat(F.lit("mpn:"), part)).when((make != "") & (kind != ""), F.concat(F.lit("bm:"), make, F.lit(":"), kind)).otherwise(F.lit(""))
