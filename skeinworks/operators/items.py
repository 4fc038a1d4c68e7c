"""The latest row of each item, and queries over it.

Rows arrive in an order given by one or more columns; the last arrival of an
id replaces the ones before it. All operators take and return DataFrames.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.text import contains_text, trim_all


def latest(rows: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """The last arrival of each key, all columns from that row.

    The group limit is taken in every input partition before the shuffle, so
    that a key with very many rows sends one row from each. Null keys are left
    out; of equal arrivals, the content of the rows decides.
    """
    content = F.xxhash64(*[c for c, kind in rows.dtypes if "map<" not in kind])
    last = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(c) for c in arrival], content)
    return rows.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")


def replaced(current: DataFrame, batch: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    """``current`` with the rows of ``batch`` in place of those of the same key."""
    return latest(current.select(*batch.columns).unionByName(batch), key, arrival)


def without_stale(items: DataFrame, source_id: str | None, cutoff: Column, seen: str = "seen_at") -> DataFrame:
    """``items`` without the rows of one source (of all, for None) last seen before ``cutoff``."""
    old = F.col(seen) < cutoff
    if source_id is not None:
        old = old & (F.col("source_id") == source_id)
    return items.where(~F.coalesce(old, F.lit(False)))


def invalid_field(needed: list[str], not_negative: list[str] = (), one_of: dict[str, list[str]] | None = None) -> Column:
    """The first field that is blank, negative or not one of its values; null for a valid row."""
    checks = [(c, F.coalesce(trim_all(F.col(c).cast("string")) == "", F.lit(True))) for c in needed]
    checks += [(c, ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))) for c, allowed in (one_of or {}).items()]
    checks += [(c, F.coalesce(F.col(c) < 0, F.lit(True))) for c in not_negative]
    out = F.lit(None).cast("string")
    for name, bad in reversed(checks):
        out = F.when(bad, F.lit(name)).otherwise(out)
    return out


@dataclass(frozen=True)
class ItemQuery:
    """What to look for; a field left out restricts nothing. ``limit`` counts by recency, 0 is none."""

    equals: tuple[tuple[str, str], ...] = ()
    text: str = ""
    max_price_cents: int = 0
    since: Column | None = None
    limit: int = 0


def search(items: DataFrame, query: ItemQuery, seen: str = "seen_at") -> DataFrame:
    """The items that meet ``query``, the most recent first and then by id.

    A bound on the price leaves out unknown prices (0). Without a limit the
    rows are sorted by a range partitioning; where no order is needed, as
    before another operator, filter with matching() instead.
    """
    out = matching(items, query, seen).orderBy(F.desc(seen), "id")
    return out.limit(query.limit) if query.limit > 0 else out


def matching(items: DataFrame, query: ItemQuery, seen: str = "seen_at") -> DataFrame:
    """The items that meet ``query``, whatever its limit, in no order."""
    out = items
    for column, value in query.equals:
        if value:
            out = out.where(F.col(column) == value)
    if query.max_price_cents > 0:
        out = out.where((F.col("price_cents") > 0) & (F.col("price_cents") <= query.max_price_cents))
    if query.since is not None:
        out = out.where(F.col(seen) >= query.since)
    if query.text:
        out = out.where(contains_text(F.col("title"), F.col("tokens") if "tokens" in items.columns else None, query.text))
    return out


def get(items: DataFrame, key: str) -> DataFrame:
    """The row of one id: one row or none."""
    return items.where(F.col("id") == key).limit(1)
