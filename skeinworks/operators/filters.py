"""A filter that says why it drops a row: the first check that fails."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.numbers import number


@dataclass(frozen=True)
class HardFilter:
    """Checks in the order they are made. Bounds on attributes go by name; a missing or non-numeric attribute fails."""

    category: str = ""
    needs_price: bool = False
    max_price_cents: int = 0
    least: dict[str, float] = field(default_factory=dict)
    most: dict[str, float] = field(default_factory=dict)
    conditions: tuple[str, ...] = ()


def reason(spec: HardFilter, attribute=lambda name: F.col("attributes")[name]) -> Column:
    """The first failing check as ``check:name``, or null for a row that passes. An unknown price (0) passes the bound on the price."""
    price = F.coalesce(F.col("price_cents"), F.lit(0))
    checks: list[tuple[str, Column]] = []
    if spec.category:
        checks.append(("category", ~F.coalesce(F.col("category") == spec.category, F.lit(False))))
    if spec.needs_price:
        checks.append(("unpriced", price <= 0))
    if spec.max_price_cents > 0:
        checks.append(("price", price > spec.max_price_cents))
    for bounds, low in ((spec.least, True), (spec.most, False)):
        for name in sorted(bounds):
            raw, bound = attribute(name), bounds[name]
            value = number(raw)
            checks.append((f"missing:{name}", raw.isNull()))
            checks.append((f"not_numeric:{name}", value.isNull()))
            checks.append((f"{'below' if low else 'above'}:{name}", value < bound if low else value > bound))
    if spec.conditions:
        checks.append(("condition", ~F.coalesce(F.col("condition").isin(*spec.conditions), F.lit(False))))
    out = F.lit(None).cast("string")
    for name, fails in reversed(checks):
        out = F.when(fails, F.lit(name)).otherwise(out)
    return out


def explained(items: DataFrame, spec: HardFilter, **named) -> DataFrame:
    """``items`` with the column ``reason``; survivors have null there."""
    return items.withColumn("reason", reason(spec, **named))
