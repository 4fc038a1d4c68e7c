"""The life of offers: first and last seen, least price, expiry, retention.

A state and batches of observations have the same columns: id, source_id,
price_cents, first_seen, last_seen, min_price_cents, status, expired_at and any
others, which follow the last arrival. The fold is associative in the order of
arrival, so that any batching of the same observations gives the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded(observations: DataFrame, arrival: list[str], key: str = "id") -> DataFrame:
    """One row per key: first seen at the least time, last seen at the greatest, the least known price, the rest from the last arrival.

    A price of 0 is unknown. Late observations never move last_seen back. An
    active last arrival has no expiry. Null keys are left out; of equal
    arrivals the content of the rows decides.
    """
    folds = {"first_seen", "last_seen", "min_price_cents"}
    rest = [c for c in observations.columns if c != key and c not in folds]
    content = F.xxhash64(*[c for c, kind in observations.dtypes if "map<" not in kind])
    ordered = F.struct(*[F.col(c).alias(f"_{i}") for i, c in enumerate(arrival)], content.alias("_content"))
    known = F.nullif(F.col("min_price_cents"), F.lit(0))
    out = (
        observations.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min(F.coalesce("first_seen", "last_seen")).alias("first_seen"),
            F.max("last_seen").alias("last_seen"),
            F.coalesce(F.min(F.least(known, F.nullif(F.col("price_cents"), F.lit(0)))), F.lit(0)).cast("bigint").alias("min_price_cents"),
            F.max_by(F.struct(*rest), ordered).alias("_row"),
        )
    )
    flat = out.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest], *sorted(folds))
    if "expired_at" in rest:
        flat = flat.withColumn("expired_at", F.when(F.col("status") != "active", F.col("expired_at")))
    return flat.select(*observations.columns)


def expired(state: DataFrame, source_id: str | None, cutoff: Column, now: Column) -> DataFrame:
    """``state`` with the active offers of a source (of all, for None) last seen before ``cutoff`` marked as expired."""
    due = (F.col("status") == "active") & (F.col("last_seen") < cutoff)
    if source_id is not None:
        due = due & (F.col("source_id") == source_id)
    due = F.coalesce(due, F.lit(False))
    return state.withColumn("expired_at", F.when(due, now).otherwise(F.col("expired_at"))).withColumn("status", F.when(due, "expired").otherwise(F.col("status")))


def retained(state: DataFrame, source_id: str | None, cutoff: Column) -> DataFrame:
    """``state`` without the offers of a source (of all, for None) last seen before ``cutoff``, whatever their status."""
    old = F.col("last_seen") < cutoff
    if source_id is not None:
        old = old & (F.col("source_id") == source_id)
    return state.where(~F.coalesce(old, F.lit(False)))


def expired_by_source(state: DataFrame, windows: DataFrame, now: Column) -> DataFrame:
    """expired() for many sources at once; ``windows``: source_id and seconds, one row each. Sources without a row keep theirs."""
    due = (F.col("status") == "active") & (F.unix_micros("last_seen") < F.unix_micros(now) - F.col("seconds") * 1_000_000)
    due = F.coalesce(due, F.lit(False))
    return state.join(windows, "source_id", "left").withColumn("expired_at", F.when(due, now).otherwise(F.col("expired_at"))).withColumn("status", F.when(due, "expired").otherwise(F.col("status"))).select(*state.columns)


def offers_where(state: DataFrame, status: str | None = "active", limit: int = 0, since: Column | None = None, **equals: str) -> DataFrame:
    """The offers that match, active ones unless another status (or None) is given, the last seen first and then by id."""
    out = state if status is None else state.where(F.col("status") == status)
    for column, value in equals.items():
        if value:
            out = out.where(F.col(column) == value)
    if since is not None:
        out = out.where(F.col("last_seen") >= since)
    out = out.orderBy(F.desc("last_seen" if "last_seen" in out.columns else "last_seen_ns"), "id")
    return out.limit(limit) if limit > 0 else out


def products(state: DataFrame, key: str = "provisional_key") -> DataFrame:
    """(key, offers, sellers, least price): offers of one product; a blank key is no product."""
    known = F.nullif(F.col("price_cents"), F.lit(0))
    return state.where(F.trim(F.coalesce(F.col(key), F.lit(""))) != "").groupBy(key).agg(F.count("*").alias("n_offers"), F.countDistinct("seller").alias("n_sellers"), F.min(known).alias("least_price_cents"))
