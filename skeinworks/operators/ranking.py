"""Ranks, and saved searches that share one pass over the items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.text import contains_text


def ranked(rows: DataFrame, by: list[Column], within: list[str], name: str = "rank") -> DataFrame:
    """Rows with their position from 1 within each group. Without groups, give a bounded result only: one task numbers it."""
    window = Window.partitionBy(*within).orderBy(*by) if within else Window.partitionBy(F.lit(0)).orderBy(*by)
    return rows.withColumn(name, F.row_number().over(window))


def matched_watches(items: DataFrame, watches: list[dict]) -> DataFrame:
    """(watch, items' columns): for each saved search the ``limit`` most recent items it matches.

    The searches are few and given by the caller; each row is tested against
    all in one pass. The limit goes by recency, before any further filter, and
    is taken in every input partition before the shuffle. A limit of 0 is
    none; such searches need no order and take no part in the ranking.
    """
    items = items.drop("watch")
    hits = []
    for w in watches:
        hit = F.coalesce(F.col("category") == w["category"], F.lit(False)) if w.get("category") else F.lit(True)
        if w.get("text"):
            hit = hit & contains_text(F.col("title"), None, w["text"])
        hits.append(F.when(hit, F.struct(F.lit(w["name"]).alias("watch"), F.lit(w.get("limit") or 0).alias("_limit"))))
    each = items.select("*", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("_hit")).select("*", "_hit.*").drop("_hit")
    limits = [w["limit"] for w in watches if w.get("limit")]
    recent = Window.partitionBy("watch").orderBy(F.desc("seen_at"), "id")
    first = each.where("_limit > 0").withColumn("_n", F.row_number().over(recent)).where(f"_n <= {max(limits, default=0)} and _n <= _limit").drop("_n")
    if len(limits) < len(watches):
        first = first.unionByName(each.where("_limit = 0"))
    return first.drop("_limit")
