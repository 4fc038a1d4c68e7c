"""The row that every source is mapped to, and the gate rows pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAW = "source_id string, source_key string, source_url string, title string, body string, price_cents bigint, currency string, condition_raw string, aspects map<string,string>, seen_at timestamp"


def aspects(**values: Column) -> Column:
    """A map of the values that are neither null nor blank."""
    pairs = [x for name, value in values.items() for x in (F.lit(name), F.when(F.trim(value.cast("string")) != "", value.cast("string")))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def gated(rows: DataFrame, boundary: str, refused: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(passed, skipped): rows stamped with the boundary they crossed, their content unchanged; and refused ones by key, stage and reason."""
    why = F.lit(None).cast("string") if refused is None else refused
    marked = rows.withColumn("_why", why)
    passed = marked.where("_why is null").drop("_why").withColumn("boundary", F.lit(boundary))
    skipped = marked.where("_why is not null").select("source_key", F.lit("gate").alias("stage"), F.col("_why").alias("reason"))
    return passed, skipped
