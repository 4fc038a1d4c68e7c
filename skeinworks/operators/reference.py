"""A reference value for each row from the rows like it: grouped medians, with a fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinworks.functions.numbers import half_up
from skeinworks.session import shuffle_partitions, written


def grouped_median(rows: DataFrame, keys: list[str], value: str, least: int = 1) -> DataFrame:
    """(keys, reference, n): the exact median of each group of at least ``least`` rows, rounded half away from zero.

    Equal values are counted before anything else. The counts are put in order
    by a range partitioning over group and value, which also cuts a group of
    very many values; running sums within a part and the sums of the parts
    before it tell which value holds the middle rank. No task and no buffer
    holds a whole group. Rows without a value or a key take no part.
    """
    known = rows.where(F.col(value).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    counted = known.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    parts = counted.repartitionByRange(shuffle_partitions(rows.sparkSession), *keys, "_v")
    parts = written(parts.withColumn("_part", F.spark_partition_id()), "values")
    # At most one row for each group in each part.
    sums = parts.groupBy(*keys, "_part").agg(F.sum("_n").alias("_sum"))
    group = Window.partitionBy(*keys)
    sums = sums.select("*", F.sum("_sum").over(group).alias("n"), (F.sum("_sum").over(group.orderBy("_part")) - F.col("_sum")).alias("_before"))
    middle = sums.where(F.col("n") >= least).where("_before <= n div 2 and _before + _sum > (n - 1) div 2").drop("_sum")
    piece = Window.partitionBy(*keys, "_part").orderBy("_v")
    ranked = parts.join(middle, [*keys, "_part"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(piece))
    hits = F.expr("cast(_upto - _n <= (n - 1) div 2 and _upto > (n - 1) div 2 as int) + cast(_upto - _n <= n div 2 and _upto > n div 2 as int)")
    halves = ranked.withColumn("_hits", hits).where("_hits > 0")
    return halves.groupBy(*keys).agg(half_up(F.sum(F.col("_v") * F.col("_hits")) / 2).alias("reference"), F.first("n").alias("n"))


def with_reference(rows: DataFrame, references: DataFrame, bucket: str, kind: str, anchor: str, factors: dict[str, float]) -> DataFrame:
    """``rows`` with ``reference`` and ``reference_from``: the median of the row's own bucket and kind; failing that, the
    bucket's median of the kind ``anchor`` times the factor of the row's kind; failing that, null.

    Both lookups are one equi-join: the medians of a bucket come as a map by
    kind, so the rows are matched once.
    """
    rows = rows.drop("reference", "reference_from", "_medians")
    maps = references.groupBy(bucket).agg(F.map_from_entries(F.collect_list(F.struct(kind, "reference"))).alias("_medians"))
    own, base = F.col("_medians")[F.col(kind)], F.col("_medians")[F.lit(anchor)]
    factor: Column = F.lit(None).cast("double")
    for name, x in factors.items():
        factor = F.when(F.col(kind) == name, F.lit(x)).otherwise(factor)
    scaled = half_up(base * factor)
    return rows.join(maps, bucket, "left").select(*rows.columns, F.coalesce(own, scaled).alias("reference"), F.when(own.isNotNull(), "own").when(scaled.isNotNull(), "anchor").alias("reference_from"))


def ratio(value: Column, reference: Column) -> Column:
    """value / reference; null where the reference is unknown or 0."""
    return F.try_divide(value.cast("double"), reference.cast("double"))
