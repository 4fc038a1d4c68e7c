"""A mix of sources by target shares of the total size.

Every distinct text counts once in its source. A source's budget is its share
of the total; complete epochs over the source come first, and the rest of the
budget is drawn by weighted sampling without replacement after Efraimidis and
Spirakis: texts are taken in the order of exponential keys, divided by their
quality weights, until their prefix sum reaches the budget. Keys are hashes of
the text and a seed, so that a repeated task draws the same texts.

The order within a source comes from a range partitioning on source and key,
which also cuts a source that holds most of the texts; prefix sums add up the
partition's own running sum and the sums of the partitions before it, of which
there is one row for each partition and source.

Defined results: without a given total, the largest one at which every source
that has texts reaches its share within its repeats; a source without texts
gets none, and the others keep their proportions; texts of sources that are
no target, of no size, or without a source take no part; a text that several
sources hold belongs to the row with the least key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.session import shuffle_partitions, written


def quality(text: Column) -> Column:
    """A weight in (0, 1]: the share of letters, and how far the text is from a fragment."""
    length = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.lit(0.1) + F.lit(0.9) * (letters / F.greatest(length, F.lit(1))) * (F.lit(1.0) - F.exp(-length / F.lit(400.0)))


def plan(available: dict[str, int], targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[int, float]]:
    """(complete epochs, size of the fractional draw) of each source; ``available``: the size of each source's texts."""
    live = [(s, share, repeats) for s, share, repeats in targets if available.get(s) and share and share > 0 and repeats and repeats > 0]
    shares = sum(share for _, share, _ in live)
    if not live:
        return {}
    if total is None:
        total = min(repeats * available[s] * shares / share for s, share, repeats in live)
    out = {}
    for s, share, repeats in live:
        budget = min(total * share / shares, repeats * available[s])
        epochs = math.floor(budget / available[s] + 1e-9)
        out[s] = epochs, max(0.0, budget - epochs * available[s])
    return out


def mixed(docs: DataFrame, targets: DataFrame, key: str, total: float | None = None, seed: int = 17) -> DataFrame:
    """(source, key, size, uses): how many times each chosen text is used.

    ``docs``: key, source, size, weight and text_hash; ``targets``: source,
    target_share and max_repeats, a small table with one row a source.
    """
    spark = docs.sparkSession
    wanted = [(r["source"], r["target_share"], r["max_repeats"]) for r in targets.where("source is not null").dropDuplicates(["source"]).collect()]  # one row a source
    inside = docs.join(targets.select("source").where("source is not null").distinct(), "source", "left_semi").where(F.col(key).isNotNull() & (F.col("size") > 0))
    once = inside.groupBy("text_hash").agg(F.min(F.struct(F.col(key).alias("key"), "source", "size", "weight")).alias("r")).select("text_hash", "r.*")
    once = written(once, "texts")  # the range partitioning reads its input twice
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "text_hash"), 11).cast("double") + 0.5) / float(1 << 53)
    drawn = once.withColumn("order", -F.log(unit) / F.greatest("weight", F.lit(1e-9)))
    parts = drawn.repartitionByRange(shuffle_partitions(spark), "source", "order", "key").sortWithinPartitions("source", "order", "key")
    kind = once.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            sources, sizes = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            sums = np.zeros(len(sources), np.int64)
            start = 0
            while start < len(sources):
                stop = start + 1
                while stop < len(sources) and sources[stop] == sources[start]:
                    stop += 1
                base = so_far if sources[start] == at else 0
                sums[start:stop] = base + np.cumsum(sizes[start:stop])
                at, so_far, start = sources[start], int(sums[stop - 1]), stop
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(sources), pa.int32()), *batch.columns, pa.array(sums)], names=["part", "source", "key", "size", "running"])

    running = written(parts.select("source", "key", F.col("size").cast("bigint").alias("size")).mapInArrow(run, f"part int, source string, key {kind}, size bigint, running bigint"), "running")
    sums = running.groupBy("source", "part").agg(F.max("running").alias("sum")).collect()  # one row for each partition and source in it
    available: dict[str, int] = {}
    before = []
    for r in sorted(sums, key=lambda r: (r["source"], r["part"])):
        before.append((r["part"], r["source"], available.get(r["source"], 0)))
        available[r["source"]] = available.get(r["source"], 0) + r["sum"]
    budgets = [(s, e, float(f)) for s, (e, f) in plan(available, wanted, total).items()]
    offsets = F.broadcast(spark.createDataFrame(before, "part int, source string, before bigint"))
    limits = F.broadcast(spark.createDataFrame(budgets, "source string, epochs int, rest double"))
    # A text is drawn where at least half of it lies within the budget, so that the sum ends nearest to it.
    reached = F.col("before") + F.col("running") - F.col("size") / 2
    uses = F.col("epochs") + (reached <= F.col("rest")).cast("int")
    return running.join(offsets, ["part", "source"]).join(limits, "source").select("source", F.col("key").alias(key), "size", uses.alias("uses")).where("uses > 0")


def shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target source got: texts, size, share reached, the most uses of a text."""
    used = mix.groupBy("source").agg(F.count("*").alias("texts"), F.sum(F.col("size") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    got = targets.where("source is not null").dropDuplicates(["source"]).join(written(used, "used"), "source", "left")
    whole = got.agg(F.sum("tokens").alias("n")).first()["n"] or 0  # over one row a source
    return got.withColumn("all_tokens", F.lit(whole)).select("source", "target_share", "max_repeats", F.coalesce("texts", F.lit(0)).alias("texts"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.try_divide("tokens", "all_tokens"), F.lit(0.0)).alias("share"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
