"""Items of varying size in containers of fixed capacity, by best-fit decreasing.

Items are taken from the largest to the smallest, and each goes to the open
container it leaves the least space in. A segment tree over the remaining
capacities 0 to C counts the open containers with each; the tightest one that
fits is found by one descent, in the logarithm of C.

Items of one size are alike, so the tree is run over the counts of the sizes,
and containers of equal remaining capacity are filled together: the result is
that of placing all items of the whole table one after another. What the
driver holds depends on the capacity alone: at most C counts, and a plan of
O(C log C) steps, since a group of containers that is filled keeps less than
half of its remaining capacity. Which item is which of its size comes from a
range partitioning over size and key with the counts of the partitions before,
and each partition then looks its items up in the plan.

Defined results: an item larger than the capacity is cut into full containers
of its own and a rest, which is packed like any item; no other item is cut;
an item of size zero is in no container; items of equal size go by key; a
capacity that is null or not positive gives no containers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import shuffle_partitions, written


class OpenBins:
    """Open containers by remaining capacity: a segment tree of counts over 0 to ``capacity``, and runs of containers at each leaf."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(1, capacity.bit_length())
        self.counts = [0] * (2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _count(self, left: int, change: int) -> None:
        at = self.leaves + left
        while at:
            self.counts[at] += change
            at >>= 1

    def add(self, left: int, first: int, many: int) -> None:
        """``many`` containers from ``first`` on, with ``left`` remaining."""
        if left and many:
            self.runs[left].append((first, many))
            self._count(left, many)

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity, at least ``size``, of any open container."""
        counts, at = self.counts, self.leaves + size
        if not counts[at]:
            # Up to the first subtree on the right that holds a container, then down to its first leaf.
            while at > 1 and (at & 1 or not counts[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at <<= 1
                at += not counts[at]
        return at - self.leaves

    def take(self, left: int) -> tuple[int, int]:
        """The last run of containers with ``left`` remaining; it is removed."""
        first, many = self.runs[left].pop()
        self._count(left, -many)
        return first, many


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(steps, number of containers) for ``counts`` items of each size from 1 to ``capacity``.

    A step (size, rank, items, first, each) puts the items of that size with
    ranks from ``rank`` on into the containers from ``first`` on, ``each`` in every one.
    """
    bins, steps, opened = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            space = bins.tightest(size)
            if space is None:
                space, first, many = capacity, opened, -(-left // (capacity // size))
                opened += many
            else:
                first, many = bins.take(space)
            # A container that was just used is the tightest one until no further item of this size fits it.
            each = space // size
            whole = min(many, left // each)
            if whole:
                steps.append((size, rank, whole * each, first, each))
                bins.add(space - each * size, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < many and left:
                steps.append((size, rank, left, first + whole, left))
                bins.add(space - left * size, first + whole, 1)
                left, whole = 0, whole + 1
            bins.add(space, first + whole, many - whole)
    return steps, opened


def packed(items: DataFrame, key: str, size: str, capacities: DataFrame, name: str, capacity: str) -> DataFrame:
    """(pack_name, pack, key, piece, start, size): where each piece of each item goes.

    ``pack`` is unique within its name. ``capacities`` is a small table: one
    row for each kind of container. ``items`` are read twice, so give a
    written table.
    """
    spark = items.sparkSession
    kinds = [(r["pack_name"], r["capacity"]) for r in capacities.where(F.col(capacity) > 0).select(F.col(name).alias("pack_name"), F.col(capacity).cast("int").alias("capacity")).dropDuplicates(["pack_name"]).collect()]  # kinds of containers, not items
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), F.lit(c).alias("capacity")) for i, (_, c) in enumerate(kinds)])) if kinds else F.explode(F.expr("cast(array() as array<struct<kind:int,capacity:int>>)"))
    rows = items.select(F.col(key).alias("key"), F.col(size).cast("int").alias("size")).where("key is not null and size > 0").select("key", "size", each.alias("_k"))
    cut = rows.select(F.col("_k.kind").alias("kind"), (F.col("size") % F.col("_k.capacity")).alias("rest"), F.floor(F.col("size") / F.col("_k.capacity")).cast("int").alias("full"), "key")
    parts = cut.repartitionByRange(shuffle_partitions(spark), "kind", F.desc("rest"), "key").sortWithinPartitions("kind", F.desc("rest"), "key")
    key_type = cut.schema["key"].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The place of each row among those of its size, and of its full containers among those of its kind, within the partition."""
        part, at, seen, kind, fulls = TaskContext.get().partitionId(), None, 0, None, 0
        for batch in batches:
            kinds_, rests, full = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
            n = len(kinds_)
            place, before = np.zeros(n, np.int64), np.zeros(n, np.int64)
            cuts = np.flatnonzero((np.diff(kinds_) != 0) | (np.diff(rests) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, n], strict=True) if n else ():
                if (kinds_[a], rests[a]) != at:
                    at, seen = (kinds_[a], rests[a]), 0
                if kinds_[a] != kind:
                    kind, fulls = kinds_[a], 0
                place[a:b] = seen + np.arange(b - a)
                before[a:b] = fulls + np.cumsum(full[a:b]) - full[a:b]
                seen, fulls = seen + int(b - a), fulls + int(full[a:b].sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), *batch.columns, pa.array(place), pa.array(before)], names=["part", "kind", "rest", "full", "key", "place", "before"])

    numbered = written(parts.mapInArrow(number, f"part int, kind int, rest int, full int, key {key_type}, place bigint, before bigint"), "numbered")
    # A partition holds a range of sizes, so these are at most as many rows as there are sizes and partitions.
    tallies = sorted((r["kind"], r["part"], -r["rest"], r["n"], r["fulls"]) for r in numbered.groupBy("kind", "part", "rest").agg(F.count("*").alias("n"), F.sum("full").alias("fulls")).collect())
    counts: list[dict[int, int]] = [{} for _ in kinds]
    ranks: dict[tuple[int, int, int], int] = {}
    fulls: dict[tuple[int, int], int] = {}
    full_so_far = [0] * len(kinds)
    for kind, part, minus_rest, n, full in tallies:
        rest = -minus_rest
        ranks[kind, part, rest] = counts[kind].get(rest, 0)
        counts[kind][rest] = counts[kind].get(rest, 0) + n
        fulls.setdefault((kind, part), full_so_far[kind])
        full_so_far[kind] += full
    plans = []
    for kind, (_, capacity_) in enumerate(kinds):
        steps, opened = best_fit_decreasing({s: n for s, n in counts[kind].items() if s}, capacity_)
        by_size: dict[int, list[tuple[int, ...]]] = {}
        for step in steps:
            by_size.setdefault(step[0], []).append(step[1:])
        plans.append(({s: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for s, x in by_size.items()}, opened))
    shared = spark.sparkContext.broadcast((kinds, plans, ranks, fulls))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, plans, ranks, fulls = shared.value
        for batch in batches:
            part, kind, rest, full, _, at, before = (None if i == 4 else batch.column(i).to_numpy(zero_copy_only=False) for i in range(7))
            row, pack, piece, size_ = [], [], [], []
            cuts = np.flatnonzero((np.diff(kind) != 0) | (np.diff(rest) != 0) | (np.diff(part) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(kind)], strict=True) if len(kind) else ():
                k, p, r = int(kind[a]), int(part[a]), int(rest[a])
                (steps, opened), capacity_ = plans[k], kinds[k][1]
                if r:
                    first_rank, _, first_bin, per_bin = steps[r]
                    rank = ranks[k, p, r] + at[a:b]
                    s = np.searchsorted(first_rank, rank, side="right") - 1
                    row.append(np.arange(a, b)), pack.append(first_bin[s] + (rank - first_rank[s]) // per_bin[s]), piece.append(full[a:b].astype(np.int64)), size_.append(np.full(b - a, r, np.int64))
                if full[a:b].any():
                    many = full[a:b].astype(np.int64)
                    start = np.repeat(np.cumsum(many) - many, many)
                    nth = np.arange(int(many.sum())) - start
                    row.append(np.repeat(np.arange(a, b), many)), pack.append(opened + fulls[k, p] + np.repeat(before[a:b], many) + nth), piece.append(nth), size_.append(np.full(len(nth), capacity_, np.int64))
            row_, pack_, piece_, sizes = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, pack, piece, size_))
            capacity_of = np.array([c for _, c in kinds] or [0], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in kinds] or [""], pa.string()).take(pa.array(kind[row_])), pa.array(pack_), batch.column(4).take(pa.array(row_)), pa.array(piece_, pa.int32()), pa.array(piece_ * capacity_of[kind[row_]], pa.int32()), pa.array(sizes, pa.int32())],
                names=["pack_name", "pack", "key", "piece", "start", "size"],
            )

    return numbered.mapInArrow(place, f"pack_name string, pack bigint, key {key_type}, piece int, start int, size int").withColumnRenamed("key", key)


def fill(packs: DataFrame, capacities: DataFrame, name: str, capacity: str) -> DataFrame:
    """(pack_name, capacity, packs, size, fill): how full the containers of each kind are on average."""
    used = packs.groupBy("pack_name", "pack").agg(F.sum("size").alias("size")).groupBy("pack_name").agg(F.count("*").alias("packs"), F.sum("size").alias("size"))
    kinds = capacities.where(F.col(capacity) > 0).select(F.col(name).alias("pack_name"), F.col(capacity).alias("capacity")).dropDuplicates(["pack_name"])
    return used.join(kinds, "pack_name").select("pack_name", "capacity", "packs", "size", (F.col("size") / (F.col("packs") * F.col("capacity"))).alias("fill"))
