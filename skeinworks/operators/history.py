"""History of entities whose attributes change, from readings taken over time.

Each reading is an interval of length one. Readings are put into contiguous
blocks of (entity, moment) by a range partitioning, which also cuts an entity
with very many readings into several blocks. A block coalesces neighbouring
intervals of the same entity and equal payload to runs in one streaming pass.
Blocks are then merged pairwise over logarithmic rounds: the combined state of
two neighbouring blocks is the entity they end in and what is known of it
there, which is of constant size, so the rounds run over one row per block.
Each block gets what the blocks before it knew, drops runs that only repeat
it, and gets from the blocks after it where its last run ends.

Defined results: a null attribute says nothing and the last known value stays;
an attribute that becomes known starts a version; a repeated (entity, moment)
counts once, by the greatest load time and then the greatest tie-breaker; rows
without entity or moment are left out; an empty table gives an empty history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skeinworks.session import shuffle_partitions, written


def _filled(values: np.ndarray, start: np.ndarray, carried: object) -> np.ndarray:
    """``values`` with the last known one of the same entity in place of nulls; ``carried`` goes in before the first start."""
    known = ~pd.isna(values)
    at = np.where(known | start, np.arange(len(values)), -1)
    at = np.maximum.accumulate(at)
    out = np.where(at >= 0, values[np.maximum(at, 0)], carried)
    out[pd.isna(out)] = None
    return out


def _block_runs(batches: Iterator[pa.RecordBatch], attributes: list[str]) -> Iterator[pd.DataFrame]:
    """The runs of one sorted block, then one row with its state: kind 1."""
    block = TaskContext.get().partitionId()
    first = last = moment = None
    state: dict[str, object] = dict.fromkeys(attributes)
    for batch in batches:
        if not batch.num_rows:
            continue
        pdf = batch.to_pandas(integer_object_nulls=True)
        ids, at = pdf["id"].to_numpy(object), pdf["at"].to_numpy(np.int64)
        before_id = np.concatenate([[last], ids[:-1]])
        before_at = np.concatenate([[moment if moment is not None else 0], at[:-1]])
        again = (ids == before_id) & (at == before_at)
        pdf, ids, at = pdf[~again], ids[~again], at[~again]
        if not len(ids):
            continue
        start = np.concatenate([[ids[0] != last], ids[1:] != ids[:-1]])
        new = start.copy()
        out = {"block": block, "kind": 0, "id": ids, "at": at}
        for a in attributes:
            full = _filled(pdf[a].to_numpy(object), start, state[a])
            prior = np.concatenate([[None if start[0] else state[a]], full[:-1]])
            prior[start] = None
            out[a], out[f"prior_{a}"] = full, prior
            new |= full != prior
            state[a] = full[-1]
        first = ids[0] if first is None else first
        last, moment = ids[-1], at[-1]
        runs = pd.DataFrame(out)
        runs["leads"], runs["opens"] = ids == first, start
        yield runs[new]
    if first is not None:
        yield pd.DataFrame({k: pd.Series([v], dtype=object) for k, v in {"block": block, "kind": 1, "id": first, "last_id": last, **state}.items()})


def _scan(states: list[tuple], merge) -> list[tuple]:
    """What each state and all before it merge to: neighbours pairwise, over logarithmic rounds."""
    states, reach = list(states), 1
    while reach < len(states):
        states = [merge(states[i - reach], s) if i >= reach else s for i, s in enumerate(states)]
        reach *= 2
    return states


def versions(readings: DataFrame, entity: str, moment: str, loaded: str, tie: str, attributes: list[str]) -> DataFrame:
    """(id, valid_from, valid_to, attributes): the versions of each entity; valid_to is 0 for the last.

    ``moment`` is a bigint; attributes must be null where they say nothing.
    """
    spark, names = readings.sparkSession, attributes
    attributes = [f"a{i}" for i in range(len(names))]  # no name of the caller's can clash with the columns below
    kinds = {a: readings.schema[n].dataType for a, n in zip(attributes, names, strict=True)}
    source = readings.where(F.col(entity).isNotNull() & F.col(moment).isNotNull()).select(
        F.col(entity).cast("string").alias("id"), F.col(moment).cast("long").alias("at"), F.col(loaded).alias("_loaded"), F.col(tie).alias("_tie"), *[F.col(n).alias(a) for a, n in zip(attributes, names, strict=True)]
    )
    blocks = source.repartitionByRange(shuffle_partitions(spark), "id", "at").sortWithinPartitions("id", "at", F.desc_nulls_last("_loaded"), F.desc_nulls_last("_tie"))
    schema = T.StructType(
        [T.StructField("block", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("at", T.LongType())]
        + [T.StructField(a, kinds[a]) for a in attributes]
        + [T.StructField(f"prior_{a}", kinds[a]) for a in attributes]
        + [T.StructField("leads", T.BooleanType()), T.StructField("opens", T.BooleanType()), T.StructField("last_id", T.StringType())]
    )

    arrow = to_arrow_schema(schema)

    def coalesce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in _block_runs(batches, attributes):
            yield from pa.Table.from_pandas(pdf.reindex(columns=schema.names), arrow, preserve_index=False).to_batches()

    runs = written(blocks.select("id", "at", *attributes).mapInArrow(coalesce, schema), "runs", ["kind"])

    # One row per block, of constant size: their number is the number of partitions.
    states = [(r["block"], r["id"], r["last_id"], tuple(r[a] for a in attributes)) for r in runs.where("kind = 1").orderBy("block").collect()]

    def onward(left: tuple, right: tuple) -> tuple:
        goes_on = right[1] == right[2] == left[2]
        known = tuple(x if x is not None else y for x, y in zip(right[3], left[3], strict=True)) if goes_on else right[3]
        return right[0], left[1], right[2], known

    whole = _scan(states, onward)
    carried = [(s[0], s[1], s[2], *w[3]) for s, w in zip(states[1:], whole, strict=False) if s[1] == w[2]]
    carry_schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("_first", T.StringType()), T.StructField("_end", T.StringType())] + [T.StructField(f"carry_{a}", kinds[a]) for a in attributes])
    carry = spark.createDataFrame(carried, carry_schema).drop("_end")

    here = runs.where("kind = 0").join(F.broadcast(carry), "block", "left")
    goes_on = F.col("leads") & F.col("_first").isNotNull()
    same = F.lit(True)
    for a in attributes:
        prior = F.when(F.col("opens"), F.col(f"carry_{a}")).otherwise(F.coalesce(f"prior_{a}", f"carry_{a}"))
        same = same & F.coalesce(a, f"carry_{a}").eqNullSafe(prior)
    kept = here.where(~F.coalesce(goes_on & same, F.lit(False))).select("block", "id", "at", *[F.when(goes_on, F.coalesce(a, f"carry_{a}")).otherwise(F.col(a)).alias(a) for a in attributes], "leads")

    starts = {r["block"]: r["at"] for r in kept.where("leads").groupBy("block").agg(F.min("at").alias("at")).collect()}

    def backward(right: tuple, left: tuple) -> tuple:
        """left: the state of the blocks from here on; (first entity, last entity, its first start)."""
        begin = left[2] if left[2] is not None else (right[2] if left[0] == left[1] == right[0] else None)
        return left[0], right[1], begin

    heads = [(s[1], s[2], starts.get(s[0])) for s in states]
    after = _scan(heads[::-1], backward)[::-1]
    ends = [(s[0], s[2], a[2]) for s, a in zip(states, after[1:], strict=False) if a[0] == s[2] and a[2] is not None]
    closing = spark.createDataFrame(ends, "block int, _last string, _end long")

    following = F.lead("at").over(Window.partitionBy("block", "id").orderBy("at"))
    return (
        kept.withColumn("_next", following)
        .join(F.broadcast(closing), "block", "left")
        .select(
            "id",
            F.col("at").alias("valid_from"),
            F.coalesce(F.col("_next"), F.when(F.col("id") == F.col("_last"), F.col("_end")), F.lit(0).cast("long")).alias("valid_to"),
            *[F.col(a).alias(n) for a, n in zip(attributes, names, strict=True)],
        )
    )

