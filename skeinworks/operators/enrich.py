"""Columns from small lookups and from per-key services."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinworks.session import written


def looked_up(rows: DataFrame, facts: DataFrame, keys: list[str], drop: list[str] = ()) -> DataFrame:
    """``rows`` with the facts of their keys, null where there are none; ``drop`` names key columns not to be kept.

    Facts count once per key; a fact named like a column of ``rows`` is left
    out. Whether facts are broadcast is left to their size as the session
    measures it.
    """
    once = facts.dropDuplicates(keys).drop(*[c for c in facts.columns if c in rows.columns and c not in keys])
    return rows.join(once, keys, "left").drop(*drop)


def asked(rows: DataFrame, key: str, ask: Callable[[list], list], schema: str, batch: int = 100) -> DataFrame:
    """(key, answers): a service asked once for each distinct key that is left after all filters.

    The keys are written first, so that no optimisation moves the calls before
    the filters. ``ask`` takes keys and returns a tuple for each, or None.
    """
    keys = written(rows.where(F.col(key).isNotNull()).select(key).distinct(), "keys")
    names = [key, *(part.split()[0] for part in schema.split(","))]

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                wanted = frame[key].iloc[at : at + batch].tolist()
                got = [(k, *a) for k, a in zip(wanted, ask(wanted), strict=True) if a is not None]
                yield pd.DataFrame(got, columns=names)

    return keys.mapInPandas(call, f"{key} {keys.schema[key].dataType.simpleString()}, {schema}")
