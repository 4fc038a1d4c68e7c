"""Deeply nested records as related flat tables, in one pass.

Every record is visited once, depth first. The visitor emits one row for each
object that belongs to a table: a table tag, the object's key, its parent's
key and a payload. The rows of all tables leave the pass together and are
written partitioned by tag, so that reading one table reads only its rows; the
schema of a table is applied when it is read.

Two visitors emit the same rows: one generates a JVM expression for typed
nested columns, the other walks JSON text whose layout varies from record to
record.

Children are a list of objects, one object, or the values of a map. Defined
results: a null or missing list states nothing (``children`` has no entry for
the table), an empty list states that there are none (its entry is 0); null
elements are skipped; text that is no JSON emits nothing; an object without an
id is emitted with a null ``own_id``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinworks.session import scratch_path

TAGGED = T.StructType(
    [
        T.StructField("tag", T.StringType()),
        T.StructField("pk", T.StringType()),
        T.StructField("parent_pk", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("own_id", T.LongType()),
        T.StructField("root_id", T.LongType()),
        T.StructField("version", T.TimestampType()),
        T.StructField("children", T.MapType(T.StringType(), T.IntegerType())),
        T.StructField("payload", T.StringType()),
    ]
)


@dataclass(frozen=True)
class TableRule:
    """One table of the nest.

    ``name`` is the member that holds the table's objects in their parent,
    ``columns`` maps a payload column to the member paths to try in order, and
    ``children`` are the tables nested in it.
    """

    tag: str
    name: str
    id_member: str = "id"
    columns: dict[str, tuple[str, ...]] = field(default_factory=dict)
    children: tuple["TableRule", ...] = ()


def emit_typed(records: DataFrame, rule: TableRule, record_key: Column, version: Column) -> DataFrame:
    """Tagged rows of typed records (one object of ``rule`` per row) by one generated expression."""
    own = F.col(rule.id_member).cast("long")
    pk = record_key.cast("string")
    rows = _typed_rows(rule, None, records.schema, pk, F.lit(None).cast("string"), F.lit(0), own, version)
    return records.select(F.inline(rows))


def _no_rows() -> Column:
    return F.array().cast(T.ArrayType(TAGGED))


def _listed(member: Column, kind: T.DataType) -> tuple[Column, T.StructType]:
    """The objects of a member as an array, and their type."""
    if isinstance(kind, T.StructType):
        return F.when(member.isNotNull(), F.array(member)), kind
    if isinstance(kind, T.MapType):
        return F.map_values(member), kind.valueType
    return member, kind.elementType


def _visitor(rule: TableRule, element: T.StructType, parent: Column, root: Column, version: Column):
    def visit(x: Column, i: Column) -> Column:
        return F.when(x.isNull(), _no_rows()).otherwise(_typed_rows(rule, x, element, F.concat(parent, F.lit("/"), i.cast("string")), parent, i, root, version))

    return visit


def _typed_rows(rule: TableRule, obj: Column | None, schema: T.StructType, pk: Column, parent: Column, ordinal: Column, root: Column, version: Column) -> Column:
    """The rows of one object and of all below it, as an array: parents come before children."""
    member = (lambda n: obj[n]) if obj is not None else F.col
    names = set(schema.names)
    payload = F.to_json(F.struct(*[F.coalesce(*[member(p).cast("string") for p in paths if p in names]).alias(c) for c, paths in rule.columns.items() if names & set(paths)]))
    counts, below = [], []
    for child in rule.children:
        if child.name not in names:
            continue
        items, element = _listed(member(child.name), schema[child.name].dataType)
        counts += [F.lit(child.tag), F.when(items.isNotNull(), F.size(F.filter(items, lambda x: x.isNotNull())))]
        below.append(F.coalesce(F.flatten(F.transform(items, _visitor(child, element, pk, root, version))), _no_rows()))
    stated = F.map_filter(F.create_map(*counts), lambda _, n: n.isNotNull()) if counts else F.create_map()
    own = F.struct(
        F.lit(rule.tag).alias("tag"),
        pk.alias("pk"),
        parent.alias("parent_pk"),
        ordinal.cast("int").alias("ordinal"),
        member(rule.id_member).cast("long").alias("own_id"),
        root.alias("root_id"),
        version.alias("version"),
        stated.alias("children"),
        payload.alias("payload"),
    ).cast(TAGGED)
    return F.concat(F.array(own), *below) if below else F.array(own)


def number_in(value: object) -> int | None:
    """The id a member carries, whatever text surrounds it; None where it carries none."""
    if value is None or isinstance(value, bool):
        return None
    if isinstance(value, int):
        return value if -(2**63) <= value < 2**63 else None
    if isinstance(value, float):
        return int(value) if value.is_integer() and abs(value) < 2**63 else None
    runs = re.findall(r"\d+", value) if isinstance(value, str) else []
    best = max(runs, key=len, default=None)
    return int(best) if best and int(best) < 2**63 else None


def members(value: object) -> list | None:
    """The objects a member holds: a list, one object, or a connection of edges and nodes. None: it states nothing."""
    if isinstance(value, list):
        return [x["node"] if isinstance(x, dict) and "node" in x else x for x in value]
    if isinstance(value, dict):
        for wrap in ("edges", "nodes"):
            if wrap in value:
                return members(value[wrap])
        return [value]
    return None


def _path(obj: dict, path: str) -> object:
    for step in path.split("."):
        if not isinstance(obj, dict):
            return None
        obj = obj.get(step)
    return obj


def _text(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def visit_json(body: str | None, rule: TableRule, record_key: str) -> Iterator[tuple]:
    """Depth-first rows of the JSON text ``body``, without the version; nothing where it can't be read."""
    try:
        top = json.loads((body or "").lstrip("﻿"))
    except (ValueError, RecursionError):
        return
    found = 0
    stack = [{rule.name: top}] if isinstance(top, list) else [top]
    while stack:
        here = stack.pop()
        if isinstance(here, list):
            stack.extend(reversed(here))
        elif isinstance(here, dict):
            for name, value in here.items():
                if name == rule.name:
                    for obj in members(value) or ():
                        if isinstance(obj, dict):
                            yield from _json_rows(obj, rule, f"{record_key}/{found}", None, found, number_in(obj.get(rule.id_member)))
                            found += 1
            stack.extend(v for k, v in reversed(here.items()) if k != rule.name and isinstance(v, (dict, list)))


def _json_rows(obj: dict, rule: TableRule, pk: str, parent: str | None, ordinal: int, root: int | None) -> Iterator[tuple]:
    counts, below = {}, []
    for child in rule.children:
        items = members(obj.get(child.name))
        if items is None:
            continue
        kept = [(i, x) for i, x in enumerate(items) if isinstance(x, dict)]
        counts[child.tag] = len(kept)
        below += [(child, i, x) for i, x in kept]
    payload = {}
    for column, paths in rule.columns.items():
        payload[column] = next((_text(v) for v in (_path(obj, p) for p in paths) if v is not None and not isinstance(v, dict)), None)
    yield rule.tag, pk, parent, ordinal, number_in(obj.get(rule.id_member)), root, counts, json.dumps({k: v for k, v in payload.items() if v is not None}, ensure_ascii=False)
    for child, i, x in below:
        yield from _json_rows(x, child, f"{pk}/{i}", pk, i, root)


def emit_json(pages: DataFrame, rule: TableRule, key: str, body: str, version: str) -> DataFrame:
    """Tagged rows of records that are JSON text, each record visited once."""
    names = ["tag", "pk", "parent_pk", "ordinal", "own_id", "root_id", "children", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.map_(pa.string(), pa.int32()), pa.string()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies, versions = (batch.column(i) for i in range(3))
            for at in range(batch.num_rows):
                rows = list(visit_json(bodies[at].as_py(), rule, keys[at].as_py()))
                if rows:
                    columns = [pa.array([list(x.items()) for x in c] if pa.types.is_map(k) else list(c), type=k) for c, k in zip(zip(*rows), kinds, strict=True)]
                    stamp = pa.array([versions[at].as_py()] * len(rows), type=versions.type)
                    yield pa.RecordBatch.from_arrays([*columns, stamp], names=[*names, "version"])

    out = T.StructType([*(TAGGED[n] for n in names), TAGGED["version"]])
    return pages.select(F.col(key).cast("string").alias("key"), F.col(body).alias("body"), F.col(version).alias("version")).mapInArrow(walk, out).select(*TAGGED.names)


def write_tables(tagged: DataFrame, path: str | None = None) -> str:
    """Writes tagged rows partitioned by tag, and returns the path that read_table() takes."""
    path = path or scratch_path(tagged.sparkSession, "nest")
    tagged.write.partitionBy("tag").parquet(path)
    return path


def read_tagged(spark: SparkSession, path: str) -> DataFrame:
    """All tables of ``path``, as tagged rows; a filter on tag prunes the folders read."""
    return spark.read.schema(TAGGED).parquet(path)


def read_table(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The flat table ``tag`` of ``path``: keys, and the payload under ``schema`` (unreadable members are null)."""
    rows = read_tagged(spark, path).where(F.col("tag") == tag)
    wanted = spark.createDataFrame([], schema).schema
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in wanted])  # sources write the same member as text, number or flag
    keys = rows.select("pk", "parent_pk", "ordinal", "own_id", "root_id", "version", "children", F.from_json("payload", texts).alias("_row"))
    return keys.select("pk", "parent_pk", "ordinal", "own_id", "root_id", "version", "children", *[F.col(f"_row.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted])


def latest_children(tagged: DataFrame, root_tag: str, child_tag: str) -> DataFrame:
    """(root_id, own_id) of the children each root had in its latest version that states them.

    Rows are first reduced to one per root and child, with partial aggregates
    before the shuffle, so that a root with very many versions arrives as few
    rows; the root's latest version comes from the same reduced rows.
    """
    stated = (F.col("tag") == root_tag) & F.map_contains_key("children", child_tag)
    child = (F.col("tag") == child_tag) & F.col("own_id").isNotNull()
    last = (
        tagged.where(F.col("root_id").isNotNull() & (stated | child))
        .groupBy("root_id", F.when(child, F.col("own_id")).alias("own_id"))
        .agg(F.max("version").alias("version"))
    )
    newest = last.groupBy("root_id").agg(F.max("version").alias("newest"))
    return last.where("own_id is not null").join(newest, "root_id").where("version = newest").select("root_id", "own_id")
