"""Session set-up and the shared scratch folder that long lineages are cut with."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN_SCRATCH: dict[str, str] = {}
#: Scratch paths of this process, with what deletes them.
_WRITTEN: dict[str, tuple] = {}


def build_session(app: str = "skeinworks", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=settings).getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a session on one machine gets a temporary
    folder, which is set as the checkpoint folder too; on a cluster that is an
    error, as no executor could read what another one wrote.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_SCRATCH:
        folder = tempfile.mkdtemp(prefix="skein-", dir=os.environ.get("TMPDIR"))
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN_SCRATCH[app] = f"file://{folder}"
        spark.sparkContext.setCheckpointDir(_OWN_SCRATCH[app])
    return _OWN_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; it is deleted with the process, or before by discard()."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_sweep)
    _WRITTEN.setdefault(path, (spark._jvm, spark._jsc.hadoopConfiguration()))
    return path


def _delete(path: str, jvm, conf) -> None:  # noqa: ANN001
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def _sweep() -> None:
    while _WRITTEN:
        path, (jvm, conf) = _WRITTEN.popitem()
        try:
            _delete(path, jvm, conf)
        except Exception:  # noqa: BLE001  the gateway may be gone
            return


def discard(*frames: DataFrame) -> None:
    """Deletes what written() made for ``frames``; nothing may read them any more."""
    for df in frames:
        path = getattr(df, "_scratch", None)
        if path in _WRITTEN:
            _delete(path, *_WRITTEN.pop(path))


@contextmanager
def scratch_scope() -> Iterator[None]:
    """All scratch files written inside are deleted at the end, so results must be stored or collected before."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        for path in set(_WRITTEN) - before:
            _delete(path, *_WRITTEN.pop(path))


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there.

    A reader that loses an executor reads the files again, so nothing is
    computed a second time and no copy is held by one executor only.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
