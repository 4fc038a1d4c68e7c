"""Ingest of raw rows in micro-batches: offers first, then gate, extraction and items, then housekeeping.

One streaming query or loop serves one source, so that a failing source stops
no other. Each batch folds its rows into the offer state, extracts the valid
ones to items, and only then expires and deletes, and only for fetches that
were complete. A batch that is run again after a failure folds the same rows
into the state once more, which changes nothing: the fold is idempotent.

The order of arrival is total: batch, then the row's ``position`` in it where
the source gives one (a bigint column), else the moment it was seen, and the
content of the row last. A row that arrives later wins, also where it was seen
earlier. Each source writes its own part of the shared tables.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import extract, keys, text
from skeinworks.operators import items, lifecycle
from skeinworks.session import discard, written
from skeinworks.sources.http import BudgetSpent
from skeinworks.sources.raw import gated
from skeinworks.streaming.snapshot import SnapshotTable

OFFERS = "id string, source_id string, source_key string, source_url string, title string, body string, price_cents bigint, currency string, condition string, first_seen timestamp, last_seen timestamp, min_price_cents bigint, status string, expired_at timestamp, batch bigint, position bigint"
ITEMS = "id string, category string, class string, title string, canonical_id string, price_cents bigint, currency string, condition string, source_id string, source_key string, source_url string, seen_at timestamp, attributes map<string,string>, tokens array<string>, batch bigint, position bigint"


#: The columns that say when a row arrived.
ORDER = ("batch", "position")


def as_offers(raw: DataFrame) -> DataFrame:
    """Observations of offers; ``raw`` has the columns of ORDER."""
    return raw.select(
        keys.listing_id(F.col("source_id"), F.col("source_key")).alias("id"), "source_id", "source_key", "source_url", "title", "body", "price_cents", "currency", F.col("condition_raw").alias("condition"),
        F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.col("price_cents").alias("min_price_cents"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("expired_at"), *ORDER,
    )


def drives(passed: DataFrame) -> DataFrame:
    """Items of drives: capacity, model, condition and words of gated rows."""
    capacity = extract.capacity_tb(F.col("title"), F.col("aspects")["capacity_tb"])
    attributes = F.map_filter(F.create_map(F.lit("capacity_tb"), capacity), lambda _, v: v.isNotNull())
    return _item(passed, "drive", extract.model_number(F.col("title")), extract.condition(F.col("condition_raw"), F.col("title")), attributes)


def land(passed: DataFrame) -> DataFrame:
    """Items of land: acreage, flags, parcel number and stated facts of gated rows."""
    words = F.concat_ws("\n", "title", "body")
    acreage = F.map_filter(F.create_map(F.lit("acreage"), extract.acreage(words, F.col("aspects")["acreage"])), lambda _, v: v.isNotNull())
    stated = F.map_filter("aspects", lambda k, v: k.isin("location", "lat", "lon", "street_address", "assessed_value_cents", "days_on_market") & (text.trim_all(v) != ""))
    return _item(passed, "land", extract.parcel_number(words), F.lit(""), F.map_concat(acreage, extract.flags(words), stated))


def _item(rows: DataFrame, category: str, canonical: Column, condition: Column, attributes: Column) -> DataFrame:
    return rows.select(
        keys.listing_id(F.col("source_id"), F.col("source_key")).alias("id"), F.lit(category).alias("category"), F.col("boundary").alias("class"), "title", canonical.alias("canonical_id"), "price_cents", "currency", condition.alias("condition"),
        "source_id", "source_key", "source_url", "seen_at", attributes.alias("attributes"), text.tokens(F.col("title")).alias("tokens"), *ORDER,
    )


@dataclass
class Source:
    """What is done with one source's rows; without ``extractor`` only offers are kept. Windows are in seconds, 0 is none.

    Windows that contradict each other raise ValueError before anything is read or deleted.
    """

    name: str
    extractor: Callable[[DataFrame], DataFrame] | None = None
    stale_items: int = 0
    expire_after: int = 0
    delete_after: int = 0

    def __post_init__(self) -> None:
        for window in ("stale_items", "expire_after", "delete_after"):
            if getattr(self, window) < 0:
                raise ValueError(f"{self.name}: {window} must not be negative")
        if self.delete_after and self.delete_after < self.expire_after:
            raise ValueError(f"{self.name}: offers would be deleted before they expire")


@dataclass
class Ingester:
    """Folds batches of one source into the offer and item tables."""

    source: Source
    offers: SnapshotTable
    items: SnapshotTable
    last_counts: dict[str, int] = field(default_factory=dict)

    def ingest(self, raw: DataFrame, batch: int, now: Column, complete: bool = True) -> dict[str, int]:
        """One batch; returns its counts by stage. ``raw`` has the raw columns and, where the source gives it, ``position``."""
        position = F.coalesce("position", F.unix_micros("seen_at")) if "position" in raw.columns else F.unix_micros("seen_at")
        why = items.invalid_field(["source_id", "source_key"], ["price_cents"])
        ordered = raw.withColumn("position", position).withColumn("batch", F.lit(batch).cast("bigint")).withColumn("_why", why)
        ordered = written(ordered, "batch")  # read for offers, items and counts
        counts = ordered.agg(F.count("*").alias("fetched"), F.count("_why").alias("skipped_offer")).first().asDict()
        name = self.source.name
        now = F.timestamp_micros(F.lit(raw.sparkSession.range(1).select(F.unix_micros(now)).first()[0]))  # one moment for the whole batch
        cut = lambda seconds: now - F.make_dt_interval(secs=F.lit(seconds))

        def offers(state: DataFrame) -> DataFrame:
            state = lifecycle.folded(state.unionByName(as_offers(ordered.where("_why is null"))), list(ORDER))
            if complete and self.source.expire_after > 0:
                state = lifecycle.expired(state, None, cut(self.source.expire_after), now)
            if complete and self.source.delete_after > 0:
                state = lifecycle.retained(state, None, cut(self.source.delete_after))
            return state

        counts["offers"] = self._saved(self.offers, offers, "offers")
        counts["expired"] = self._last.read(self._at, name).where((F.col("status") == "expired") & F.coalesce(F.col("expired_at") == now, F.lit(False))).count() if complete and self.source.expire_after > 0 else 0
        if self.source.extractor:
            passed, skipped = gated(ordered, "untrusted", F.when(text.trim_all(F.coalesce("title", F.lit(""))) == "", F.lit("no title")))
            counts["skipped_gate"] = skipped.count()
            bad = items.invalid_field(["id", "category", "source_id", "source_key"], ["price_cents"])
            found = written(self.source.extractor(passed).withColumn("_bad", bad), "found")
            counts["skipped_extract"] = found.where("_bad is not null").count()

            def stored(state: DataFrame) -> DataFrame:
                state = items.replaced(state, found.where("_bad is null").drop("_bad"), "id", list(ORDER))
                return items.without_stale(state, None, cut(self.source.stale_items)) if complete and self.source.stale_items > 0 else state

            counts["items"] = self._saved(self.items, stored, "items")
            discard(found)
        discard(ordered)
        self.last_counts = counts
        return counts

    def _saved(self, table: SnapshotTable, change: Callable[[DataFrame], DataFrame], name: str) -> int:
        """The rows of this source's part after the change; they are counted while they are written."""
        made: list[Observation] = []

        def observed(state: DataFrame) -> DataFrame:
            made.append(Observation(f"{name}-{uuid.uuid4().hex}"))
            return change(state).observe(made[-1], F.count(F.lit(1)).alias("n"))

        self._last, self._at = table, table.update(observed, self.source.name)
        return made[-1].get["n"]


@dataclass
class Poller:
    """Fetches and ingests sources on and on, each in its own thread; no error of one stops it or another.

    ``fetch`` gives (raw rows, complete) of a source. A spent budget is no
    error: the source waits for its next turn. ``health`` has the turns, errors and
    last error of each source.
    """

    ingesters: list[Ingester]
    fetch: Callable[[str], tuple[DataFrame, bool]]
    now: Callable[[], Column]
    every: float = 1800.0
    health: dict[str, dict] = field(default_factory=dict)
    stopped: threading.Event = field(default_factory=threading.Event)

    def turn(self, ingester: Ingester) -> None:
        """One fetch and ingest of a source."""
        name = ingester.source.name
        state = self.health.setdefault(name, {"turns": 0, "errors": 0, "waits": 0, "error": None, "counts": {}})
        state["turns"] += 1
        try:
            rows, complete = self.fetch(name)
            state["counts"] = ingester.ingest(rows, time.time_ns(), self.now(), complete)
            state["error"] = None
        except BudgetSpent:
            state["waits"] += 1
        except Exception as e:  # noqa: BLE001  whatever a source does wrong stays its own
            state["errors"] += 1
            state["error"] = str(e)[:500]

    def _loop(self, ingester: Ingester, turns: int | None) -> None:
        done = 0
        while not self.stopped.is_set() and (turns is None or done < turns):
            self.turn(ingester)
            done += 1
            if turns is None or done < turns:
                self.stopped.wait(self.every)

    def start(self, turns: int | None = None) -> list[threading.Thread]:
        """Starts a thread for each source, for ever or for a number of turns; stop with ``stopped.set()``."""
        threads = [threading.Thread(target=self._loop, args=(i, turns), daemon=True, name=f"poll {i.source.name}") for i in self.ingesters]
        for t in threads:
            t.start()
        return threads


def stream(spark: SparkSession, rows: DataFrame, ingester: Ingester, checkpoint: str, now: Callable[[], Column], complete: Callable[[DataFrame], bool] = lambda _: True, every: str | None = None):
    """Starts the query that ingests a stream of raw rows; without ``every`` it takes what there is and ends."""

    def each(batch: DataFrame, number: int) -> None:
        ingester.ingest(batch, number + 1, now(), complete(batch))

    writer = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(f"ingest {ingester.source.name}")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, at: str, keys_: list[str], late: str, width: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of a stream by event time, rows later than ``late`` left out."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return rows.groupBy(window, *keys_).agg(F.count("*").alias("n"))
