"""Queries that go through mappers, ingest and saved searches, and the SQL that states the same results."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import extract, keys
from skeinworks.functions.numbers import half_up, number
from skeinworks.operators import items, lifecycle, ranking
from skeinworks.plans.listings import LATEST, NOW, _latest, _ts
from skeinworks.plans.listings_sql import _trim
from skeinworks.session import scratch_path
from skeinworks.sources import config, land, marketplace
from skeinworks.sources.raw import gated
from skeinworks.sources.tables import table
from skeinworks.streaming import ingest
from skeinworks.streaming.snapshot import SnapshotTable

#: The offer store is ingested in two batches, cut at this moment of the last reading.
CUT_NS = 1_750_000_000_000_000_000
#: Saved searches, one of which has run out.
SEARCHES = [
    {"name": "blue", "category": "part", "text": "BLUE"},
    {"name": "gone", "category": "lot", "text": "", "expires_at": "2000-01-01T00:00:00+00:00"},
    {"name": "late", "category": "part", "text": "bolt", "expires_at": "2999-01-01T00:00:00+00:00"},
]


def _raw_offers(spark: SparkSession, d: str) -> DataFrame:
    """The offer store as raw rows, each with its place in the order of arrival."""
    o = table(spark, d, "offers")
    return o.select(
        "source_id", "source_key", F.col("source_url"), "title", "body", "price_cents", "currency", F.col("condition").alias("condition_raw"),
        F.create_map().cast("map<string,string>").alias("aspects"), F.timestamp_micros(F.expr("last_seen_ns div 1000")).alias("seen_at"), F.col("last_seen_ns").alias("position"), "last_seen_ns",
    )


def _ingested(spark: SparkSession, d: str) -> tuple[ingest.Ingester, list[dict[str, int]]]:
    root = scratch_path(spark, "store")
    made = ingest.Ingester(ingest.Source("offers", ingest.drives), SnapshotTable(spark, f"{root}/offers", ingest.OFFERS), SnapshotTable(spark, f"{root}/items", ingest.ITEMS))
    rows = _raw_offers(spark, d)
    # The later part arrives first: the order of arrival decides, not the moment of reading.
    parts = [rows.where(F.col("last_seen_ns") >= CUT_NS), rows.where(~F.coalesce(F.col("last_seen_ns") >= CUT_NS, F.lit(False)))]
    return made, [made.ingest(p.drop("last_seen_ns"), n + 1, _ts(NOW), complete=False) for n, p in enumerate(parts)]


def ingest_state(spark: SparkSession, d: str) -> DataFrame:
    """The offers after two batches through the ingest: the last arrival's price, least price, first and last seen."""
    made, _ = _ingested(spark, d)
    state = made.offers.read()
    return state.select("source_id", "source_key", "price_cents", "min_price_cents", "first_seen", "last_seen", "status")


def ingest_items(spark: SparkSession, d: str) -> DataFrame:
    """The items after two batches through the ingest: the last arrival of each with a title."""
    made, _ = _ingested(spark, d)
    return made.items.read().select("source_id", "source_key", "price_cents", "seen_at", F.col("class"))


def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    """What the ingest counted over its batches, by stage."""
    _, counts = _ingested(spark, d)
    stages = ("fetched", "skipped_offer", "skipped_gate")
    return spark.createDataFrame([(s, sum(c[s] for c in counts)) for s in stages] + [(s, counts[-1][s]) for s in ("offers", "items")], "stage string, n bigint")


def active_categories(spark: SparkSession, d: str) -> DataFrame:
    """The categories in which a saved search that has not run out finds something."""
    live = [w for w in SEARCHES if config.active(w, datetime(2026, 1, 1, tzinfo=UTC))]
    return ranking.matched_watches(_latest(spark, d), live).select("category").distinct()


def get_item(spark: SparkSession, d: str) -> DataFrame:
    """One item by its id: here the least."""
    rows = _latest(spark, d)
    return items.get(rows, rows.agg(F.min("id")).first()[0]).select("id", "source_id", "source_key", "title", "price_cents", "seen_at")


def offer_order(spark: SparkSession, d: str) -> DataFrame:
    """The last seen 200 offers of a marketplace, whatever their status."""
    o = table(spark, d, "offers").select("id", "source_id", "status", "last_seen_ns").distinct()
    return lifecycle.offers_where(o, None, 200, source_id="ebay:us").select("id", "last_seen_ns", "status")


def account_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers of sellers: by listings (volume and recent sales) and by the days between the first and last one."""
    o = table(spark, d, "offers").where("seller is not null").select("id", "seller", "first_seen_ns", "last_seen_ns").distinct()
    at = lambda c: F.timestamp_micros(F.expr(f"{c} div 1000"))
    s = o.groupBy("seller").agg(F.count("*").alias("n"), F.min(F.nullif("first_seen_ns", F.lit(0))).alias("a"), F.max("last_seen_ns").alias("b"))
    return s.select(
        F.sha2("seller", 256).alias("seller_hash"),
        extract.tier(F.col("n"), [(1000, "established"), (100, "mid")], "new").alias("volume_tier"),
        extract.tier(extract.whole_days(at("a"), at("b")), [(365, "established"), (90, "seasoned")], "new").alias("age_tier"),
        extract.tier(F.col("n"), [(100, "active"), (10, "moderate")], "quiet").alias("sales_tier"),
    )


def ships_from(spark: SparkSession, d: str) -> DataFrame:
    """Whether an offer's item is in the country of the buyer; blank says nothing."""
    country = F.get_json_object("aspects_json", "$.item_country")
    return table(spark, d, "offers").select("id", extract.labelled(country, {"true": ("US",)}, "false").alias("ships_from_us")).distinct()


def coordinate_validity(spark: SparkSession, d: str) -> DataFrame:
    """Which lot rows have a usable coordinate."""
    return table(spark, d, "search_lots").select("row_id", extract.placed(F.col("latLong.latitude"), F.col("latLong.longitude")).alias("usable"))


def land_items(spark: SparkSession, d: str) -> DataFrame:
    """Lots through mapper, gate and extractor: acreage from the aspect, and the facts that are passed on."""
    raw = land.mapped(table(spark, d, "search_lots"), "land", "https://lots.example", F.col("fetched_at")).withColumn("batch", F.lit(1)).withColumn("position", F.lit(1))
    passed, _ = gated(raw, "untrusted")
    a = F.col("attributes")
    return ingest.land(passed).select("source_key", "seen_at", half_up(number(a["acreage"]) * 1000).alias("milliacres"), a["location"].alias("location"), a["assessed_value_cents"].alias("assessed_value_cents"), a["days_on_market"].alias("days_on_market"), a["street_address"].alias("street_address"))


def marketplace_rows(spark: SparkSession, d: str) -> DataFrame:
    """Offers in the form of a marketplace's answer, mapped back to raw rows: prices are cut, not rounded; sellers' names go."""
    o = table(spark, d, "offers").where("source_id = 'ebay:us'")
    price = F.concat((F.col("price_cents") / 100).cast("bigint").cast("string"), F.lit("."), F.lpad((F.col("price_cents") % 100).cast("string"), 2, "0"), F.lit("9"))
    item = F.struct(
        F.col("source_key").alias("itemId"), "title", F.col("source_url").alias("itemWebUrl"), F.lit(None).cast("string").alias("condition"), F.col("condition").alias("conditionId"), F.struct(price.alias("value"), F.col("currency").alias("currency")).alias("price"),
        F.struct(F.col("seller").alias("username"), F.get_json_object("aspects_json", "$.seller_feedback_pct").alias("feedbackPercentage"), F.lit(5).alias("feedbackScore")).alias("seller"), F.struct(F.get_json_object("aspects_json", "$.item_country").alias("country")).alias("itemLocation"),
    )
    rows = marketplace.mapped(o.select(F.array(item).alias("itemSummaries")), "ebay:us", "2025-01-01 00:00:00")
    a = F.col("aspects")
    return rows.select("source_key", "title", "price_cents", "condition_raw", a["seller_feedback_pct"].alias("feedback"), a["item_location_country"].alias("country"), a["username"].alias("username"))


QUERIES = {f.__name__: f for f in (ingest_state, ingest_items, ingest_counters, active_categories, get_item, offer_order, account_tiers, ships_from, coordinate_validity, land_items, marketplace_rows)}

_VALID = f"coalesce({_trim('source_id')}, '') <> '' AND coalesce({_trim('source_key')}, '') <> '' AND price_cents >= 0"
_ARRIVED = f"""arrived AS (SELECT *, make_timestamp((last_seen_ns // 1000)::bigint) AS seen, ({_VALID}) AS valid, {_trim("coalesce(title, '')")} <> '' AS titled,
  (coalesce(last_seen_ns < {CUT_NS}, true))::int AS batch FROM offers)"""
ORACLE_SQL = {
    "ingest_state": f"""WITH {_ARRIVED}
SELECT source_id, source_key, arg_max(price_cents, (batch, last_seen_ns)) AS price_cents, coalesce(min(nullif(price_cents, 0)), 0) AS min_price_cents, min(seen) AS first_seen, max(seen) AS last_seen, 'active' AS status
FROM arrived WHERE valid GROUP BY 1, 2""",
    "ingest_items": f"""WITH {_ARRIVED}
SELECT source_id, source_key, arg_max(price_cents, (batch, last_seen_ns)) AS price_cents, arg_max(seen, (batch, last_seen_ns)) AS seen_at, 'untrusted' AS class FROM arrived WHERE valid AND titled GROUP BY 1, 2""",
    "ingest_counters": f"""WITH {_ARRIVED}
SELECT 'fetched' AS stage, count(*) AS n FROM arrived UNION ALL SELECT 'skipped_offer', count(*) FROM arrived WHERE valid IS NOT TRUE UNION ALL SELECT 'skipped_gate', count(*) FROM arrived WHERE NOT titled
UNION ALL SELECT 'offers', count(DISTINCT (source_id, source_key)) FROM arrived WHERE valid UNION ALL SELECT 'items', count(DISTINCT (source_id, source_key)) FROM arrived WHERE valid AND titled""",
    "active_categories": f"WITH {LATEST} SELECT DISTINCT category FROM latest WHERE contains(lower(title), 'blue') OR contains(lower(title), 'bolt')",
    "get_item": f"WITH {LATEST} SELECT id, source_id, source_key, title, price_cents, seen_at FROM latest WHERE id = (SELECT min(id) FROM latest)",
    "offer_order": "SELECT id, last_seen_ns, status FROM (SELECT DISTINCT id, source_id, status, last_seen_ns FROM offers) WHERE source_id = 'ebay:us' ORDER BY last_seen_ns DESC, id LIMIT 200",
    "account_tiers": """
WITH s AS (SELECT seller, count(*) AS n, min(nullif(first_seen_ns, 0)) AS a, max(last_seen_ns) AS b FROM (SELECT DISTINCT id, seller, first_seen_ns, last_seen_ns FROM offers WHERE seller IS NOT NULL) GROUP BY 1),
t AS (SELECT *, CASE WHEN a // 1000 <= b // 1000 THEN (b // 1000 - a // 1000) // 86400000000 END AS days FROM s)
SELECT sha256(seller) AS seller_hash, CASE WHEN n >= 1000 THEN 'established' WHEN n >= 100 THEN 'mid' ELSE 'new' END AS volume_tier,
  CASE WHEN days >= 365 THEN 'established' WHEN days >= 90 THEN 'seasoned' WHEN days IS NOT NULL THEN 'new' END AS age_tier, CASE WHEN n >= 100 THEN 'active' WHEN n >= 10 THEN 'moderate' ELSE 'quiet' END AS sales_tier FROM t""",
    "ships_from": """
SELECT DISTINCT id, CASE WHEN trim(coalesce(json_extract_string(aspects_json, '$.item_country'), '')) = '' THEN NULL WHEN trim(json_extract_string(aspects_json, '$.item_country')) = 'US' THEN 'true' ELSE 'false' END AS ships_from_us FROM offers""",
    "coordinate_validity": "SELECT row_id, coalesce(latLong.latitude <> 0 AND latLong.longitude <> 0 AND abs(latLong.latitude) <= 90 AND abs(latLong.longitude) <= 180, false) AS usable FROM search_lots",
    "land_items": f"""
WITH r AS (SELECT *, {_trim("zpid")} AS k, {_trim("addressCity")} AS c, {_trim("addressState")} AS s, lower({_trim("coalesce(lotArea.unit, '')")}) AS u1, lower({_trim("coalesce(hdpData.homeInfo.lotAreaUnit, '')")}) AS u2, lotArea.value AS v1, hdpData.homeInfo.lotAreaValue AS v2 FROM search_lots),
a AS (SELECT *, coalesce(
  CASE WHEN v1 > 0 THEN CASE WHEN u1 IN ('acres', 'acre', 'ac') THEN v1 WHEN u1 IN ('sqft', 'square feet', 'sq ft', 'sf', '') THEN v1 / 43560.0 END END,
  CASE WHEN v2 > 0 THEN CASE WHEN u2 IN ('acres', 'acre', 'ac') THEN v2 WHEN u2 IN ('sqft', 'square feet', 'sq ft', 'sf', '') THEN v2 / 43560.0 END END) AS acres FROM r WHERE k <> '')
SELECT k AS source_key, fetched_at AS seen_at, floor(acres * 1000 + 0.5)::bigint AS milliacres, CASE WHEN c <> '' THEN CASE WHEN s <> '' THEN c || ', ' || s ELSE c END END AS location,
  CASE WHEN taxAssessedValue > 0 THEN floor(taxAssessedValue * 100 + 0.5)::bigint::varchar END AS assessed_value_cents, CASE WHEN daysOnZillow >= 0 THEN daysOnZillow::varchar END AS days_on_market, nullif({_trim("address")}, '') AS street_address FROM a""",
    "marketplace_rows": """
SELECT source_key, coalesce(title, '') AS title, CASE WHEN price_cents >= 0 THEN price_cents ELSE 0 END AS price_cents, coalesce(nullif(condition, ''), '') AS condition_raw, nullif(trim(json_extract_string(aspects_json, '$.seller_feedback_pct')), '') AS feedback,
  nullif(trim(json_extract_string(aspects_json, '$.item_country')), '') AS country, NULL::varchar AS username FROM offers WHERE source_id = 'ebay:us' AND trim(source_key) <> ''""",
}
