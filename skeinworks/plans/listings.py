"""Queries over listings: the order lines read as observations of (supplier, part), and the domain tables.

An order line stands for one observation of the listing ``shop:<supplier>`` /
``<part>``: its title names the part and a capacity, its price is unknown on
line 7, and its condition code follows the return flag. The arrival order is
the total order of the line's own columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import extract, keys, text
from skeinworks.functions.numbers import cents_rounded, half_up, number
from skeinworks.operators import enrich, filters, items, lifecycle, ranking, reference
from skeinworks.session import written
from skeinworks.sources import land, storefront
from skeinworks.sources.tables import table

ARRIVAL = ["l_shipdate", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
NOW = "2001-12-01 00:00:00"

#: Saved searches: name, words of the title, and how many of the most recent matches count.
WATCHES = [
    {"name": "blue", "category": "part", "text": "BLUE", "limit": 400},
    {"name": "bolts", "category": "part", "text": "bolt", "limit": 900},
    {"name": "all", "category": "part", "text": "", "limit": 1500},
]


def _ts(value: str):
    return F.lit(value).cast("timestamp")


def _observed(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    code = F.when(F.col("l_returnflag") == "N", "1000").when(F.col("l_returnflag") == "R", "2500").otherwise("3000")
    source, key = F.concat(F.lit("shop:"), F.col("l_suppkey").cast("string")), F.col("l_partkey").cast("string")
    return lines.select(
        keys.listing_id(source, key).alias("id"),
        source.alias("source_id"),
        key.alias("source_key"),
        F.lit("part").alias("category"),
        F.concat_ws(" ", "p_name", "p_brand", F.concat(F.col("p_size").cast("string"), F.lit("TB")), "p_type").alias("title"),
        F.when(F.col("l_linenumber") == 7, F.lit(0)).otherwise(F.floor(F.col("l_extendedprice") * 100 + 0.5)).cast("bigint").alias("price_cents"),
        code.alias("condition_raw"),
        F.col("l_shipdate").cast("timestamp").alias("seen_at"),
        *ARRIVAL,
    )


OBSERVED = """observed AS (
  SELECT substring(sha256('shop:' || l_suppkey || chr(0) || l_partkey), 1, 16) AS id, 'shop:' || l_suppkey AS source_id,
         l_partkey::varchar AS source_key, 'part' AS category, p_name || ' ' || p_brand || ' ' || p_size || 'TB ' || p_type AS title,
         CASE WHEN l_linenumber = 7 THEN 0 ELSE floor(l_extendedprice * 100 + 0.5)::bigint END AS price_cents,
         CASE l_returnflag WHEN 'N' THEN '1000' WHEN 'R' THEN '2500' ELSE '3000' END AS condition_raw, l_shipdate AS seen_at,
         row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
LATEST = OBSERVED + """,
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM observed) WHERE rn = 1)"""
TYPED = LATEST + """,
typed AS (
  SELECT *, regexp_extract(title, '([0-9]+(?:\\.[0-9]+)?)\\s*(TB|tb|GB|gb)\\b', 1) AS capacity_tb,
         CASE condition_raw WHEN '1000' THEN 'new' WHEN '2500' THEN 'refurb' ELSE 'used' END AS condition FROM latest)"""


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return items.latest(_observed(spark, d), "id", ARRIVAL)


def _typed(spark: SparkSession, d: str) -> DataFrame:
    rows = _latest(spark, d)
    capacity = extract.capacity_tb(F.col("title"))
    return rows.select("id", "source_id", "category", "title", "price_cents", "seen_at", capacity.alias("capacity_tb"), extract.condition(F.col("condition_raw"), F.col("title")).alias("condition")).withColumn(
        "attributes", F.create_map(F.lit("capacity_tb"), F.col("capacity_tb"))
    )


def item_latest(spark: SparkSession, d: str) -> DataFrame:
    """Replace by id: the last arrival of every listing."""
    return _latest(spark, d).select("id", "source_id", "source_key", "title", "price_cents", "condition_raw", "seen_at")


def item_validation(spark: SparkSession, d: str) -> DataFrame:
    """The first invalid field of each offer, counted: rejects of a batch by field."""
    why = items.invalid_field(["source_id", "source_key", "title"], ["price_cents", "min_price_cents"], {"status": ["active", "expired"]})
    return table(spark, d, "offers").select(F.coalesce(why, F.lit("")).alias("invalid_field")).groupBy("invalid_field").agg(F.count("*").alias("n"))


def search_text(spark: SparkSession, d: str) -> DataFrame:
    """Case-insensitive substring of the title, all characters literal."""
    return items.matching(_latest(spark, d), items.ItemQuery(text="Red BOLT")).select("id", "title")


def search_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Substring of the title or of any word of it, over offers."""
    rows = table(spark, d, "offers").select("id", "title").distinct().withColumn("tokens", text.tokens(F.col("title")))
    return items.matching(rows, items.ItemQuery(text="16t")).select("id", "title")


def search_price_bound(spark: SparkSession, d: str) -> DataFrame:
    """A bound on the price leaves out unknown prices."""
    return items.matching(_latest(spark, d), items.ItemQuery(max_price_cents=1_000_000)).select("id", "price_cents")


def search_since_topk(spark: SparkSession, d: str) -> DataFrame:
    """The most recent 500 since a moment, of one source family."""
    query = items.ItemQuery(equals=(("category", "part"),), since=_ts("2000-01-01 00:00:00"), limit=500)
    return items.search(_latest(spark, d), query).select("id", "seen_at")


def search_source(spark: SparkSession, d: str) -> DataFrame:
    """The items of one source, without the stale ones."""
    rows = items.without_stale(_latest(spark, d), "shop:7", _ts("2000-01-01 00:00:00"))
    return items.matching(rows, items.ItemQuery(equals=(("source_id", "shop:7"),))).select("id", "seen_at")


def deterministic_id(spark: SparkSession, d: str) -> DataFrame:
    """The id of every source and key."""
    return table(spark, d, "offers").select("source_id", "source_key", keys.listing_id(F.col("source_id"), F.col("source_key")).alias("listing_id")).distinct()


def extract_capacity(spark: SparkSession, d: str) -> DataFrame:
    """Terabytes from offer titles, a stated aspect first."""
    stated = F.get_json_object("aspects_json", "$.capacity_tb")
    return table(spark, d, "offers").select("id", "title", extract.capacity_tb(F.col("title"), stated).alias("capacity_tb")).distinct()


def extract_condition(spark: SparkSession, d: str) -> DataFrame:
    """The condition by code, else by words of the title."""
    return table(spark, d, "offers").select("id", "title", extract.condition(F.col("condition"), F.col("title")).alias("condition_name")).distinct()


def extract_model(spark: SparkSession, d: str) -> DataFrame:
    """Model numbers of the known shapes in offer titles and part numbers."""
    words = F.concat_ws(" ", "title", F.upper("hint_mpn"))
    return table(spark, d, "offers").select("id", words.alias("words"), extract.model_number(words).alias("model_number")).distinct()


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    """The distinct words of every document, sorted for comparison."""
    found = F.sort_array(text.tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(found).alias("n_tokens"), F.sha2(F.array_join(found, " "), 256).alias("tokens_hash")).where("n_tokens >= 0")


def seller_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Coarse tiers of a percentage and of a count."""
    pct = number(F.get_json_object("aspects_json", "$.seller_feedback_pct"))
    high = extract.tier(pct, [(99.0, "high"), (97.0, "good"), (90.0, "mixed")], "low")
    price = extract.tier(F.col("price_cents"), [(100_000, "established"), (10_000, "mid")], "new")
    return table(spark, d, "offers").select("id", high.alias("feedback_tier"), price.alias("volume_tier")).distinct()


def hard_filter_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the first check it fails."""
    spec = filters.HardFilter(category="part", needs_price=True, max_price_cents=6_000_000, least={"capacity_tb": 6.0}, most={"capacity_tb": 40.0}, conditions=("new", "refurb"))
    return filters.explained(_typed(spark, d), spec).select("id", F.coalesce("reason", F.lit("")).alias("reason"))


def _per_tb(rows: DataFrame) -> DataFrame:
    capacity = number(F.col("capacity_tb"))
    usable = rows.where((F.col("price_cents") > 0) & (capacity > 0) & (F.col("condition") != ""))
    return usable.select("*", half_up(F.col("price_cents") / capacity).alias("cents_per_tb"), half_up(capacity * 10).alias("bucket"))


PER_TB = TYPED + """,
per_tb AS (
  SELECT *, floor(price_cents / capacity_tb::double + 0.5)::bigint AS cents_per_tb, floor(capacity_tb::double * 10 + 0.5)::bigint AS bucket
  FROM typed WHERE price_cents > 0 AND capacity_tb <> '' AND capacity_tb::double > 0),
medians AS (
  SELECT bucket, condition, floor(median(cents_per_tb) + 0.5)::bigint AS reference, count(*) AS n FROM per_tb GROUP BY ALL)"""


def reference_median(spark: SparkSession, d: str) -> DataFrame:
    """The median cents per terabyte of every bucket and condition with at least 3 rows."""
    return reference.grouped_median(_per_tb(_typed(spark, d)), ["bucket", "condition"], "cents_per_tb", least=3)


def reference_recent(spark: SparkSession, d: str) -> DataFrame:
    """The same over the items seen in the 30 days before a moment."""
    now = _ts("1998-06-01 00:00:00")
    rows = _typed(spark, d).where((F.col("seen_at") >= now - F.expr("interval 30 days")) & (F.col("seen_at") <= now))
    return reference.grouped_median(_per_tb(rows), ["bucket", "condition"], "cents_per_tb", least=3)


def reference_median_brand(spark: SparkSession, d: str) -> DataFrame:
    """The same by brand too, where some groups are too small."""
    rows = _per_tb(_typed(spark, d)).withColumn("brand", F.regexp_extract("title", "(Brand#[0-9]+)", 1))
    return reference.grouped_median(rows, ["bucket", "brand", "condition"], "cents_per_tb", least=3)


def reference_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Every priced item against the median of its size, brand and condition or, failing that, the scaled median of refurbished ones."""
    brand = F.regexp_extract("title", "(Brand#[0-9]+)", 1)
    rows = _per_tb(_typed(spark, d)).select("id", "condition", "cents_per_tb", F.concat_ws("|", F.col("bucket").cast("string"), brand).alias("bucket"))
    rows = written(rows, "per_tb")  # read for the medians and for the rows they are looked up for
    medians = reference.grouped_median(rows, ["bucket", "condition"], "cents_per_tb", least=3)
    out = reference.with_reference(rows, medians, "bucket", "condition", "refurb", {"new": 1.35, "used": 0.75})
    return out.select("id", "reference", "reference_from", reference.ratio(F.col("cents_per_tb"), F.col("reference")).alias("ratio"))


def _surface(spark: SparkSession, d: str, recent: int) -> DataFrame:
    """The most recent items, then the filter, then the reference, then ranks: the limit counts before the filter."""
    typed = written(_typed(spark, d), "typed")
    recent_rows = items.search(typed, items.ItemQuery(limit=recent))
    spec = filters.HardFilter(needs_price=True, least={"capacity_tb": 6.0})
    rows = _per_tb(filters.explained(recent_rows, spec).where("reason is null"))
    medians = reference.grouped_median(_per_tb(typed), ["bucket", "condition"], "cents_per_tb", least=3)
    scored = reference.with_reference(rows, medians, "bucket", "condition", "refurb", {"new": 1.35, "used": 0.75})
    scored = scored.withColumn("ratio", reference.ratio(F.col("cents_per_tb"), F.col("reference")))
    return ranking.ranked(scored, [F.asc("ratio"), F.asc("id")], []).select("rank", "id", "ratio")


def surface_ranked(spark: SparkSession, d: str) -> DataFrame:
    """A ranked report of the 5,000 most recent items that pass the filter."""
    return _surface(spark, d, 5000)


def limit_before_rank(spark: SparkSession, d: str) -> DataFrame:
    """The limit goes by recency: fewer rows than 50 are ranked."""
    return _surface(spark, d, 50)


def _watched(spark: SparkSession, d: str) -> DataFrame:
    rows = ranking.matched_watches(_typed(spark, d), WATCHES)
    spec = filters.HardFilter(needs_price=True, least={"capacity_tb": 6.0})
    return _per_tb(filters.explained(rows, spec).where("reason is null"))


def watch_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Each saved search's most recent matches that pass the filter, ranked."""
    return ranking.ranked(_watched(spark, d), [F.asc("cents_per_tb"), F.asc("id")], ["watch"]).select("watch", "rank", "id")


def watch_strong(spark: SparkSession, d: str) -> DataFrame:
    """The strong ones among them, numbered anew."""
    strong = _watched(spark, d).where("cents_per_tb <= 120000")
    return ranking.ranked(strong, [F.asc("cents_per_tb"), F.asc("id")], ["watch"]).select("watch", "rank", "id")


def watch_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and strong ones of each saved search."""
    return _watched(spark, d).groupBy("watch").agg(F.count("*").alias("candidates"), F.count_if(F.col("cents_per_tb") <= 120_000).alias("strong"))


def _as_offers(spark: SparkSession, d: str) -> DataFrame:
    rows = _observed(spark, d)
    return rows.select("id", "source_id", "source_key", "title", "price_cents", F.col("seen_at").alias("first_seen"), F.col("seen_at").alias("last_seen"), F.col("price_cents").alias("min_price_cents"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("expired_at"), *ARRIVAL)


FOLD = OBSERVED + """,
fold AS (
  SELECT id, arg_max(source_id, seq) AS source_id, arg_max(title, seq) AS title, arg_max(price_cents, seq) AS price_cents,
         min(seen_at) AS first_seen, max(seen_at) AS last_seen, coalesce(min(nullif(price_cents, 0)), 0) AS min_price_cents
  FROM observed GROUP BY id)"""


def offer_fold(spark: SparkSession, d: str) -> DataFrame:
    """First and last seen, least known price, the rest from the last arrival."""
    return lifecycle.folded(_as_offers(spark, d), ARRIVAL).select("id", "source_id", "title", "price_cents", "first_seen", "last_seen", "min_price_cents")


def offer_expire(spark: SparkSession, d: str) -> DataFrame:
    """Offers of one source not seen for 500 days are expired; the others stay active."""
    state = lifecycle.folded(_as_offers(spark, d), ARRIVAL)
    out = lifecycle.expired(state, "shop:3", _ts(NOW) - F.expr("interval 500 days"), _ts(NOW))
    return out.select("id", "status", "expired_at")


def offer_expire_by_source(spark: SparkSession, d: str) -> DataFrame:
    """Expiry with each source's own window, in one pass."""
    state = lifecycle.folded(_as_offers(spark, d), ARRIVAL)
    windows = table(spark, d, "supplier").select(F.concat(F.lit("shop:"), F.col("s_suppkey").cast("string")).alias("source_id"), (F.col("s_nationkey") * 50 * 86400).cast("bigint").alias("seconds"))
    return lifecycle.expired_by_source(state, windows, _ts(NOW)).groupBy("source_id", "status").agg(F.count("*").alias("n"))


def offer_retention(spark: SparkSession, d: str) -> DataFrame:
    """What is left after deleting offers not seen for 900 days, whatever their status."""
    state = lifecycle.folded(_as_offers(spark, d), ARRIVAL)
    return lifecycle.retained(state, None, _ts(NOW) - F.expr("interval 900 days")).select("id", "last_seen")


def offer_revival(spark: SparkSession, d: str) -> DataFrame:
    """A later observation revives an expired offer: state and batch folded together."""
    rows = _as_offers(spark, d)
    cut = _ts("2000-06-01 00:00:00")
    state = lifecycle.expired(lifecycle.folded(rows.where(F.col("last_seen") < cut), ARRIVAL), None, cut - F.expr("interval 100 days"), cut)
    return lifecycle.folded(state.unionByName(rows.where(F.col("last_seen") >= cut)), ARRIVAL).select("id", "status", "expired_at", "first_seen", "last_seen", "min_price_cents")


def offer_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last state of each offer of the offer store, which holds older rows too."""
    return items.latest(table(spark, d, "offers").select("id", "source_id", "price_cents", "status", "last_seen_ns", "min_price_cents", "title"), "id", ["last_seen_ns", "title", "price_cents", "min_price_cents", "status"])


def offer_query_default(spark: SparkSession, d: str) -> DataFrame:
    """The active offers of a marketplace."""
    return lifecycle.offers_where(offer_latest(spark, d), source_id="ebay:us").select("id", "price_cents")


def offers_by_product(spark: SparkSession, d: str) -> DataFrame:
    """Offers of one provisional product key; a blank key is no product."""
    rows = table(spark, d, "offers").select("id", "provisional_key", "seller", "price_cents").distinct()
    return lifecycle.products(rows)


def provisional_key(spark: SparkSession, d: str) -> DataFrame:
    """The grouping key of brand, part number and model hints."""
    return table(spark, d, "offers").select("id", keys.product_key(F.col("hint_mpn"), F.col("hint_brand"), F.col("hint_model")).alias("product_key")).distinct()


def land_acreage(spark: SparkSession, d: str) -> DataFrame:
    """Acres named in land remarks: acres, ac, or square feet."""
    return table(spark, d, "documents").select("doc_id", extract.acreage(F.col("text")).alias("acreage")).where("acreage is not null")


def land_flags(spark: SparkSession, d: str) -> DataFrame:
    """The facts that phrases of a description give."""
    f = extract.flags(F.col("text"))
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", *[F.coalesce(f[name], F.lit("")).alias(name) for name in extract.FLAGS], extract.parcel_number(F.col("text")).alias("apn"))
    return rows.where(" or ".join(f"{name} <> ''" for name in [*extract.FLAGS, "apn"]))


def land_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lots mapped to raw rows, with typed aspects."""
    rows = land.mapped(table(spark, d, "search_lots"), "land", "https://lots.example", F.col("fetched_at"))
    a = F.col("aspects")
    return rows.select("source_key", "source_url", "title", "price_cents", "seen_at", a["location"].alias("location"), a["zip"].alias("zip"), a["assessed_value_cents"].alias("assessed_value_cents"), a["days_on_market"].alias("days_on_market"), (half_up(number(a["acreage"]) * 1000)).alias("milliacres"))


def storefront_variants(spark: SparkSession, d: str) -> DataFrame:
    """Catalogue variants mapped to raw rows: available ones of the allowed product types."""
    rows = _storefront(spark, d)
    return rows.select("source_id", "source_key", "source_url", "title", "price_cents", "condition_raw", F.col("aspects")["capacity_tb"].alias("capacity_tb"), "hint_brand", "hint_mpn", "seen_at")


def _storefront(spark: SparkSession, d: str) -> DataFrame:
    found = table(spark, d, "products")
    return storefront.mapped(found, F.col("source_id"), "https://shop.example", F.col("fetched_at"), ["hard drives", "HDDs"], brand_tag="brand:", sku_suffixes=["_SR", "_UG", "_P"])


def html_strip(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions without markup."""
    return table(spark, d, "products").select("row_id", text.stripped_html(F.col("body_html")).alias("plain"))


def valuation_feed(spark: SparkSession, d: str) -> DataFrame:
    """The median cents per terabyte of a feed's available variants, by capacity and condition."""
    rows = storefront.feed(table(spark, d, "products")).select("condition", half_up(F.col("capacity_tb") * 10).alias("bucket"), half_up(F.col("price_cents") / F.col("capacity_tb")).alias("cents_per_tb"))
    return reference.grouped_median(rows, ["bucket", "condition"], "cents_per_tb")


def seller_profile_join(spark: SparkSession, d: str) -> DataFrame:
    """Offers with the figures of their seller, looked up once per seller; the name is dropped."""
    rows = table(spark, d, "offers").select("id", "seller", "title").distinct()
    facts = rows.where("seller is not null").groupBy("seller").agg(F.count("*").alias("listed"))
    return enrich.looked_up(rows, facts, ["seller"], drop=["seller"]).select("id", "title", F.coalesce("listed", F.lit(0)).alias("listed"))


def event_offers(spark: SparkSession, d: str) -> DataFrame:
    """Events read as observations: the fold over a stream's rows."""
    e = table(spark, d, "events")
    key = keys.listing_id(F.col("event_type"), F.col("user_id").cast("string"))
    cents = cents_rounded(F.col("value"))
    at = F.col("ts").cast("timestamp")
    rows = e.select(key.alias("id"), F.col("event_type").alias("source_id"), cents.alias("price_cents"), at.alias("first_seen"), at.alias("last_seen"), cents.alias("min_price_cents"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("expired_at"), "event_id")
    return lifecycle.folded(rows, ["event_id"]).select("id", "source_id", "price_cents", "first_seen", "last_seen", "min_price_cents")


QUERIES = {
    f.__name__: f
    for f in (
        item_latest, item_validation, search_text, search_tokens, search_price_bound, search_since_topk, search_source, deterministic_id, extract_capacity, extract_condition, extract_model,
        tokenize, seller_tiers, hard_filter_reasons, reference_median, reference_recent, reference_median_brand, reference_ratio, surface_ranked, limit_before_rank, watch_candidates, watch_strong, watch_counts,
        offer_fold, offer_expire, offer_expire_by_source, offer_retention, offer_revival, offer_latest, offer_query_default, offers_by_product, provisional_key,
        land_acreage, land_flags, land_rows, storefront_variants, html_strip, valuation_feed, seller_profile_join, event_offers,
    )
}
