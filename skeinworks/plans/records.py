"""Queries over the record operators: the general problems over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions import units
from skeinworks.functions.text import trim_all
from skeinworks.operators import history, nested, packed, proximity, quantities
from skeinworks.session import shuffle_partitions, written
from skeinworks.sources.tables import table

VARIANT = nested.TableRule(
    "variant",
    "variants",
    columns={"title": ("title",), "price": ("price.amount", "price"), "sku": ("sku",), "available": ("available",), "option1": ("option1",)},
)
PRODUCT = nested.TableRule(
    "product",
    "products",
    columns={"title": ("title",), "vendor": ("vendor",), "handle": ("handle",), "product_type": ("product_type",)},
    children=(VARIANT,),
)


def _catalogue(spark: SparkSession, directory: str) -> str:
    """The path of the tagged rows of all catalogue records, typed and JSON."""
    typed = table(spark, directory, "products")
    pages = table(spark, directory, "raw_pages")
    rows = nested.emit_typed(typed, PRODUCT, F.concat(F.lit("p:"), F.col("row_id").cast("string")), F.col("fetched_at"))
    keyed = pages.withColumn("_key", F.concat(F.lit("r:"), F.col("page_id").cast("string")))
    wide = shuffle_partitions(spark)
    if keyed.rdd.getNumPartitions() < wide:  # few large rows in few files: they are spread; many files are read as they are
        keyed = keyed.repartition(wide, "page_id")
    return nested.write_tables(rows.unionByName(nested.emit_json(keyed, PRODUCT, "_key", "body", "fetched_at")))


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    """The variants each product had in its latest fetch that states them."""
    tagged = nested.read_tagged(spark, _catalogue(spark, directory))
    return nested.latest_children(tagged, "product", "variant").select(F.col("root_id").alias("product_id"), F.col("own_id").alias("variant_id"))


def p1_products(spark: SparkSession, directory: str) -> DataFrame:
    """The flat product table: one row per product object of any record."""
    rows = nested.read_table(spark, _catalogue(spark, directory), "product", "title string, vendor string, handle string, product_type string")
    return rows.select("pk", F.col("own_id").alias("product_id"), F.col("version").alias("fetched_at"), F.col("children")["variant"].alias("n_variants"), "title", "vendor", "handle", "product_type")


def p1_variants(spark: SparkSession, directory: str) -> DataFrame:
    """The flat variant table: every variant names its product row."""
    rows = nested.read_table(spark, _catalogue(spark, directory), "variant", "title string, price string, sku string, available boolean, option1 string")
    return rows.select("pk", F.col("parent_pk").alias("product_pk"), F.col("own_id").alias("variant_id"), F.col("root_id").alias("product_id"), "ordinal", "title", "price", "sku", "available", "option1")


def _offer_versions(spark: SparkSession, directory: str) -> DataFrame:
    status = F.lower(trim_all("status"))
    readings = table(spark, directory, "offer_snapshots").select(
        "id",
        "taken_ns",
        "loaded_at",
        "row_id",
        F.expr("nullif(first_seen_ns, 0)").alias("first_seen_ns"),
        F.expr("nullif(min_price_cents, 0)").alias("min_price_cents"),
        F.when(status != "", status).alias("status"),
    )
    return history.versions(readings, "id", "taken_ns", "loaded_at", "row_id", ["first_seen_ns", "min_price_cents", "status"])


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    """The versions of each offer and the time each was valid."""
    return _offer_versions(spark, directory).select("id", F.col("valid_from").alias("valid_from_ns"), F.col("valid_to").alias("valid_to_ns"))


def p6_versions(spark: SparkSession, directory: str) -> DataFrame:
    """The versions of each offer with the attributes that held."""
    return _offer_versions(spark, directory).select("id", F.col("valid_from").alias("valid_from_ns"), F.col("valid_to").alias("valid_to_ns"), "first_seen_ns", "min_price_cents", "status")


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    """Every value of tags and product_type with its position in the row's field."""
    return packed.values(table(spark, directory, "products"), "row_id", ["tags", "product_type"]).select("row_id", "field", "pos", "val")


def _lots(spark: SparkSession, directory: str) -> DataFrame:
    lat, lon = F.col("latLong.latitude"), F.col("latLong.longitude")
    rows = table(spark, directory, "search_lots").where((lat != 0) & (lon != 0))
    return proximity.clean_points(rows, "zpid", lat, lon)


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    """Lots at most 250 m from each other, and the flood zones lots lie in."""
    lots = written(_lots(spark, directory), "lots")
    zones_ = written(proximity.clean_regions(table(spark, directory, "flood_zones"), "zone_id", "ring"), "zones")
    ended, placed, outlines = proximity.joined_leaves(lots, 250.0, zones_)
    placed = written(placed, "placed")
    near = proximity.near_pairs(ended, placed, 250.0)
    zones = proximity.regions_of(ended, placed, outlines)
    kind = lambda df, name, a, b: df.select(F.lit(name).alias("kind"), F.col(a).alias("key_a"), F.col(b).alias("key_b"))
    return kind(near, "lot", "key_a", "key_b").unionByName(kind(zones, "zone", "key", "region"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    """Lot areas in hundredths of an acre and drive capacities in gigabytes."""
    home = F.col("hdpData.homeInfo")
    lots = quantities.amounts(table(spark, directory, "search_lots"), "row_id", home["lotAreaValue"], home["lotAreaUnit"], F.col("lotArea.formatted"), units.AREA, units.ACRE / 100)
    drives = quantities.gigabytes(table(spark, directory, "products"), "row_id", F.col("product_type"))
    kind = lambda df, name: df.select(F.lit(name).alias("kind"), "row_id", "amount")
    return kind(lots, "lot").unionByName(kind(drives, "product"))


def p4_lots(spark: SparkSession, directory: str) -> DataFrame:
    """Lot areas in hundredths of an acre."""
    return p4_found(spark, directory).where("kind = 'lot'").select("row_id", "amount")


QUERIES = {f.__name__: f for f in (p1_found, p1_products, p1_variants, p2_found, p3_found, p4_found, p4_lots, p6_found, p6_versions)}

_VERSIONS = """
WITH reading AS (
  SELECT id, taken_ns, nullif(first_seen_ns, 0) AS fs, nullif(min_price_cents, 0) AS mp,
         nullif(lower(regexp_replace(status, '^\\s+|\\s+$', '', 'g')), '') AS st
  FROM (SELECT *, row_number() OVER (PARTITION BY id, taken_ns ORDER BY loaded_at DESC, row_id DESC) AS rn
        FROM offer_snapshots WHERE id IS NOT NULL AND taken_ns IS NOT NULL) WHERE rn = 1),
known AS (
  SELECT id, taken_ns,
         last_value(fs IGNORE NULLS) OVER w AS fs, last_value(mp IGNORE NULLS) OVER w AS mp, last_value(st IGNORE NULLS) OVER w AS st
  FROM reading WINDOW w AS (PARTITION BY id ORDER BY taken_ns ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
marked AS (
  SELECT *, row_number() OVER w AS n, lag(fs) OVER w AS pf, lag(mp) OVER w AS pm, lag(st) OVER w AS ps
  FROM known WINDOW w AS (PARTITION BY id ORDER BY taken_ns))
SELECT id, taken_ns AS valid_from_ns, coalesce(lead(taken_ns) OVER (PARTITION BY id ORDER BY taken_ns), 0) AS valid_to_ns{more}
FROM marked
WHERE n = 1 OR fs IS DISTINCT FROM pf OR mp IS DISTINCT FROM pm OR st IS DISTINCT FROM ps
"""
_OBJECTS = """
WITH page AS (SELECT page_id, fetched_at, coalesce(json_extract(body, '$.products'), json_extract(body, '$.data.products')) AS p FROM raw_pages WHERE json_valid(body)),
listed AS (SELECT page_id, fetched_at, CASE json_type(p) WHEN 'ARRAY' THEN json_extract(p, '$[*]') ELSE json_extract(p, '$.edges[*].node') END AS p FROM page),
obj AS (SELECT page_id, fetched_at, unnest(p) AS p, unnest(range(len(p))) AS ix FROM listed),
json_product AS (SELECT 'r:' || page_id || '/' || ix AS pk, try_cast(nullif(regexp_extract(json_extract_string(p, '$.id'), '(\\d+)\\D*$', 1), '') AS bigint) AS product_id, fetched_at, p, json_extract(p, '$.variants') AS v FROM obj),
json_list AS (SELECT pk, product_id, CASE WHEN v IS NULL OR json_type(v) = 'NULL' THEN NULL WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_extract(v, '$.edges') IS NOT NULL THEN list_transform(json_extract(v, '$.edges[*]'), lambda e: coalesce(json_extract(e, '$.node'), e)) ELSE [v] END AS v FROM json_product)
"""
ORACLE_SQL = {
    "p1_products": _OBJECTS
    + """
SELECT pk, product_id, fetched_at, n_variants, title, vendor, handle, product_type FROM (
  SELECT j.pk, j.product_id, fetched_at, len(list_filter(l.v, lambda x: json_type(x) = 'OBJECT'))::int AS n_variants, json_extract_string(p, '$.title') AS title, json_extract_string(p, '$.vendor') AS vendor,
         json_extract_string(p, '$.handle') AS handle, json_extract_string(p, '$.product_type') AS product_type FROM json_product j JOIN json_list l USING (pk)
  UNION ALL SELECT 'p:' || row_id, id, fetched_at, len(list_filter(variants, lambda x: x IS NOT NULL))::int, title, vendor, handle, product_type FROM products)
""",
    "p1_variants": _OBJECTS
    + """,
json_variant AS (SELECT pk, product_id, unnest(v) AS v, unnest(range(len(v))) AS ix FROM json_list),
typed_variant AS (SELECT 'p:' || row_id AS pk, id AS product_id, unnest(variants) AS v, unnest(range(len(variants))) AS ix FROM products)
SELECT pk || '/' || ix AS pk, pk AS product_pk, try_cast(nullif(regexp_extract(json_extract_string(v, '$.id'), '(\\d+)\\D*$', 1), '') AS bigint) AS variant_id, product_id, ix::int AS ordinal,
  json_extract_string(v, '$.title') AS title, coalesce(json_extract_string(v, '$.price.amount'), CASE WHEN json_type(json_extract(v, '$.price')) <> 'OBJECT' THEN json_extract_string(v, '$.price') END) AS price,
  json_extract_string(v, '$.sku') AS sku, CASE WHEN lower(json_extract_string(v, '$.available')) IN ('true', 't', 'yes', 'y', '1') THEN true WHEN lower(json_extract_string(v, '$.available')) IN ('false', 'f', 'no', 'n', '0') THEN false END AS available,
  json_extract_string(v, '$.option1') AS option1 FROM json_variant WHERE json_type(v) = 'OBJECT'
UNION ALL SELECT pk || '/' || ix, pk, v.id, product_id, ix::int, v.title, v.price, v.sku, v.available, v.option1 FROM typed_variant WHERE v IS NOT NULL
""",
    "p4_lots": """
WITH area AS (SELECT row_id, hdpData.homeInfo.lotAreaValue AS v, trim(coalesce(hdpData.homeInfo.lotAreaUnit, '')) AS u, coalesce(lotArea.formatted, '') AS f FROM search_lots),
read AS (SELECT row_id, CASE WHEN v IS NULL THEN try_cast(replace(regexp_extract(u, '^([0-9][0-9.,]*) ', 1), ',', '') AS double) ELSE v END AS n,
  lower(trim(CASE WHEN v IS NULL THEN regexp_extract(u, '^[0-9][0-9.,]* (.*)$', 1) WHEN u <> '' THEN u ELSE regexp_replace(regexp_extract(f, '[0-9][0-9.,]* (.*)$', 1), ' lot$', '') END)) AS unit FROM area),
scale(unit, acre) AS (
  SELECT unnest(['acres', 'acre', 'ac', 'acre(s)']), 1.0::double UNION ALL SELECT unnest(['sqft', 'ft²', 'sq ft', 'square foot', 'ft2', 'sq. ft.', 'square feet']), 1.0::double / 43560 UNION ALL SELECT unnest(['k sqft', 'thousand sqft', '1000 sqft']), 1000.0::double / 43560
  UNION ALL SELECT unnest(['square metres', 'sqm', 'sq m', 'm²', 'm2', 'square meters']), 1.0::double / 4046.8564224 UNION ALL SELECT unnest(['ha', 'hectare', 'hectares']), 10000.0::double / 4046.8564224
  UNION ALL SELECT unnest(['yd²', 'sq yd', 'square yards', 'sqyd']), 1.0::double / 4840 UNION ALL SELECT unnest(['square miles', 'mi²', 'sq mi']), 640.0::double UNION ALL SELECT unnest(['km2', 'sq km', 'km²']), 1000000.0::double / 4046.8564224)
SELECT row_id, floor(n * acre * 100 + 0.5)::bigint AS amount FROM read JOIN scale USING (unit) WHERE n > 0
""",
    "p1_found": """
WITH page AS (SELECT fetched_at, coalesce(json_extract(body, '$.products'), json_extract(body, '$.data.products')) AS p FROM raw_pages WHERE json_valid(body)),
prod AS (SELECT fetched_at, unnest(CASE json_type(p) WHEN 'ARRAY' THEN json_extract(p, '$[*]') ELSE json_extract(p, '$.edges[*].node') END) AS p FROM page),
nested AS (SELECT regexp_extract(json_extract_string(p, '$.id'), '(\\d+)\\D*$', 1)::bigint AS pid, fetched_at, json_extract(p, '$.variants') AS v FROM prod),
listed AS (SELECT pid, fetched_at, CASE WHEN json_type(v) = 'ARRAY' THEN json_extract(v, '$[*]') WHEN json_extract(v, '$.edges') IS NOT NULL THEN json_extract(v, '$.edges[*].node') ELSE [v] END AS v
  FROM nested WHERE v IS NOT NULL AND json_type(v) <> 'NULL'),
stated AS (
  SELECT pid, fetched_at, list_transform(v, lambda x: try_cast(nullif(regexp_extract(json_extract_string(x, '$.id'), '(\\d+)\\D*$', 1), '') AS bigint)) AS ids FROM listed
  UNION ALL SELECT id, fetched_at, list_transform(variants, lambda x: x.id) FROM products WHERE id IS NOT NULL AND variants IS NOT NULL),
newest AS (SELECT pid, max(fetched_at) AS fetched_at FROM stated GROUP BY pid),
found AS (SELECT s.pid AS product_id, unnest(s.ids) AS variant_id FROM stated s JOIN newest n ON s.pid = n.pid AND s.fetched_at = n.fetched_at)
SELECT DISTINCT product_id, variant_id FROM found WHERE variant_id IS NOT NULL
""",
    "p3_found": """
WITH lot AS (
  SELECT zpid, max(latLong.latitude) AS lat, max(latLong.longitude) AS lon FROM search_lots
  WHERE zpid IS NOT NULL AND latLong.latitude <> 0 AND latLong.longitude <> 0 AND abs(latLong.latitude) <= 90 AND abs(latLong.longitude) <= 180 GROUP BY zpid),
near AS (
  SELECT a.zpid AS key_a, b.zpid AS key_b FROM lot a JOIN lot b ON a.zpid < b.zpid AND abs(a.lat - b.lat) < 0.003
  WHERE 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(a.lat - b.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(a.lon - b.lon) / 2) ** 2))) <= 250),
corner AS (SELECT zone_id, ring, unnest(range(1, len(ring) + 1)) AS i FROM flood_zones),
edge AS (SELECT zone_id, ring[i].longitude AS x1, ring[i].latitude AS y1, ring[i % len(ring) + 1].longitude AS x2, ring[i % len(ring) + 1].latitude AS y2 FROM corner),
inside AS (
  SELECT zpid AS key_a, zone_id AS key_b FROM lot JOIN edge ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
  GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT 'lot' AS kind, key_a, key_b FROM near UNION ALL SELECT 'zone', key_a, key_b FROM inside
""",
    "p6_found": _VERSIONS.format(more=""),
    "p6_versions": _VERSIONS.format(more=", fs AS first_seen_ns, mp AS min_price_cents, st AS status"),
}
