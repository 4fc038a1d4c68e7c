"""Catalogues of storefronts: products with variants, one raw row per variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.extract import feed_capacity_tb, feed_condition, tag_value, tagged_condition, variant_capacity_tb, without_suffix
from skeinworks.functions.numbers import cents_rounded, number
from skeinworks.functions.text import stripped_html, trim_all
from skeinworks.sources.raw import aspects

PRODUCTS = """products array<struct<id bigint, title string, handle string, body_html string, vendor string, product_type string, tags string,
  variants array<struct<id bigint, title string, price string, sku string, available boolean, option1 string>>>>"""


def products(spark: SparkSession, path: str) -> DataFrame:
    """The products in the JSON files of ``path``. Bytes that are no UTF-8 become one question mark a run."""
    text = spark.read.format("binaryFile").load(path).select(F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "�+", "?").alias("body"))
    return text.select(F.inline(F.from_json("body", PRODUCTS)["products"]))


def tag_list(tags: Column) -> Column:
    """Tags as an array, from a JSON array in text or from a text split at commas; blanks trimmed, empty ones left out."""
    plain = trim_all(F.coalesce(tags, F.lit("")))
    listed = F.when(plain.startswith("["), F.from_json(plain, "array<string>", {"allowSingleQuotes": "false"}))
    each = F.transform(F.coalesce(listed, F.split(plain, ",")), trim_all)
    return F.filter(each, lambda t: t != "")


def allowed(product_type: Column, prefixes: list[str]) -> Column:
    """Whether the product type begins with one of ``prefixes``, in any case; without prefixes every one does."""
    if not prefixes:
        return F.lit(True)
    kind = F.lower(trim_all(F.coalesce(product_type, F.lit(""))))
    out = F.lit(False)
    for p in prefixes:
        out = out | kind.startswith(p.strip().lower())
    return out


def mapped(found: DataFrame, source_id: Column, host: str, seen_at: Column, prefixes: list[str] = (), unavailable: bool = False, brand_tag: str = "", sku_suffixes: list[str] | None = None) -> DataFrame:
    """Raw rows, one per variant, with hints of brand and part number.

    Products are filtered before variants are exploded. Variants without an id
    and, unless asked for, unavailable ones are left out. A brand comes from
    its tag only; a part number from the stock number only where
    ``sku_suffixes`` is given, without the first suffix it ends in.
    """
    listed = found.where(allowed(F.col("product_type"), list(prefixes))).withColumn("_tags", tag_list(F.col("tags").cast("string"))).withColumn("_source", source_id).withColumn("_seen", seen_at)
    rows = listed.select("*", F.explode("variants").alias("v")).where((F.coalesce("id", F.lit(0)) != 0) & (F.coalesce("v.id", F.lit(0)) != 0))
    if not unavailable:
        rows = rows.where(F.coalesce("v.available", F.lit(False)))
    own_title = trim_all(F.col("v.title"))
    brand = tag_value(F.col("_tags"), brand_tag) if brand_tag else F.lit(None).cast("string")
    mpn = without_suffix(F.col("v.sku"), sku_suffixes) if sku_suffixes is not None else F.lit(None).cast("string")
    return rows.select(
        F.col("_source").alias("source_id"),
        F.concat(F.col("id").cast("string"), F.lit(":"), F.col("v.id").cast("string")).alias("source_key"),
        F.concat(F.lit(host + "/products/"), F.coalesce("handle", F.lit(""))).alias("source_url"),
        F.coalesce("title", F.lit("")).alias("title"),
        stripped_html(F.coalesce("body_html", F.lit(""))).alias("body"),
        cents_rounded(number(trim_all(F.col("v.price")))).alias("price_cents"),
        F.lit("USD").alias("currency"),
        tagged_condition(F.col("_tags")).alias("condition_raw"),
        aspects(
            capacity_tb=variant_capacity_tb(F.col("v.title"), F.col("v.option1"), F.col("_tags"), F.col("product_type")),
            vendor=F.col("vendor"),
            product_type=F.col("product_type"),
            sku=F.col("v.sku"),
            variant=F.when(F.lower(own_title) != "default title", own_title),
            brand=brand,
            mpn=mpn,
        ).alias("aspects"),
        F.col("_seen").alias("seen_at"),
        F.coalesce(brand, F.lit("")).alias("hint_brand"),
        F.coalesce(mpn, F.lit("")).alias("hint_mpn"),
    )


def feed(found: DataFrame) -> DataFrame:
    """(capacity_tb, condition, price_cents): the available, priced variants of a feed whose capacity is stated."""
    tags = tag_list(F.col("tags").cast("string"))
    rows = found.select("title", tags.alias("tags"), F.explode("variants").alias("v")).where(F.coalesce("v.available", F.lit(False)))
    words = F.concat_ws(" ", "title", F.array_join("tags", " "))
    out = rows.select(feed_capacity_tb(F.col("v.title"), F.col("title")).alias("capacity_tb"), feed_condition(words).alias("condition"), cents_rounded(number(trim_all(F.col("v.price")))).alias("price_cents"))
    return out.where("capacity_tb > 0 and price_cents > 0")
