"""Search responses of a marketplace: one JSON document with a list of item summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.numbers import cents_truncated
from skeinworks.operators.enrich import looked_up
from skeinworks.sources.raw import aspects

RESPONSE = """total int, itemSummaries array<struct<
  itemId string, title string, itemWebUrl string, condition string, conditionId string,
  price struct<value string, currency string>,
  seller struct<username string, feedbackPercentage string, feedbackScore int>,
  itemLocation struct<country string>>>"""


def responses(spark: SparkSession, path: str) -> DataFrame:
    """The responses in the JSON files of ``path`` under the explicit schema; other members are ignored."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path)


def mapped(found: DataFrame, source_id: str, seen_at, profiles: DataFrame | None = None) -> DataFrame:
    """Raw rows of responses: items without an id are left out, an unreadable price is 0, the seller's name is never kept.

    ``profiles``: username, account_age_days, recent_sales; looked up once per
    seller and only passed on as figures.
    """
    items = found.select(F.explode("itemSummaries").alias("i")).select("i.*").where(F.trim("itemId") != "")
    items = items.withColumn("username", F.col("seller.username"))
    facts = profiles if profiles is not None else items.sparkSession.createDataFrame([], "username string, account_age_days bigint, recent_sales bigint")
    items = looked_up(items, facts, ["username"], drop=["username"])
    return items.select(
        F.lit(source_id).alias("source_id"),
        F.col("itemId").alias("source_key"),
        F.coalesce("itemWebUrl", F.lit("")).alias("source_url"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.lit("").alias("body"),
        F.coalesce(cents_truncated(F.col("price.value")), F.lit(0)).cast("bigint").alias("price_cents"),
        F.coalesce("price.currency", F.lit("")).alias("currency"),
        F.coalesce(F.nullif("conditionId", F.lit("")), "condition", F.lit("")).alias("condition_raw"),
        aspects(
            condition=F.col("condition"),
            conditionId=F.col("conditionId"),
            seller_feedback_pct=F.col("seller.feedbackPercentage"),
            seller_feedback_score=F.col("seller.feedbackScore"),
            item_location_country=F.col("itemLocation.country"),
            seller_account_age_days=F.col("account_age_days"),
            seller_recent_sales=F.col("recent_sales"),
        ).alias("aspects"),
        F.lit(seen_at).cast("timestamp").alias("seen_at"),
    )
