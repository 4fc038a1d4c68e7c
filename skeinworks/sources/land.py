"""Search responses for land: one JSON document with a list of lots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinworks.functions.extract import absolute_url, acres
from skeinworks.functions.numbers import cents_rounded, rendered
from skeinworks.functions.text import trim_all
from skeinworks.sources.raw import aspects

RESPONSE = """data array<struct<
  zpid string, address string, addressCity string, addressState string, addressZipcode string,
  unformattedPrice double, detailUrl string, latLong struct<latitude double, longitude double>,
  lotArea struct<value double, unit string>, taxAssessedValue double, daysOnZillow int,
  hdpData struct<homeInfo struct<lotAreaValue double, lotAreaUnit string>>>>,
  meta struct<count int>, request_id string"""


def lots(spark: SparkSession, path: str) -> DataFrame:
    """The lots in the JSON files of ``path`` under the explicit schema."""
    return spark.read.schema(RESPONSE).option("multiLine", True).json(path).select(F.inline("data"))


def lot_acres() -> Column:
    """Acres of a lot: its own area first, then that of the home record."""
    home = F.col("hdpData.homeInfo")
    return F.coalesce(acres(F.col("lotArea.value"), F.col("lotArea.unit")), acres(home["lotAreaValue"], home["lotAreaUnit"]))


def mapped(found: DataFrame, source_id: str, host: str, seen_at: Column) -> DataFrame:
    """Raw rows of lots; lots without a key are left out, unknown facts are absent from the aspects."""
    lat, lon = F.coalesce("latLong.latitude", F.lit(0.0)), F.coalesce("latLong.longitude", F.lit(0.0))
    placed = (lat != 0) | (lon != 0)
    city, state = trim_all("addressCity"), trim_all("addressState")
    place = F.when(city != "", F.when(state != "", F.concat(city, F.lit(", "), state)).otherwise(city))
    rows = found.where(trim_all("zpid") != "")
    return rows.select(
        F.lit(source_id).alias("source_id"),
        trim_all("zpid").alias("source_key"),
        absolute_url(F.col("detailUrl"), host).alias("source_url"),
        F.coalesce(trim_all("address"), F.lit("")).alias("title"),
        F.lit("").alias("body"),
        cents_rounded(F.col("unformattedPrice")).alias("price_cents"),
        F.lit("USD").alias("currency"),
        F.lit("").alias("condition_raw"),
        aspects(
            acreage=rendered(lot_acres()),
            street_address=trim_all("address"),
            location=place,
            zip=trim_all("addressZipcode"),
            assessed_value_cents=F.nullif(cents_rounded(F.col("taxAssessedValue")), F.lit(0)),
            days_on_market=F.when(F.col("daysOnZillow") >= 0, F.col("daysOnZillow")),
            lat=F.when(placed, rendered(lat)),
            lon=F.when(placed, rendered(lon)),
        ).alias("aspects"),
        seen_at.alias("seen_at"),
    )
