"""Facts about places as services give them, folded to one map of attributes per place.

Each mapper takes the JSON text of one service's answer. A service that failed
or knows nothing adds nothing: absent is not false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.functions.extract import placed
from skeinworks.functions.numbers import number, rendered
from skeinworks.functions.text import first_filled, trim_all
from skeinworks.operators.enrich import looked_up

#: Fixed value: at and below this, an elevation means that there is none.
NO_ELEVATION = -999_999.0


def _text(answer: Column, path: str) -> Column:
    return F.nullif(trim_all(F.get_json_object(answer, path)), F.lit(""))


def flood(answer: Column) -> dict[str, Column]:
    """The zone of the first feature."""
    return {"flood_zone": _text(answer, "$.features[0].attributes.FLD_ZONE"), "flood_zone_subtype": _text(answer, "$.features[0].attributes.ZONE_SUBTY")}


def elevation(answer: Column) -> dict[str, Column]:
    """Metres above the sea; none where the service has no data there."""
    metres = _text(answer, "$.value").try_cast("double")
    return {"elevation_m": F.when(metres > NO_ELEVATION, rendered(metres))}


def soil(answer: Column) -> dict[str, Column]:
    """Series, map unit and share of the first row of a table whose first row names the columns."""
    return {"soil_series": _text(answer, "$.Table[1][0]"), "soil_map_unit": _text(answer, "$.Table[1][1]"), "soil_component_pct": _text(answer, "$.Table[1][2]")}


def wetlands(answer: Column) -> dict[str, Column]:
    """Kind and code of the first feature."""
    return {"wetland_type": _text(answer, "$.features[0].attributes.WETLAND_TYPE"), "wetland_code": _text(answer, "$.features[0].attributes.ATTRIBUTE")}


SERVICES = {"flood": flood, "elevation": elevation, "soil": soil, "wetlands": wetlands}


def attributes(**answers: Column) -> Column:
    """The facts of all answers in one map."""
    pairs = [x for service, answer in answers.items() for name, value in SERVICES[service](answer).items() for x in (F.lit(name), value)]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def with_facts(items: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with the facts of their place (a column ``facts``) added to their attributes; the item's own ones stay."""
    joined = looked_up(items.drop("facts"), facts.select(*keys, "facts"), keys)
    own = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    more = F.map_filter(F.coalesce("facts", F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(own, k))
    return joined.withColumn("attributes", F.map_concat(own, more)).drop("facts")


def geocoded(answer: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of the first match of an address; null where there is none."""
    at = "$.result.addressMatches[0].coordinates"
    return _text(answer, f"{at}.y").try_cast("double"), _text(answer, f"{at}.x").try_cast("double")


def with_points(items: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """``items`` with ``lat``, ``lon`` and ``address``: their own usable coordinates, else those of their locality.

    ``answers``: location and answer (what a geocoder says of it), one row a
    locality. ``address`` is the street address or, failing that, the
    locality. An item with neither keeps nulls.
    """
    a = F.col("attributes")
    own = placed(a["lat"], a["lon"])
    rows = items.drop("lat", "lon", "address", "_answer").withColumn("_location", F.when(trim_all(a["location"]) != "", trim_all(a["location"])))
    if answers is not None:
        rows = looked_up(rows, answers.select(trim_all("location").alias("_location"), F.col("answer").alias("_answer")), ["_location"])
    else:
        rows = rows.withColumn("_answer", F.lit(None).cast("string"))
    lat, lon = geocoded(F.col("_answer"))
    point = lambda mine, theirs: F.when(own, number(trim_all(mine))).otherwise(theirs)
    return rows.withColumn("lat", point(a["lat"], lat)).withColumn("lon", point(a["lon"], lon)).withColumn("address", first_filled(a["street_address"], F.col("_location"))).drop("_location", "_answer")


def parcel_facts(parcels: DataFrame, key: str = "address") -> DataFrame:
    """(key, facts): what a parcel record adds to attributes; a member that is null adds nothing.

    ``parcels``: improvement_cents, land_cents, year_built, acres.
    """
    dollars = lambda c: F.format_string("%.2f", F.col(c) / 100.0)
    known = lambda c, value: F.when(F.col(c).isNotNull(), value)
    structure = F.when(F.col("improvement_cents").isNotNull() & F.col("year_built").isNotNull(), (F.col("improvement_cents") > 0) & (F.col("year_built") > 0)).cast("string")
    pairs = {
        "assessed_improvement_usd": known("improvement_cents", dollars("improvement_cents")), "assessed_land_usd": known("land_cents", dollars("land_cents")),
        "year_built": F.col("year_built").cast("string"), "acreage": known("acres", F.format_string("%.4f", F.col("acres"))), "structure_present": structure,
    }
    facts = F.map_filter(F.create_map(*[x for name, value in pairs.items() for x in (F.lit(name), value)]), lambda _, v: v.isNotNull())
    return parcels.select(key, facts.alias("facts"))
