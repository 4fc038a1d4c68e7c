import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skeinworks.functions import units
from skeinworks.operators import quantities as q

ACRE = units.ACRE


@pytest.mark.parametrize(
    ("text", "acres"),
    [("acres", 1), (" AC ", 1), ("acre(s)", 1), ("sq. mi.", 640), ("mi²", 640), ("square miles", 640), ("sqft", Fraction(1, 43560)), ("1000 sqft", Fraction(1000, 43560)), ("k sqft", Fraction(1000, 43560)), ("ft^2", Fraction(1, 43560)), ("square yards", Fraction(1, 4840))],
)
def test_areas(text, acres):
    unit = units.parse_unit(text)
    assert unit.dims == units.AREA and unit.factor / ACRE == acres


def test_metric_areas_and_other_units():
    assert round(float(ACRE / units.parse_unit("m²").factor), 6) == 4046.856422
    assert units.parse_unit("ha").factor == units.parse_unit("10000 m2").factor
    assert units.parse_unit("lot") is None and units.parse_unit("n/a") is None and units.parse_unit("") is None
    assert units.parse_unit("Gb/s").dims != units.INFORMATION and units.parse_unit("Gb").factor * 8 == units.parse_unit("GB").factor
    assert units.parse_unit("km/h").factor == Fraction(1000, 3600)
    celsius = units.quantities("20 °C")[0]
    assert celsius.value == Fraction(29315, 100)


@pytest.mark.parametrize(("text", "value"), [("1,234.5", Fraction(2469, 2)), ("18,000", 18000), ("3,0", 3), ("20.000", 20), ("1.234.567,5", Fraction(2469135, 2)), ("0,960", Fraction(96, 100)), ("½", Fraction(1, 2)), ("2½", Fraction(5, 2))])
def test_numbers(text, value):
    assert units.number(text) == value


@pytest.mark.parametrize(
    ("text", "gb"),
    [
        ("Hard Drives > 18TB > 3.5", 18000), ("HDDs - 9.09TiB - SAS", 9995), ("Storage | 1000000MB", 1000), ("x; 3,0 TB", 3000), ("Drives, 18,000 GB, SAS 12Gb/s", 18000), ("a :: 14 Terabyte", 14000), ("12 To", 12000),
        ("Cache 256 MB > 8TB", 8000), ("8TB and greater > 12 TB", 12000), ("under 8TB", None), ("512MB Cache", None), ("SATA 6Gb/s", None), ("up to 4TB", None), ("2+ TB", None), ("", None), (None, None), ('"Drives" / 8-TB', 8000),
    ],
)
def test_capacities(text, gb):
    got = q.stated_capacity(text)
    assert (None if got is None else units.rounded(got / 10**9)) == gb


def acres(df):
    return q.amounts(df, "k", F.col("v"), F.col("u"), F.col("t"), units.AREA, ACRE / 100)


def test_columns(spark, rows):
    data = [(1, 2.0, "acres", None), (2, 43560.0, "", "Lot: 43,560 sqft"), (3, None, "1.5 acres", None), (4, None, "acres", "2 acres"), (5, -1.0, "acres", None), (6, 1.0, "lot", "2 acres"), (7, None, None, None), (8, float("inf"), "acres", None), (9, 0.125, "ac", None), (10, 2.5, None, "2.5 thousand sqft"), (10, 2.5, None, "7 thousand sqft"), (11, 1e300, "acres", None), (12, 5445.0, "sqft", None), (13, float("nan"), "acres", None), (14, 3.0, "\u00a0", "x" * 5000)]
    df = spark.createDataFrame(data, "k int, v double, u string, t string")
    assert sorted(rows(acres(df))) == [(1, 200), (2, 100), (3, 150), (9, 13), (10, 6), (10, 6), (12, 13)]
    assert q.gigabytes(df.limit(0), "k", F.col("t")).count() == 0 and acres(df.limit(0)).count() == 0


def test_scaling_is_that_of_fractions(spark, rows):
    rnd = random.Random(3)
    names = ["acres", "sqft", "m²", "ha", "sq yd", "sq mi", "1000 sqft"]
    data = [(k, rnd.choice([round(rnd.uniform(0, 10**rnd.randrange(-2, 7)), rnd.randrange(0, 6)), rnd.randrange(1, 10**6) / 8]), rnd.choice(names), None) for k in range(3000)]
    got = dict(rows(acres(spark.createDataFrame(data, "k int, v double, u string, t string"))))
    want = {k: units.rounded(Fraction(repr(v)) * units.parse_unit(u).factor / (ACRE / 100)) for k, v, u, _ in data if v > 0}
    assert got == want


def test_python_sees_distinct_texts_only(spark):
    df = spark.range(1000).selectExpr("id as k", "cast(id as double) as v", "'acres' as u", "cast(null as string) as t")
    plan = acres(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "MapInArrow" in plan and plan.index("MapInArrow") < plan.rindex("HashAggregate")
