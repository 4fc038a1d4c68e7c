import math
import random

from pyspark.sql import functions as F

from skeinworks.operators import proximity


def clean(spark, data):
    df = spark.createDataFrame(data, "k string, lat double, lon double")
    return proximity.clean_points(df, "k", F.col("lat"), F.col("lon"))


def distance(a, b):
    la, lo, lb, lp = map(math.radians, (a[1], a[2], b[1], b[2]))
    h = math.sin((la - lb) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lo - lp) / 2) ** 2
    return 2 * proximity.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def brute(data, metres):
    return sorted((min(a[0], b[0]), max(a[0], b[0])) for i, a in enumerate(data) for b in data[:i] if distance(a, b) <= metres)


def test_clusters_against_brute_force(spark, rows):
    rnd = random.Random(4)
    data = []
    for c in range(12):
        lat, lon = rnd.uniform(-80, 80), rnd.uniform(-179, 179)
        data += [(f"p{c}-{i}", lat + rnd.gauss(0, 0.002), lon + rnd.gauss(0, 0.002)) for i in range(25)]
    assert sorted(rows(proximity.points_near(clean(spark, data), 250))) == brute(data, 250)


def test_date_line_poles_and_copies(spark, rows):
    data = [("a", 10.0, 179.9995), ("b", 10.0, -179.9995), ("c", 89.9999, 0.0), ("d", 89.9999, 180.0), ("e", -90.0, 5.0), ("f", -90.0, -100.0), ("g", 0.0, 180.0), ("h", 0.0, -180.0)]
    data += [(f"s{i}", 40.0, -100.0) for i in range(40)]
    assert sorted(rows(proximity.points_near(clean(spark, data), 250))) == brute(data, 250)


def test_a_hot_place_is_held_in_pieces(spark, rows, monkeypatch):
    monkeypatch.setattr(proximity, "PIECE", 16)
    rnd = random.Random(6)
    data = [(f"s{i:03}", 40.0, -100.0) for i in range(90)] + [(f"t{i}", 40.0 + rnd.gauss(0, 0.002), -100.0 + rnd.gauss(0, 0.002)) for i in range(90)]
    ended, placed, _ = proximity.joined_leaves(proximity.written(clean(spark, data), "points"), 250)
    sizes = {(r["node"], r["piece"]): r["count"] for r in placed.groupBy("node", "piece").count().collect()}
    assert sum(sizes.values()) == 180 and max(sizes.values()) < 45 and ended.count() < 5000
    assert sorted(rows(proximity.near_pairs(ended, placed, 250))) == brute(data, 250)


def test_points_inside_a_wide_region_are_accepted_by_boxes(spark, rows):
    rnd = random.Random(8)
    data = [(f"p{i:04}", 2 + rnd.gauss(0, 0.2), 2 + rnd.gauss(0, 0.2)) for i in range(400)]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    regions = proximity.clean_regions(spark.createDataFrame([("z", ring)], "z string, ring array<struct<longitude double, latitude double>>"), "z", "ring")
    box = regions.first()
    assert 0 < box["in_lat_lo"] < 1e-6 and 4 - 1e-6 < box["in_lon_hi"] < 4
    ended, placed, outlines = proximity.joined_leaves(proximity.written(clean(spark, data), "points"), None, regions)
    assert ended.where("not near").count() == 0 and len(rows(proximity.regions_of(ended, placed, outlines))) == 400


def test_wide_radius(spark, rows):
    rnd = random.Random(9)
    data = [(f"p{i}", rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(80)]
    assert sorted(rows(proximity.points_near(clean(spark, data), 3_000_000))) == brute(data, 3_000_000)


def test_unusable_points(spark, rows):
    data = [("a", None, 1.0), (None, 1.0, 1.0), ("b", float("nan"), 1.0), ("c", 91.0, 1.0), ("d", 1.0, 181.0), ("e", 1.0, 1.0), ("e", 1.0, 1.0)]
    assert rows(clean(spark, data).select("key")) == [("e",)]
    assert rows(proximity.points_near(clean(spark, data), 250)) == []
    assert rows(proximity.points_near(clean(spark, []), 250)) == []


def test_regions_against_brute_force(spark, rows):
    rnd = random.Random(2)
    points = [(f"p{i}", rnd.uniform(0, 4), rnd.uniform(0, 4)) for i in range(300)]
    zones = []
    for z in range(8):
        cy, cx, n = rnd.uniform(0.5, 3.5), rnd.uniform(0.5, 3.5), rnd.randrange(3, 12)
        ring = [(cx + rnd.uniform(0.2, 0.8) * math.cos(2 * math.pi * k / n), cy + rnd.uniform(0.2, 0.8) * math.sin(2 * math.pi * k / n)) for k in range(n)]
        zones.append((f"z{z}", (ring[::-1] if z % 2 else ring) + ([ring[-1]] if z % 2 else [ring[0]])))
    zones += [("two", [(0.0, 0.0), (4.0, 4.0)]), ("none", None), (None, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0)])]
    df = spark.createDataFrame(zones, "z string, ring array<struct<longitude double, latitude double>>")
    got = sorted(rows(proximity.points_in(clean(spark, points), proximity.clean_regions(df, "z", "ring"))))

    def inside(x, y, ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    want = sorted((k, z) for k, lat, lon in points for z, ring in zones if z and ring and len(ring) > 2 and inside(lon, lat, ring))
    assert got == want and want
    assert rows(proximity.points_in(clean(spark, []), proximity.clean_regions(df, "z", "ring"))) == []
    assert rows(proximity.points_in(clean(spark, points), proximity.clean_regions(df.limit(0), "z", "ring"))) == []
