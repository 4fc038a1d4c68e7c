"""Points near other points, and points in regions, by a dual-tree join.

Points form an adaptive tree over longitude and latitude: a node is split
while it holds more than ``LEAF`` points. Each node keeps the tight box around
its points. Regions form a second tree of the same kind over the middles of
their boxes, in which each leaf has its regions as children; such a child also
keeps a box that lies wholly inside the outline.

The join starts with the pairs of the roots and goes down in rounds, each an
equi-join of the open pairs with their children: a pair whose boxes are
certainly too far apart is dropped, a pair whose boxes are certainly near (or
inside) is accepted wholesale, and the rest is refined. Both joins, with
points and with regions, go down in the same rounds and share one tree of the
points. What is left at the leaves is compared point by point; only there do
edges of outlines come in, and of them only those beside the leaf's box.

The result of the descent is pairs of leaves and the membership of the points
in leaves: copies of a place are not expanded to pairs before the end. Points
of a leaf are held in pieces of at most about ``PIECE``, so that a cell that
holds most of the points is spread over many tasks.

The open pairs of each round are written to the shared folder, so a round's
plan stays short, and a lost executor costs one round.

Defined results: points with a null key or a null or non-finite coordinate are
left out; repeated keys count once (greatest coordinates win, should they
differ); a region of fewer than three points contains nothing; empty tables
give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinworks.session import written

EARTH_RADIUS_M = 6_371_008.8
DEPTH = 20  # bits of each axis in the finest cell
LEVELS = (0, 4, 7, 10, 13, 16, DEPTH)
LEAF = 16  # points or regions; a node of more is split, down to the finest cell
PIECE = 1024
_BOX = ("lat_lo", "lat_hi", "lon_lo", "lon_hi")
_REGIONS = 1 << 62  # marks the keys of nodes of regions


def _axis(value: Column, low: float, span: float) -> Column:
    cells = 1 << DEPTH
    return F.least(F.greatest(F.floor((value - F.lit(low)) / F.lit(span) * F.lit(float(cells))), F.lit(0)), F.lit(cells - 1)).cast("long")


def _node(x: Column, y: Column, level: int) -> Column:
    """The key of the node of ``level`` that holds the cell (x, y)."""
    up = DEPTH - level
    return F.lit(level << 44).cast("long") + F.shiftleft(F.shiftright(y, up), 22) + F.shiftright(x, up)


def clean_points(points: DataFrame, key: str, lat: Column, lon: Column) -> DataFrame:
    """(key, lat, lon, cell): one row per key with usable coordinates."""
    usable = F.col("key").isNotNull() & F.abs("lat").between(0, 90) & F.abs("lon").between(0, 180)
    rows = points.select(F.col(key).cast("string").alias("key"), lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).where(usable)
    once = rows.groupBy("key").agg(F.max(F.struct("lat", "lon")).alias("at")).select("key", "at.lat", "at.lon")
    return once.withColumn("cell", _node(_axis(F.col("lon"), -180, 360), _axis(F.col("lat"), -90, 180), DEPTH))


def _boxed() -> list[Column]:
    return [F.sum("n").alias("n"), F.min("lat_lo").alias("lat_lo"), F.max("lat_hi").alias("lat_hi"), F.min("lon_lo").alias("lon_lo"), F.max("lon_hi").alias("lon_hi")]


def tree(items: DataFrame, mark: int = 0) -> tuple[DataFrame, DataFrame]:
    """(nodes, leaves) of items with a cell and a box.

    nodes: (parent, node, n, box, leaf), written. leaves: (cell, node, n), the
    leaf of each finest cell. ``mark`` is added to the keys of the nodes.
    """
    cells = items.withColumn("n", F.lit(1).cast("long")).groupBy("cell").agg(*_boxed())
    x, y = F.col("cell").bitwiseAND((1 << 22) - 1), F.shiftright("cell", 22).bitwiseAND((1 << 22) - 1)
    key = lambda level: _node(x, y, level) + F.lit(mark).cast("long")
    steps = [F.struct(F.lit(i).alias("depth"), key(level).alias("node"), (key(LEVELS[i - 1]) if i else F.lit(-1).cast("long")).alias("parent")) for i, level in enumerate(LEVELS)]
    paths = written(cells.select("*", F.inline(F.array(*steps))), "paths")
    nodes = paths.groupBy("depth", "node", "parent").agg(*_boxed())
    above = nodes.select(F.col("node").alias("parent"), F.col("n").alias("n_parent"))
    kept = nodes.join(above, "parent", "left").where(f"n_parent is null or n_parent > {LEAF}").drop("n_parent")
    children = written(kept.withColumn("leaf", (F.col("n") <= LEAF) | (F.col("depth") == len(LEVELS) - 1)).drop("depth"), "nodes")
    leaves = paths.select("cell", "node").join(children.where("leaf").select("node", "n"), "node")
    return children, leaves


def _with_own(nodes: DataFrame) -> DataFrame:
    """A leaf is also its own child, so that it stays while its partner in a pair is refined."""
    return nodes.unionByName(nodes.where("leaf").withColumn("parent", F.col("node")))


def _sides(a: DataFrame, side: str) -> DataFrame:
    return a.select(*[F.col(c).alias(f"{side}_{c}") for c in a.columns])


def _gap(a: str, b: str, axis: str) -> Column:
    return F.greatest(F.col(f"{b}_{axis}_lo") - F.col(f"{a}_{axis}_hi"), F.col(f"{a}_{axis}_lo") - F.col(f"{b}_{axis}_hi"), F.lit(0.0))


def _span(a: str, b: str, axis: str) -> Column:
    return F.greatest(F.col(f"{a}_{axis}_hi"), F.col(f"{b}_{axis}_hi")) - F.least(F.col(f"{a}_{axis}_lo"), F.col(f"{b}_{axis}_lo"))


def _square_sin_half(degrees: Column) -> Column:
    s = F.sin(F.radians(degrees) / 2)
    return s * s


def _haversine(dlat: Column, dlon: Column, cos_a: Column, cos_b: Column) -> Column:
    """The square of half the chord over the radius."""
    return _square_sin_half(dlat) + cos_a * cos_b * _square_sin_half(dlon)


def _cos_limit(side: str, least: bool) -> Column:
    """The least or greatest cosine of a latitude in a box."""
    lo, hi = F.col(f"{side}_lat_lo"), F.col(f"{side}_lat_hi")
    far = F.greatest(F.abs(lo), F.abs(hi))
    near = F.when((lo <= 0) & (hi >= 0), F.lit(0.0)).otherwise(F.least(F.abs(lo), F.abs(hi)))
    return F.cos(F.radians(far if least else near))


def _bounds(a: str, b: str) -> tuple[Column, Column]:
    """A lower and an upper bound of the haversine between a point of box a and one of box b, across the date line too."""
    gap, span = _gap(a, b, "lon"), _span(a, b, "lon")
    around = F.greatest(F.lit(360.0) - span, F.lit(0.0))
    low = _haversine(_gap(a, b, "lat"), F.least(gap, around), _cos_limit(a, True), _cos_limit(b, True))
    high = _haversine(_span(a, b, "lat"), F.least(span, F.lit(180.0)), _cos_limit(a, False), _cos_limit(b, False))
    return low, high


def _descend(open_pairs: DataFrame, a: DataFrame, b: DataFrame, judge) -> DataFrame:
    """(a, b, a_n, b_n, near): all terminal pairs, by rounds of joins with the children of both sides until both are leaves.

    ``judge`` maps the joined pairs to pairs with ``near``: true, accepted as a
    whole; false, to be compared; dropped pairs are missing.
    """
    ended: list[DataFrame] = []
    for depth in range(2 * len(LEVELS)):
        pairs = open_pairs.join(_sides(a, "a"), F.col("a") == F.col("a_parent")).join(_sides(b, "b"), F.col("b") == F.col("b_parent"))
        judged = judge(pairs).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_n", "b_n", "near", (F.col("a_leaf") & F.col("b_leaf")).alias("ends"))
        round_ = written(judged, f"round{depth}", ["ends"])
        ended.append(round_.where("ends").select("a", "b", "a_n", "b_n", "near"))
        open_pairs = round_.where("not ends").select("a", "b", "near")
        if open_pairs.isEmpty():
            break
    return reduce(DataFrame.unionByName, ended)


def _pieces(n: Column) -> Column:
    """In how many pieces the points of a leaf are held."""
    return F.ceil(n / PIECE).cast("int")


def joined_leaves(points: DataFrame, metres: float | None, regions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(pairs of leaves, membership, outlines): what the descent finds, before anything is expanded.

    pairs: (a, b, a_n, b_n, near), where a negative b is a region. membership:
    (node, piece, key, lat, lon). outlines: (b, region, edges). ``points`` are
    clean_points(), given as a written table, as they are read twice.
    """
    spark = points.sparkSession
    boxes = points.select("cell", F.col("lat").alias("lat_lo"), F.col("lat").alias("lat_hi"), F.col("lon").alias("lon_lo"), F.col("lon").alias("lon_hi"))
    own, leaves = tree(boxes)
    inner = [F.lit(None).cast("double").alias(f"in_{c}") for c in _BOX]
    points_side = _with_own(own)
    sides, roots, outlines = [], [], None
    if metres is not None:
        sides.append(points_side.select("*", *inner))
        roots.append((0, 0, False))
    if regions is not None:
        groups, region_leaves = tree(regions, _REGIONS)
        named = written(regions.withColumn("_id", F.monotonically_increasing_id()), "regions").withColumn("b", -F.col("_id") - 2)  # -1 is above the roots
        below = named.join(region_leaves.select("cell", F.col("node").alias("parent")), "cell")
        below = below.select("parent", F.col("b").alias("node"), F.lit(1).cast("long").alias("n"), *_BOX, F.lit(True).alias("leaf"), *[f"in_{c}" for c in _BOX])
        sides += [groups.withColumn("leaf", F.lit(False)).select("*", *inner), _with_own(below)]
        roots.append((0, _REGIONS, False))
        outlines = named.select("b", "region", "edges")
    limit = math.sin(min((metres or 0.0) / (2 * EARTH_RADIUS_M), math.pi / 2)) ** 2
    low, high = _bounds("a", "b")

    def judge(pairs: DataFrame) -> DataFrame:
        zone = (F.col("b") < 0) | (F.col("b") >= _REGIONS)
        once = (F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node"))
        meet = (_gap("a", "b", "lat") <= 0) & (_gap("a", "b", "lon") <= 0)
        within = (F.col("a_lat_lo") > F.col("b_in_lat_lo")) & (F.col("a_lat_hi") < F.col("b_in_lat_hi")) & (F.col("a_lon_lo") > F.col("b_in_lon_lo")) & (F.col("a_lon_hi") < F.col("b_in_lon_hi"))
        # A margin keeps rounding of the bounds from deciding; the points themselves are compared exactly.
        close = F.col("near") | (low <= limit * (1 + 1e-9) + 1e-18)
        near = F.col("near") | F.when(zone, F.coalesce(within, F.lit(False))).otherwise(high <= limit * (1 - 1e-9))
        return pairs.where(F.when(zone, meet).otherwise(once & close)).withColumn("near", near)

    ended = _descend(spark.createDataFrame(roots, "a long, b long, near boolean"), points_side, reduce(DataFrame.unionByName, sides), judge)
    piece = F.pmod(F.xxhash64("key"), _pieces(F.col("n"))).cast("int")
    placed = points.join(leaves, "cell").select("node", piece.alias("piece"), "key", "lat", "lon")
    return ended, placed, outlines


def _expanded(pairs: DataFrame, placed: DataFrame, side: str) -> DataFrame:
    """``pairs`` with the points of one of their leaves, piece by piece."""
    each = pairs.withColumn("_piece", F.explode(F.sequence(F.lit(0), _pieces(F.col(f"{side}_n")) - 1)))
    return each.join(_sides(placed, side), (F.col(side) == F.col(f"{side}_node")) & (F.col("_piece") == F.col(f"{side}_piece"))).drop("_piece")


def near_pairs(ended: DataFrame, placed: DataFrame, metres: float) -> DataFrame:
    """(key_a, key_b), key_a < key_b: two points at most ``metres`` apart on the sphere, from joined_leaves()."""
    limit = math.sin(min(metres / (2 * EARTH_RADIUS_M), math.pi / 2)) ** 2
    both = _expanded(_expanded(ended.where((F.col("b") >= 0) & (F.col("b") < _REGIONS)), placed, "a"), placed, "b")
    exact = _haversine(F.col("a_lat") - F.col("b_lat"), F.col("a_lon") - F.col("b_lon"), F.cos(F.radians("a_lat")), F.cos(F.radians("b_lat"))) <= limit
    different = F.when(F.col("a") == F.col("b"), F.col("a_key") < F.col("b_key")).otherwise(F.lit(True))
    return both.where(different & (F.col("near") | exact)).select(F.least("a_key", "b_key").alias("key_a"), F.greatest("a_key", "b_key").alias("key_b"))


def regions_of(ended: DataFrame, placed: DataFrame, outlines: DataFrame) -> DataFrame:
    """(key, region): the regions whose outline contains the point, from joined_leaves(); edges are straight in longitude and latitude."""
    pairs = ended.where("b < 0")
    sure = _expanded(pairs.where("near"), placed, "a").join(outlines.select("b", "region"), "b").select(F.col("a_key").alias("key"), "region")
    # Of an outline, a leaf needs the edges that a ray from one of its points to the east can cross.
    box = placed.groupBy("node").agg(F.min("lat").alias("lo"), F.max("lat").alias("hi"), F.min("lon").alias("west")).withColumnRenamed("node", "a")
    open_ = pairs.where("not near").join(box, "a").join(outlines, "b")
    beside = F.filter("edges", lambda e: (F.greatest(e["y1"], e["y2"]) > F.col("lo")) & (F.least(e["y1"], e["y2"]) <= F.col("hi")) & (F.greatest(e["x1"], e["x2"]) > F.col("west")))
    open_ = open_.select("a", "a_n", "region", beside.alias("edges")).where(F.size("edges") > 0)
    tested = _expanded(open_, placed, "a").where(_inside(F.col("edges"), F.col("a_lon"), F.col("a_lat"))).select(F.col("a_key").alias("key"), "region")
    return sure.unionByName(tested)


def points_near(points: DataFrame, metres: float) -> DataFrame:
    """near_pairs() of clean_points()."""
    ended, placed, _ = joined_leaves(written(points, "points"), metres)
    return near_pairs(ended, placed, metres)


def points_in(points: DataFrame, regions: DataFrame) -> DataFrame:
    """regions_of() of clean_points() and clean_regions()."""
    return regions_of(*joined_leaves(written(points, "points"), None, regions))


def clean_regions(regions: DataFrame, key: str, ring: str) -> DataFrame:
    """(region, edges, box, inner box, cell): the outlines as edges; ``ring`` is an array of structs of longitude and latitude."""
    rows = regions.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("region"), F.filter(ring, lambda p: p["longitude"].isNotNull() & p["latitude"].isNotNull()).alias("ring"))
    rows = rows.where(F.size("ring") >= 3).groupBy("region").agg(F.max("ring").alias("ring"))
    turned = F.concat(F.slice("ring", 2, F.size("ring") - 1), F.slice("ring", 1, 1))
    edge = lambda p, q: F.struct(p["longitude"].alias("x1"), p["latitude"].alias("y1"), q["longitude"].alias("x2"), q["latitude"].alias("y2"))
    lats, lons = F.transform("ring", lambda p: p["latitude"]), F.transform("ring", lambda p: p["longitude"])
    out = rows.select("region", F.zip_with("ring", turned, edge).alias("edges"), F.array_min(lats).alias("lat_lo"), F.array_max(lats).alias("lat_hi"), F.array_min(lons).alias("lon_lo"), F.array_max(lons).alias("lon_hi"))
    x, y = (F.col("lon_lo") + F.col("lon_hi")) / 2, (F.col("lat_lo") + F.col("lat_hi")) / 2
    out = out.select("*", x.alias("_x"), y.alias("_y"), ((F.col("lon_hi") - F.col("lon_lo")) / 2).alias("_w"), ((F.col("lat_hi") - F.col("lat_lo")) / 2).alias("_h"))
    # Where the middle is inside, its box can grow until it touches an edge: all of it is inside.
    grown = F.when(_inside(F.col("edges"), F.col("_x"), F.col("_y")) & (F.col("_w") > 0) & (F.col("_h") > 0), F.array_min(F.transform("edges", _reach)) * F.lit(1 - 1e-9))
    out = out.withColumn("_g", F.when(grown > 0, grown))
    inner = {"lat_lo": F.col("_y") - F.col("_g") * F.col("_h"), "lat_hi": F.col("_y") + F.col("_g") * F.col("_h"), "lon_lo": F.col("_x") - F.col("_g") * F.col("_w"), "lon_hi": F.col("_x") + F.col("_g") * F.col("_w")}
    out = out.select("region", "edges", *_BOX, *[c.alias(f"in_{n}") for n, c in inner.items()], "_x", "_y")
    return out.withColumn("cell", _node(_axis(F.col("_x"), -180, 360), _axis(F.col("_y"), -90, 180), DEPTH)).drop("_x", "_y")


def _reach(e: Column) -> Column:
    """The least scale at which the region's box around its middle touches an edge: the least of max(|u|, |v|) along it."""
    u1, v1 = (e["x1"] - F.col("_x")) / F.col("_w"), (e["y1"] - F.col("_y")) / F.col("_h")
    u2, v2 = (e["x2"] - F.col("_x")) / F.col("_w"), (e["y2"] - F.col("_y")) / F.col("_h")
    du, dv = u2 - u1, v2 - v1

    def at(t: Column) -> Column:
        return F.greatest(F.abs(u1 + t * du), F.abs(v1 + t * dv))

    # The greater of two convex functions is least at an end or where one of them turns or both meet.
    turns = [F.try_divide(-u1, du), F.try_divide(-v1, dv), F.try_divide(v1 - u1, du - dv), F.try_divide(-(u1 + v1), du + dv)]
    return F.least(at(F.lit(0.0)), at(F.lit(1.0)), *[at(F.least(F.greatest(F.coalesce(t, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))) for t in turns])


def _inside(edges: Column, x: Column, y: Column) -> Column:
    """Whether (x, y) is in the outline, by the parity of the edges crossed."""
    crossed = F.filter(
        edges,
        lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / F.when(e["y2"] == e["y1"], F.lit(1.0)).otherwise(e["y2"] - e["y1"]) + e["x1"]),
    )
    return (F.size(crossed) % 2) == 1
