import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from skeinworks.operators import history

SCHEMA = "id string, taken bigint, loaded timestamp, row bigint, first bigint, price bigint, status string"
BASE = datetime(2025, 1, 1)


def brute(data):
    best = {}
    for i, t, loaded, row, *values in data:
        if i is not None and t is not None and ((i, t) not in best or (loaded or BASE - timedelta(9999), row or -1) > best[i, t][0]):
            best[i, t] = ((loaded or BASE - timedelta(9999), row or -1), values)
    out, last, known = [], None, None
    for (i, t), (_, values) in sorted(best.items()):
        if i != last:
            out.append([i, t, 0])
            known, last = values, i
            continue
        now = [a if a is not None else b for a, b in zip(values, known)]
        if now != known:
            out[-1][2] = t
            out.append([i, t, 0])
        known = now
    return sorted(map(tuple, out))


def run(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    got = history.versions(df, "id", "taken", "loaded", "row", ["first", "price", "status"])
    return sorted((r[0], r[1], r[2]) for r in got.select("id", "valid_from", "valid_to").collect())


def made(seed, n, entities, hot=0.0):
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        i = "hot" if rnd.random() < hot else f"e{rnd.randrange(entities)}"
        out.append((i, rnd.randrange(n // 2) + 10**18, BASE + timedelta(seconds=rnd.randrange(50)), k, rnd.choice([None, 10**18 + 1, 10**18 + 3]), rnd.choice([None, 5, 5, 6]), rnd.choice([None, "active", "active", "expired"])))
    return out


def test_against_brute_force(spark):
    for seed, hot in ((1, 0), (2, 0.4), (3, 0.95)):
        data = made(seed, 600, 12, hot)
        assert run(spark, data) == brute(data)


def test_one_entity_over_many_blocks(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        data = [("x", t, BASE, t, 1 if t > 90 else None, None if t % 7 else 3, "a" if t < 60 else None) for t in range(1, 200)]
        assert run(spark, data) == brute(data)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nulls_ties_and_empty(spark):
    data = [(None, 1, BASE, 1, 1, 1, "a"), ("x", None, BASE, 2, 1, 1, "a"), ("x", 1, None, 3, None, None, None), ("x", 1, None, 3, None, None, None), ("x", 2, BASE, 4, None, None, None), ("y", 1, BASE, 5, 1, 2, "a")]
    assert run(spark, data) == [("x", 1, 0), ("y", 1, 0)]
    assert run(spark, []) == []


def test_clashing_names(spark):
    df = spark.createDataFrame([("x", 1, 1, 1, "p", 9), ("x", 2, 1, 1, "q", 9)], "entity string, t bigint, l bigint, r bigint, at string, block int")
    got = history.versions(df, "entity", "t", "l", "r", ["at"]).orderBy("valid_from")
    assert [tuple(r) for r in got.collect()] == [("x", 1, 2, "p"), ("x", 2, 0, "q")]


def test_scan_is_a_prefix_merge():
    merged = history._scan([(i,) for i in range(11)], lambda a, b: a + b)
    assert merged[-1] == tuple(range(11)) and merged[4] == (0, 1, 2, 3, 4)


def test_plan_has_no_join_of_all_rows(spark):
    df = spark.createDataFrame(made(5, 50, 4), SCHEMA)
    plan = history.versions(df, "id", "taken", "loaded", "row", ["price"]).where(F.col("id") != "")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
