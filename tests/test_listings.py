from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.functions import extract, keys, numbers, text
from skeinworks.operators import enrich, filters, items, lifecycle, ranking, reference

T0 = datetime(2025, 6, 1)
OFFER = "id string, source_id string, price_cents bigint, first_seen timestamp, last_seen timestamp, min_price_cents bigint, status string, expired_at timestamp, title string, seq bigint"


def column(spark, values, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_numbers(spark):
    assert column(spark, ["129.99", "89.5", "10", "1.239", "-2.5", "", "x", None, " 7 ", ".5"], "string", numbers.cents_truncated) == [12999, 8950, 1000, 123, -250, None, None, None, 700, 50]
    assert column(spark, [1.005, 2.5, 0.0, -1.0, None, float("nan")], "double", numbers.cents_rounded) == [100, 250, 0, 0, 0, 0]
    assert column(spark, [16.0, 0.96, 12345678.5, 1e-4, 22.96, None, 0.0], "double", numbers.rendered) == ["16", "0.96", "12345678.5", "0.0001", "22.96", None, "0"]
    assert column(spark, ["16", " 16", "16d", "NaN", "1e3", "0x10", "16\n", None], "string", numbers.number) == [16.0, None, None, None, 1000.0, None, None, None]


def test_extraction(spark):
    cap = lambda c: extract.capacity_tb(c)
    assert column(spark, ["16TB drive", "8 tb", "960GB", "6Gb/s SATA", "none", None, "18TBé", "256GB cache 16TB"], "string", cap) == ["16", "8", "0.96", None, None, None, "18", "0.256"]
    assert column(spark, ["STX ST16000NM001G x", "WUH721816ALE6L4", "WD140 a", "", None], "string", extract.model_number) == ["ST16000NM001G", "", "WD140", "", ""]
    assert column(spark, ["new", "as-is", "Recertified", "used", "", None], "string", lambda c: extract.condition(F.lit("x"), c)) == ["new", "parts", "refurb", "used", "", ""]
    assert column(spark, [" 1500 ", "7000", "2010"], "string", lambda c: extract.condition(c, F.lit("used"))) == ["new", "parts", "refurb"]
    assert column(spark, ["5.50 acres", "10 ac", "87,120 sq ft", "no", None, "3 acorns"], "string", extract.acreage) == ["5.5", "10", "2", None, None, None]
    assert column(spark, ["Well and septic, seller financing", "swell", None], "string", lambda c: F.map_keys(extract.flags(c))) == [["well", "septic", "owner_financing"], [], []]
    assert column(spark, ["APN: 123-456", "apn#12345", "APN 1", None], "string", extract.parcel_number) == ["123-456", "12345", "", ""]
    assert column(spark, ["The BIG big-Drive a 4", "", None], "string", text.tokens) == [["the", "big", "drive"], [], None]
    assert column(spark, ["<p>a &amp; b</p>\n c", "", None], "string", text.stripped_html) == ["a & b c", "", None]
    assert column(spark, [99.5, 97.0, 1.0, None], "double", lambda c: extract.tier(c, [(99.0, "high"), (97.0, "good")], "low")) == ["high", "good", "low", None]
    assert column(spark, [["Brand: Acme", "x"], [], None], "array<string>", lambda c: extract.tag_value(c, "brand:")) == ["Acme", None, None]
    assert column(spark, [["New"], ["used New"], ["a", "Recertified", "used"], [], None], "array<string>", extract.tagged_condition) == ["New", "Used", "Refurbished", "", ""]
    assert column(spark, ["AB_sr", "AB", None], "string", lambda c: extract.without_suffix(c, ["_P", "_SR"])) == ["AB", "AB", None]
    assert column(spark, ["", "/a", "b", "http://c"], "string", lambda c: extract.absolute_url(c, "https://h")) == ["", "https://h/a", "https://h/b", "http://c"]


def test_keys(spark):
    import hashlib

    df = spark.createDataFrame([("eb", "ay123"), ("ebay", "123")], "s string, k string")
    assert [r[0] for r in df.select(keys.listing_id(F.col("s"), F.col("k"))).collect()] == [hashlib.sha256(f"{a}\0{b}".encode()).hexdigest()[:16] for a, b in (("eb", "ay123"), ("ebay", "123"))]
    hints = spark.createDataFrame([("A-1", "x", "y"), (None, "Acme Co", "M 1"), ("", "a", None), (None, None, None)], "m string, b string, k string")
    assert [r[0] for r in hints.select(keys.product_key(F.col("m"), F.col("b"), F.col("k"))).collect()] == ["mpn:a1", "bm:acmeco:m1", "", ""]


def test_text_search_is_literal(spark):
    df = spark.createDataFrame([("50% off drives", None), ("500 off", ["a_b"]), (None, ["wooded"])], "title string, tokens array<string>")
    hit = lambda q: [r[0] for r in df.select(text.contains_text(F.col("title"), F.col("tokens"), q)).collect()]
    assert hit("50%") == [True, False, False] and hit("A_B") == [False, True, False] and hit("WOOD") == [False, False, True]


def test_latest_and_search(spark, rows):
    data = [("a", "x", 5, T0, 1), ("a", "y", 0, T0, 2), (None, "n", 1, T0, 3), ("b", "z", 9, T0 + timedelta(1), 1), ("c", "z", 7, T0 + timedelta(1), 1)]
    df = spark.createDataFrame(data, "id string, title string, price_cents bigint, seen_at timestamp, seq int")
    now = items.latest(df, "id", ["seq"])
    assert sorted(r["title"] for r in now.collect()) == ["y", "z", "z"]
    assert [r["id"] for r in items.search(now, items.ItemQuery(limit=2)).collect()] == ["b", "c"]
    assert [r["id"] for r in items.search(now, items.ItemQuery(max_price_cents=7)).collect()] == ["c"]
    assert items.without_stale(now.withColumn("source_id", F.lit("s")), "s", F.lit(T0 + timedelta(hours=1))).count() == 2
    assert items.latest(df.limit(0), "id", ["seq"]).count() == 0 and items.get(now, "b").count() == 1
    replaced = items.replaced(now, df.where("id = 'b'").withColumn("title", F.lit("new")).withColumn("seq", F.lit(9)), "id", ["seq"])
    assert dict(rows(replaced.select("id", "title")))["b"] == "new"


def test_filter_reasons(spark):
    data = [("d", 0, {"tb": "8"}, "new"), ("d", 9, {}, "new"), ("d", 9, {"tb": "16d"}, "new"), ("d", 9, {"tb": "4"}, "new"), ("d", 900, {"tb": "8"}, "new"), ("e", 9, {"tb": "8"}, "new"), ("d", 9, {"tb": "8"}, None), ("d", 9, {"tb": "8"}, "new"), (None, None, None, None)]
    df = spark.createDataFrame(data, "category string, price_cents bigint, attributes map<string,string>, condition string")
    spec = filters.HardFilter(category="d", needs_price=True, max_price_cents=100, least={"tb": 6.0}, conditions=("new",))
    assert [r["reason"] for r in filters.explained(df, spec).collect()] == ["unpriced", "missing:tb", "not_numeric:tb", "below:tb", "price", "category", "condition", None, "category"]
    assert {r["reason"] for r in filters.explained(df, filters.HardFilter()).collect()} == {None}


def offers(spark, data):
    return spark.createDataFrame([(i, "s", p, t, t, p, "active", None, f"t{n}", n) for n, (i, p, t) in enumerate(data)], OFFER)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 3), st.integers(0, 5)), min_size=1, max_size=12), st.integers(0, 12))
def test_any_batching_folds_to_the_same_state(spark, seen, cut):
    df = offers(spark, [(i, p * 100, T0 + timedelta(days=d)) for i, p, d in seen])
    whole = lifecycle.folded(df, ["seq"])
    parts = lifecycle.folded(lifecycle.folded(df.where(F.col("seq") < cut), ["seq"]).unionByName(df.where(F.col("seq") >= cut)), ["seq"])
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, parts.collect()), key=str)


def test_lifecycle(spark):
    day = lambda n: T0 + timedelta(days=n)
    state = lifecycle.folded(offers(spark, [("a", 100, day(2)), ("a", 70, day(1)), ("a", 0, day(3)), ("b", 5, day(0)), (None, 1, day(0))]), ["seq"])
    a = {r["id"]: r for r in state.collect()}["a"]
    assert (a["first_seen"], a["last_seen"], a["min_price_cents"], a["price_cents"], a["title"]) == (day(1), day(3), 70, 0, "t2")
    gone = lifecycle.expired(state, "s", F.lit(day(1)), F.lit(day(9)))
    assert {r["id"]: (r["status"], r["expired_at"]) for r in gone.collect()} == {"a": ("active", None), "b": ("expired", day(9))}
    back = lifecycle.folded(gone.unionByName(offers(spark, [("z", 1, day(0))] * 0 + [("b", 9, day(4))]).withColumn("seq", F.lit(99).cast("bigint"))), ["seq"])
    b = {r["id"]: r for r in back.collect()}["b"]
    assert (b["status"], b["expired_at"], b["first_seen"], b["min_price_cents"]) == ("active", None, day(0), 5)
    assert [r["id"] for r in lifecycle.retained(gone, None, F.lit(day(1))).collect()] == ["a"]
    assert [r["id"] for r in lifecycle.offers_where(gone).collect()] == ["a"] and lifecycle.offers_where(gone, status=None, limit=1).count() == 1
    windows = spark.createDataFrame([("s", 86400)], "source_id string, seconds bigint")
    assert {r["status"] for r in lifecycle.expired_by_source(state, windows, F.lit(day(9))).collect()} == {"expired"}


def test_reference(spark, rows):
    data = [("x", 1, "refurb", 10), ("x", 1, "refurb", 15), ("x", 1, "refurb", 16), ("x", 1, "new", 40), ("x", 2, "used", 7), ("x", None, "used", 7), ("x", 1, None, 3)]
    df = spark.createDataFrame(data, "reference string, bucket bigint, condition string, v bigint")
    medians = reference.grouped_median(df, ["bucket", "condition"], "v", least=1)
    assert sorted(rows(medians)) == [(1, "new", 40, 1), (1, "refurb", 15, 3), (2, "used", 7, 1)]
    only = medians.where("condition = 'refurb'")
    got = reference.with_reference(df, only, "bucket", "condition", "refurb", {"new": 1.35}).select("bucket", "condition", "reference", "reference_from").distinct()
    assert sorted(rows(got), key=str) == sorted([(1, "refurb", 15, "own"), (1, "new", 20, "anchor"), (2, "used", None, None), (None, "used", None, None), (1, None, None, None)], key=str)


def test_watches_limit_before_filter(spark, rows):
    df = spark.createDataFrame([(f"i{n}", "c", f"blue {n}", T0 + timedelta(days=n), "w") for n in range(5)], "id string, category string, title string, seen_at timestamp, watch string")
    got = ranking.matched_watches(df, [{"name": "a", "category": "c", "text": "BLUE", "limit": 2}, {"name": "b", "category": "x"}, {"name": "all"}])
    assert sorted(r["id"] for r in got.where("watch = 'a'").collect()) == ["i3", "i4"] and got.where("watch = 'all'").count() == 5 and got.where("watch = 'b'").count() == 0


def test_lookups(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, n int")
    facts = spark.createDataFrame([("a", 9, 7), ("a", 9, 7)], "k string, f int, n int")
    assert sorted(rows(enrich.looked_up(df, facts, ["k"], drop=["k"])), key=str) == [(1, 9), (2, None), (3, None)]
    calls = enrich.asked(df.where("n > 1"), "k", lambda ks: [(len(k),) if k else None for k in ks], "size bigint")
    assert rows(calls) == [("b", 1)]


def test_invalid_fields(spark):
    df = spark.createDataFrame([("a", 1, "x"), (" ", 1, "x"), ("a", -1, "x"), ("a", 1, "q"), (None, None, None)], "k string, p bigint, s string")
    assert [r[0] for r in df.select(items.invalid_field(["k"], ["p"], {"s": ["x"]})).collect()] == [None, "k", "p", "s", "k"]


def test_dates_and_labels(spark):
    moments = column(spark, ["2024-01-02T03:04:05.678Z", "2024-01-02T03:04:05+01:00", "2024-01-02T03:04:05", "2024-01-02", "x", None], "string", lambda c: extract.instant(c).cast("string"))
    assert moments == ["2024-01-02 03:04:05.678", "2024-01-02 02:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None]
    now = F.lit(T0)
    assert column(spark, [T0 - timedelta(days=2, hours=5), T0, T0 + timedelta(days=1), None], "timestamp", lambda c: extract.whole_days(c, now)) == [2, 0, None, None]
    assert column(spark, ["US", "DE", " ", None], "string", lambda c: extract.labelled(c, {"true": ("US",)}, "false")) == ["true", "false", None, None]
    assert column(spark, ["48.5", "0", "91", "x", None], "string", lambda c: extract.placed(c, F.lit("-122.1"))) == [True, False, False, False, False]
