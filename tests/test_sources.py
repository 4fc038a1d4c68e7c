import io
import json
import threading
import urllib.error
from http.server import BaseHTTPRequestHandler, HTTPServer
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from skeinworks.sources import config, http, land, marketplace, storefront
from skeinworks.sources.raw import gated

NOW = datetime(2025, 6, 1)


def saved(tmp_path, value, name="x.json"):
    path = tmp_path / name
    path.write_bytes(value if isinstance(value, bytes) else json.dumps(value).encode())
    return str(path)


def test_marketplace(spark, tmp_path):
    found = {"itemSummaries": [
        {"itemId": "1", "title": "A 8TB", "conditionId": "1000", "condition": "New", "price": {"value": "89.5", "currency": "USD"}, "seller": {"username": "secret", "feedbackPercentage": "99.5", "feedbackScore": 12}, "itemLocation": {"country": "US"}},
        {"itemId": "2", "price": {"value": "x"}}, {"title": "no id"}, {"itemId": " "},
    ]}
    profiles = spark.createDataFrame([("secret", 400, 12)], "username string, account_age_days bigint, recent_sales bigint")
    raw = marketplace.mapped(marketplace.responses(spark, saved(tmp_path, found)), "market", NOW, profiles)
    got = {r["source_key"]: r for r in raw.collect()}
    assert set(got) == {"1", "2"} and got["1"]["price_cents"] == 8950 and got["2"]["price_cents"] == 0
    assert got["1"]["aspects"]["seller_account_age_days"] == "400" and "secret" not in str(got["1"])
    passed, skipped = gated(raw, "b", F.when(F.col("title") == "", "no title"))
    assert passed.count() == 1 and [tuple(r) for r in skipped.collect()] == [("2", "gate", "no title")]


def test_storefront(spark, tmp_path):
    found = {"products": [
        {"id": 1, "title": "P", "handle": "h", "body_html": "<b>x</b> &lt;y", "vendor": "House", "product_type": "Hard Drives > 24TB > SAS", "tags": ["brand:Acme", "Refurbished"], "variants": [{"id": 10, "title": "Default Title", "price": "799.00", "sku": "AB_SR", "available": True}, {"id": 11, "title": "16TB", "price": "1", "available": False}, {"id": 0, "available": True}]},
        {"id": 2, "title": "Cable", "product_type": "Cables", "tags": "new, x", "variants": [{"id": 20, "available": True, "price": "5"}]}, {"id": 3, "title": "none"},
    ]}
    body = json.dumps(found).encode().replace(b"Cable\"", b"Cab\x94\x94le\"", 1)
    products = storefront.products(spark, saved(tmp_path, body))
    assert "Cab?le" in [r["title"] for r in products.collect()]
    rows = storefront.mapped(products, F.lit("shop"), "https://s", F.lit(NOW), ["hard drives"], brand_tag="brand:", sku_suffixes=["_SR"]).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["source_key"], r["price_cents"], r["condition_raw"], r["hint_brand"], r["hint_mpn"], r["body"], r["aspects"]["capacity_tb"]) == ("1:10", 79900, "Refurbished", "Acme", "AB", "x <y", "24")
    everything = storefront.mapped(products, F.lit("shop"), "https://s", F.lit(NOW), unavailable=True)
    assert {r["source_key"] for r in everything.collect()} == {"1:10", "1:11", "2:20"}
    assert storefront.feed(products).count() == 0


def test_land(spark, tmp_path):
    lots = {"data": [{"zpid": "1", "address": "1 Rd", "addressCity": "X", "addressState": "WA", "unformattedPrice": 149000.0, "detailUrl": "/d", "latLong": {"latitude": 48.5, "longitude": -122.0}, "hdpData": {"homeInfo": {"lotAreaValue": 5.19, "lotAreaUnit": "acres"}}}, {"zpid": "2", "lotArea": {"value": 87120, "unit": ""}}, {"address": "none"}]}
    got = {r["source_key"]: r for r in land.mapped(land.lots(spark, saved(tmp_path, lots)), "land", "https://l", F.lit(NOW)).collect()}
    assert got["1"]["aspects"] == {"acreage": "5.19", "street_address": "1 Rd", "location": "X, WA", "lat": "48.5", "lon": "-122"} and got["1"]["price_cents"] == 14900000 and got["1"]["source_url"] == "https://l/d"
    assert got["2"]["aspects"] == {"acreage": "2"} and got["2"]["price_cents"] == 0 and len(got) == 2


class Answer(io.BytesIO):
    def __init__(self, body=b"{}", status=200, headers=None):
        super().__init__(body)
        self.status, self.headers = status, headers or {}


def test_http_client():
    waits, calls = [], []

    def opener(request, timeout):
        calls.append(request.full_url)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 429, "", {"Retry-After": "7"}, io.BytesIO(b""))
        return Answer(b"ok", headers={"X-RateLimit-Remaining": "1"})

    budget = http.DailyBudget(10, now=lambda: datetime(2025, 1, 1, tzinfo=UTC))
    assert http.patient_get("u://a", {}, budget, None, opener, waits.append) == b"ok" and waits == [7.0, 7.0] and budget.left() == 1
    budget.reserve()
    with pytest.raises(http.BudgetSpent):
        budget.reserve()
    budget.now = lambda: datetime(2025, 1, 2, tzinfo=UTC)
    assert budget.left() == 10

    def failing(request, timeout):
        raise urllib.error.HTTPError(request.full_url, 500, "", {}, io.BytesIO(b'{"error":{"code":"c","message":"m","request_id":"r"}}'))

    with pytest.raises(http.Unavailable, match="500: c m r"):
        http.patient_get("u://a", {}, None, None, failing, waits.append)


def test_walk_and_token():
    pages = {1: [1, 2], 2: [3]}
    got = list(http.walk("u?page={page}", lambda u: json.dumps({"p": pages.get(int(u[-1]), [])}).encode(), "p", 2, 4))
    assert [(p, c) for _, p, c, _ in got] == [(1, True), (2, True)]
    assert [(p, c) for _, p, c, _ in http.walk("u?page={page}", lambda u: b'{"p":[]}', "p", 2, 4)] == [(1, True)]
    assert [c for *_, c, _ in http.walk("u?page={page}", lambda u: b'{"p":[1,2]}', "p", 2, 2)] == [False, False]
    clock, asked = [0.0], []
    cache = http.TokenCache(lambda: (asked.append(1) or f"t{len(asked)}", 100.0), lambda: clock[0])
    assert cache.get() == cache.get() == "t1"
    clock[0] = 41.0
    assert cache.get() == "t2"


def test_paged_source_in_a_session(spark, tmp_path, monkeypatch):
    http.register(spark)
    reader = http._PagedReader({"url": "a b"})
    assert [p.url for p in reader.partitions()] == ["a", "b"]


def test_filters_of_a_query_reach_the_land_search(spark):
    bodies = []

    class Search(BaseHTTPRequestHandler):
        def do_POST(self):
            bodies.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"data":[]}')

        def log_message(self, *_):
            return

    server = HTTPServer(("127.0.0.1", 0), Search)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    http.register(spark)
    rows = spark.read.format("land_search").options(url=f"http://127.0.0.1:{server.server_address[1]}/x", west="1", south="2", east="3", north="4").load()
    assert rows.where("acres > 2 and price_cents <= 100000 and body <> ''").collect() == []
    server.shutdown()
    assert bodies[0]["lotSize"] == {"min": 87120} and bodies[0]["price"] == {"max": 1000}


def test_budget_that_readers_share(tmp_path):
    day = [datetime(2025, 1, 1, tzinfo=UTC)]
    made = lambda: http.SharedBudget(40, now=lambda: day[0], path=str(tmp_path / "b"))
    threads = [threading.Thread(target=lambda: [made().reserve() for _ in range(5)]) for _ in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    with pytest.raises(http.BudgetSpent):
        made().reserve()
    day[0] = datetime(2025, 1, 2, tzinfo=UTC)
    made().reserve()
    made().hear("0")
    with pytest.raises(http.BudgetSpent):
        made().reserve()


def test_searches_and_tokens():
    assert http.with_parameters("u://s", {"q": "hard drive", "limit": "50", "filter": ""}) == "u://s?limit=50&q=hard+drive" and http.with_parameters("u://s?a=1", {"q": "x"}) == "u://s?a=1&q=x" and http.with_parameters("u", {}) == "u"
    seen = []

    def opener(request, timeout):
        seen.append((request.headers["Authorization"], request.data))
        return Answer(b'{"access_token":"t","expires_in":7200}')

    assert http.client_token("u://t", "me", "pw", "s", opener) == ("t", 7200.0) and seen == [("Basic bWU6cHc=", b"grant_type=client_credentials&scope=s")]


def test_profiles(spark):
    from skeinworks.sources import profiles

    now = datetime(2025, 6, 1, tzinfo=UTC)
    good = {"Ack": "success", "User": {"RegistrationDate": "2025-05-02T00:00:00.000Z", "FeedbackHistory": {"PositiveFeedbackPeriodArray": {"FeedbackPeriod": [{"PeriodInDays": 7, "Count": 1}, {"PeriodInDays": 30, "Count": 12}]}}}}
    assert profiles.figures(json.dumps(good), now) == (30, 12) and profiles.figures(b'{"Ack":"Failure"}', now) is None
    assert profiles.figures('{"Ack":"Success","User":{"RegistrationDate":"2030-01-01T00:00:00Z"}}', now) == (None, None)
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "username string, n int")
    text = json.dumps(good)
    got = profiles.profiles(rows, "username", lambda name: text if name == "a" else 1 / 0, now)
    assert [tuple(r) for r in got.collect()] == [("a", 30, 12)]


def test_points_addresses_and_parcels(spark):
    from skeinworks.sources import places

    match = '{"result":{"addressMatches":[{"coordinates":{"x":-97.5,"y":30.25}}]}}'
    answers = spark.createDataFrame([("Austin, TX", match), ("Nowhere", '{"result":{"addressMatches":[]}}')], "location string, answer string")
    data = [("own", {"lat": "1.5", "lon": "2.5", "location": "Austin, TX", "street_address": "1 Oak"}), ("place", {"location": " Austin, TX "}), ("zero", {"lat": "0", "lon": "0", "location": "Nowhere"}), ("none", {}), ("null", None)]
    got = {r.id: (r.lat, r.lon, r.address) for r in places.with_points(spark.createDataFrame(data, "id string, attributes map<string,string>"), answers).collect()}
    assert got == {"own": (1.5, 2.5, "1 Oak"), "place": (30.25, -97.5, "Austin, TX"), "zero": (None, None, "Nowhere"), "none": (None, None, None), "null": (None, None, None)}
    parcels = spark.createDataFrame([("a", 150, 99, 1990, 1.5), ("b", 0, None, 2000, None), ("c", None, None, None, None)], "address string, improvement_cents bigint, land_cents bigint, year_built int, acres double")
    facts = {r.address: r.facts for r in places.parcel_facts(parcels).collect()}
    assert facts == {"a": {"assessed_improvement_usd": "1.50", "assessed_land_usd": "0.99", "year_built": "1990", "acreage": "1.5000", "structure_present": "true"}, "b": {"assessed_improvement_usd": "0.00", "year_built": "2000", "structure_present": "false"}, "c": {}}


def test_config():
    good = {"categories": {"drive": {}}, "sources": [{"name": "a", "type": "shop", "category": "drive"}]}
    assert config.run_config(json.dumps(good), ("drive",), ("shop",)) == good
    for bad in ({}, {"categories": {"x": {}}}, good | {"sources": [{"name": ""}]}, good | {"sources": good["sources"] * 2}, good | {"sources": [{"name": "a", "type": "q"}]}, good | {"defaultCategory": "z"}, good | {"sources": [{"name": "a", "type": "shop", "category": "z"}]}):
        with pytest.raises(ValueError):
            config.run_config(json.dumps(bad), ("drive",), ("shop",))
    assert config.category_of("", ["a"]) == "a" and config.category_of("", ["a", "b"], "b") == "b"
    for wanted, known in (("z", ["a"]), ("", ["a", "b"])):
        with pytest.raises(ValueError):
            config.category_of(wanted, known)
    with pytest.raises(ValueError):
        config.watches('{"watches":[{"name":" "}]}')
    assert not config.active({"expires_at": "2025-01-01"}, datetime(2025, 1, 1)) and config.active({}, datetime(2025, 1, 1))


def test_land_search_pushes_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThanOrEqual

    asked = [GreaterThanOrEqual(("acres",), 2.0), LessThanOrEqual(("price_cents",), 1_000_050), LessThanOrEqual(("days",), 30), EqualTo(("body",), "x")]
    reader = http._LandReader({"west": "1", "south": "2", "east": "3", "north": "4", "max_items": "99"})
    assert reader.pushFilters(asked) == asked
    assert reader.body == {"bounds": {"west": 1.0, "south": 2.0, "east": 3.0, "north": 4.0}, "maxItems": 50, "lotSize": {"min": 87120}, "price": {"max": 10001}, "daysOnMarket": 30}
    lot = {"unformattedPrice": 10.5, "daysOnZillow": 3, "hdpData": {"homeInfo": {"lotAreaValue": 87120, "lotAreaUnit": "sqft"}}}
    assert [r[:3] for r in http.lot_rows(json.dumps({"data": [lot, {}]}).encode())] == [(2.0, 1050, 3), (None, 0, None)]


def test_place_facts(spark):
    from skeinworks.sources import places

    data = [("a", '{"features":[{"attributes":{"FLD_ZONE":"AE","ZONE_SUBTY":" "}}]}', '{"value":"12.50"}', '{"Table":[["c"],["Barneston","Loam",85]]}'), ("b", "broken", '{"value":-1000000}', None)]
    answers = spark.createDataFrame(data, "place string, f string, e string, s string")
    facts = answers.select("place", places.attributes(flood=F.col("f"), elevation=F.col("e"), soil=F.col("s")).alias("facts"))
    items = spark.createDataFrame([("1", "a", {"flood_zone": "own"}), ("2", "b", None), ("3", None, None)], "id string, place string, attributes map<string,string>")
    got = {r["id"]: r["attributes"] for r in places.with_facts(items, facts, ["place"]).collect()}
    assert got == {"1": {"flood_zone": "own", "elevation_m": "12.5", "soil_series": "Barneston", "soil_map_unit": "Loam", "soil_component_pct": "85"}, "2": {}, "3": {}}
