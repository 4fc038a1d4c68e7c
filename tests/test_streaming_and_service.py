import json
import threading
import urllib.request
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skeinworks.operators.filters import HardFilter
from skeinworks.service import api, cli
from skeinworks.sources.http import BudgetSpent
from skeinworks.sources.raw import RAW
from skeinworks.streaming import ingest
from skeinworks.streaming.snapshot import SnapshotTable

T0 = datetime(2025, 6, 1)


def raw(spark, data):
    return spark.createDataFrame([("s", k, "u", title, "", price, "USD", "1000", {}, seen) for k, title, price, seen in data], RAW)


def tables(spark, root, source, **windows):
    made = ingest.Source(source, ingest.drives, **windows)
    return ingest.Ingester(made, SnapshotTable(spark, f"file://{root}/offers", ingest.OFFERS), SnapshotTable(spark, f"file://{root}/items", ingest.ITEMS))


def test_batches_fold_and_housekeep(spark, tmp_path):
    day = lambda n: T0 + timedelta(days=n)
    g = tables(spark, tmp_path, "s", expire_after=86400, delete_after=5 * 86400, stale_items=86400)
    first = g.ingest(raw(spark, [("a", "8TB disk", 100, day(0)), ("b", "4TB", 50, day(0)), ("", "x", 1, day(0)), ("c", " ", 1, day(0))]), 1, F.lit(day(0)))
    assert first == {"fetched": 4, "skipped_offer": 1, "offers": 3, "expired": 0, "skipped_gate": 1, "items": 2, "skipped_extract": 1}
    g.ingest(raw(spark, [("a", "8TB disk", 70, day(3))]), 2, F.lit(day(3)), complete=False)
    assert {r["status"] for r in g.offers.read().collect()} == {"active"}
    again = g.ingest(raw(spark, [("a", "8TB disk", 70, day(3))]), 2, F.lit(day(3)))
    state = {r["source_key"]: r for r in g.offers.read().collect()}
    assert again["items"] == 1 and again["expired"] == 2 and state["a"]["min_price_cents"] == 70 and state["a"]["first_seen"] == day(0) and state["b"]["status"] == "expired"
    g.ingest(raw(spark, []), 3, F.lit(day(6)))
    assert [r["source_key"] for r in g.offers.read().collect()] == ["a"]
    assert g.offers.version() == 4 and g.offers.read(3).count() == 3


def test_writers_of_one_part_lose_and_repeat_nothing(spark, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/t", "k string")
    add = lambda w: table.update(lambda t: t.unionByName(spark.createDataFrame([(f"{w}-{i}",) for i in range(20)], "k string")))
    threads = [threading.Thread(target=add, args=(w,)) for w in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert table.version() == 8 and sorted(r["k"] for r in table.read().collect()) == sorted(f"{w}-{i}" for w in range(8) for i in range(20))


def test_sources_share_a_table(spark, tmp_path):
    offers, found = SnapshotTable(spark, f"file://{tmp_path}/offers", ingest.OFFERS), SnapshotTable(spark, f"file://{tmp_path}/items", ingest.ITEMS)
    made = [ingest.Ingester(ingest.Source(f"s{n}", ingest.drives), offers, found) for n in range(4)]

    def fetch(name):
        if name == "s3" and poller.health[name]["turns"] == 2:
            raise OSError("no answer")
        if name == "s2" and poller.health[name]["turns"] == 2:
            raise BudgetSpent("today")
        return raw(spark, [(f"{name}-{i}", "8TB disk", 5 + i, T0) for i in range(25)]).withColumn("source_id", F.lit(name)), True

    poller = ingest.Poller(made, fetch, lambda: F.lit(T0), every=0.0)
    [t.join() for t in poller.start(turns=2)]
    assert {n: (h["errors"], h["waits"]) for n, h in poller.health.items()} == {"s0": (0, 0), "s1": (0, 0), "s2": (0, 1), "s3": (1, 0)}
    for table in (offers, found):
        rows = table.read().collect()
        assert len(rows) == 100 and len({r["id"] for r in rows}) == 100 and table.version() == 6


def test_the_last_arrival_wins_within_a_batch(spark, tmp_path):
    late = T0 - timedelta(days=1)
    data = [("a", "t1", 5, T0), ("a", "t2", 4, T0 + timedelta(milliseconds=1)), ("a", "t3", 6, late)]
    for k, order in enumerate([data, data[::-1], [data[1], data[2], data[0]]]):
        g = tables(spark, tmp_path / str(k), "s")
        placed = raw(spark, order).withColumn("position", F.regexp_extract("title", "t(.)", 1).cast("bigint"))
        g.ingest(placed.repartition(3), 1, F.lit(T0))
        row, item = g.offers.read().first(), g.items.read().first()
        assert (row["title"], row["price_cents"], row["min_price_cents"], row["first_seen"], row["last_seen"]) == ("t3", 6, 4, late, T0 + timedelta(milliseconds=1)) and item["title"] == "t3" and item["class"] == "untrusted"
        g = tables(spark, tmp_path / f"unplaced{k}", "s")
        g.ingest(raw(spark, order), 1, F.lit(T0))
        assert g.offers.read().first()["title"] == "t2"


def test_windows_are_checked_before_anything_is_deleted():
    for bad in ({"delete_after": 5, "expire_after": 9}, {"stale_items": -1}):
        with pytest.raises(ValueError):
            ingest.Source("s", None, **bad)


def test_stream_of_files(spark, tmp_path):
    raw(spark, [("a", "8TB", 9, T0), ("b", "land 5 acres", 9, T0)]).write.json(str(tmp_path / "in"), timestampFormat="yyyy-MM-dd HH:mm:ss")
    g = tables(spark, tmp_path, "s")
    rows = spark.readStream.schema(RAW).option("timestampFormat", "yyyy-MM-dd HH:mm:ss").json(str(tmp_path / "in"))
    ingest.stream(spark, rows, g, str(tmp_path / "ckpt"), lambda: F.lit(T0)).awaitTermination(60)
    assert g.offers.read().count() == 2 and {r["attributes"].get("capacity_tb") for r in g.items.read().collect()} == {"8", None}


def test_windowed_counts(spark, tmp_path):
    spark.createDataFrame([(T0, "a"), (T0 + timedelta(minutes=7), "a"), (T0 + timedelta(hours=2), "b")], "ts timestamp, kind string").write.parquet(str(tmp_path / "e"))
    events = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path / "e"))
    query = ingest.windowed_counts(events, "ts", ["kind"], "10 minutes", "5 minutes").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert spark.table("w").count() == 3


def test_land_items(spark):
    df = raw(spark, [("a", "5 acres with well, APN: 12345-6", 1, T0)]).selectExpr("*", "1L as batch", "1L as position", "'untrusted' as boundary").withColumn("aspects", F.create_map(F.lit("location"), F.lit("X"), F.lit("lat"), F.lit(" 4 ")))
    got = ingest.land(df).first()
    assert got["attributes"]["acreage"] == "5" and got["attributes"]["well"] == "true" and got["attributes"]["location"] == "X" and got["canonical_id"] == "12345-6"


def test_service(spark, tmp_path):
    g = tables(spark, tmp_path, "s")
    g.ingest(raw(spark, [("a", "blue 8TB", 100, T0), ("b", "blue 4TB", 50, T0), ("c", "red 16TB", 70, T0), ("d", "blue 10TB", 0, T0), ("e", "blue 12TB", 30, T0)]), 1, F.lit(T0))
    watches = [{"name": "w", "category": "drive", "text": "blue"}, {"name": "gone", "category": "drive", "text": "", "expires_at": "2020-01-01"}, {"name": "none", "category": "drive", "text": "zzz"}]
    service = api.Service(g.items.read, {"drive": HardFilter(least={"capacity_tb": 6.0})}, watches=watches, gauges=lambda: [("calls", {"source": "s"}, 3)], strong={"drive": HardFilter(needs_price=True, max_price_cents=50)})
    get = lambda target, method="GET", body=b"": api.answer(service, method, target, body)
    found = json.loads(get("/search?text=BLUE&limit=5")[2])
    assert (found["matched"], found["filtered"], [i["title"] for i in found["items"]]) == (4, 3, ["blue 12TB", "blue 8TB", "blue 10TB"])
    assert json.loads(get("/search?limit=0")[2])["matched"] == json.loads(get("/search")[2])["matched"] == json.loads(get("/search?limit=9000")[2])["matched"] == 5
    assert get("/search?limit=x")[0] == 400 and get("/search?limit=-1")[0] == 400 and get("/search?category=z")[0] == 400 and get("/search", "POST")[0] == 405 and get("/none")[0] == 404
    key = found["items"][0]["id"]
    assert json.loads(get(f"/item?id={key}")[2])["id"] == key and get("/item?id=zz")[0] == 404 and get("/item")[0] == 400
    w = json.loads(get("/watches")[2])["watches"]
    assert [(x["name"], x["candidate_count"], x["strong_count"], [i["title"] for i in x["strong"]]) for x in w] == [("w", 3, 1, ["blue 12TB"]), ("none", 0, 0, [])]
    service.watches = [{"name": "q", "category": "boat"}]
    assert get("/watches")[0] == 400
    assert get("/metrics")[2] == 'calls{source="s"} 3\n' and get("/healthz")[0] == 200
    rpc = lambda m, **p: json.loads(get("/mcp", "POST", json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p}).encode())[2])
    assert len(rpc("tools/list")["result"]["tools"]) == 2 and rpc("initialize")["result"]["serverInfo"]["name"] == "skeinworks" and rpc("nope")["error"]["code"] == -32601
    assert rpc("tools/call", name="get_item", arguments={"id": "zz"})["result"]["isError"] is True
    assert "blue 8TB" in rpc("tools/call", name="search_items", arguments={"text": "blue"})["result"]["content"][0]["text"]
    assert get("/mcp", "POST", b'{"jsonrpc":"2.0","method":"notifications/initialized"}')[0] == 202


def test_command_line(spark, tmp_path, capsys):
    item = lambda k, title, price: {"itemId": k, "title": title, "price": {"value": price, "currency": "USD"}, "conditionId": "3000"}
    (tmp_path / "m.json").write_text(json.dumps({"itemSummaries": [item("1", "Disk 8TB used", "80.00"), item("2", "Disk 4TB used", "60.00"), item("3", "", "1")]}))
    store = f"file://{tmp_path}/store"
    assert cli.main(["ingest", str(tmp_path / "m.json"), "--store", store, "--source", "m"], spark) == 0
    assert "fetched=3" in capsys.readouterr().out
    assert cli.main(["search", "--store", store, "--category", "drive", "--text", "disk"], spark) == 0
    out = capsys.readouterr().out.splitlines()
    assert out[0].split() == ["rank", "price", "$/TB", "TB", "condition", "title"] and out[1].split()[:4] == ["1", "$60.00", "$15.00", "4"] and out[-1] == "2 matched, 2 after the filter"
    assert cli.main(["search", "--store", store, "--category", "drive", "--json"], spark) == 0 and json.loads(capsys.readouterr().out)["matched"] == 2
    assert cli.main(["search", "--store", store, "--category", "boat"], spark) == 1
    assert cli.main(["list"]) == 0 and "p6_found" in capsys.readouterr().out
    assert cli.main(["version"]) == 0 and cli.main(["run", "zz", "d"]) == 2
    service = cli._service(spark, cli.parser().parse_args(["serve", "--store", store, "--category", "drive"]))
    server = api.serve(service, 0)
    thread = threading.Thread(target=server.handle_request)
    thread.start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_address[1]}/search", timeout=60) as answer:
        assert json.loads(answer.read())["matched"] == 2
    thread.join()
    server.server_close()


def test_derived_once_a_version(spark, tmp_path):
    table, calls = SnapshotTable(spark, f"file://{tmp_path}/t", "k string"), []
    make = lambda df: calls.append(1) or df
    table.write(spark.createDataFrame([("a",)], "k string"))
    assert table.derived("x", make).count() == table.derived("x", make).count() == 1 and len(calls) == 1
    table.write(spark.createDataFrame([("a",), ("b",)], "k string"))
    assert table.derived("x", make).count() == 2 and len(calls) == 2


def test_watches_count_all_candidates(spark):
    items = spark.range(1700).selectExpr("cast(id as string) as id", "'drive' as category", "'blue disk' as title", "id * 100 as price_cents", "timestamp_seconds(id) as seen_at", "cast(map() as map<string,string>) as attributes", "'' as currency", "'' as condition", "'' as source_url")
    watches = [{"name": n, "category": "drive", "text": t, "limit": k} for n, t, k in (("all", "blue", 0), ("some", "blue", 1500), ("few", "blue", 3), ("none", "red", 0))]
    service = api.Service(lambda: items, {"drive": HardFilter()}, watches=watches)
    got = {w["name"]: (w["candidate_count"], w["cut"], len(w["candidates"])) for w in service.watched()}
    assert got == {"all": (1700, True, 500), "some": (1500, True, 500), "few": (3, False, 3), "none": (0, False, 0)}
    found = service.search("drive")
    assert (found["matched"], found["filtered"], found["cut"], len(found["items"])) == (1700, 1700, True, 500)
