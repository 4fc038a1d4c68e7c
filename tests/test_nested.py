import json
from datetime import datetime

from pyspark.sql import functions as F

from skeinworks.operators import nested

VARIANT = nested.TableRule("variant", "variants", columns={"price": ("price.amount", "price"), "available": ("available",)})
PRODUCT = nested.TableRule("product", "products", columns={"title": ("title",)}, children=(VARIANT,))
T1, T2 = datetime(2025, 1, 1), datetime(2025, 1, 2)


def pages(spark, bodies):
    return spark.createDataFrame([(f"k{i}", b, t) for i, (b, t) in enumerate(bodies)], "key string, body string, at timestamp")


def tagged(spark, bodies):
    return nested.emit_json(pages(spark, bodies), PRODUCT, "key", "body", "at")


def test_layouts_give_the_same_rows(spark):
    flat = {"products": [{"id": 1, "title": "a", "variants": [{"id": "11", "price": "3"}, None, {"id": None, "price": {"amount": "4"}}]}]}
    one = {"data": {"products": [{"id": "gid://x/Product/1", "title": "a", "variants": {"id": 11, "price": "3"}}]}}
    edges = {"data": {"products": {"edges": [{"node": {"id": "1", "title": "a", "variants": {"edges": [{"node": {"id": "gid://x/Variant/11", "price": "3"}}, None]}}}]}}}
    for layout in (flat, one, edges):
        got = tagged(spark, [(json.dumps(layout), T1)]).collect()
        assert [(r.tag, r.own_id, r.root_id) for r in got][:2] == [("product", 1, 1), ("variant", 11, 1)]
        assert got[1].parent_pk == got[0].pk


def test_latest_skips_what_states_nothing(spark):
    bodies = [
        ('{"products":[{"id":1,"variants":[{"id":1},{"id":2}]},{"id":2,"variants":[{"id":5}]},{"id":3,"variants":[{"id":7}]}]}', T1),
        ('{"products":[{"id":1,"variants":null},{"id":2,"variants":[]},{"id":3,"variants":[{"id":8},{"id":8}]}]}', T2),
        ("<html>", T2), ("", T2), (None, T2), ("[" * 5000, T2), ('{"products":3}', T2),
    ]
    got = nested.latest_children(tagged(spark, bodies), "product", "variant")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (1, 2), (3, 8)]


def test_typed_records_and_tables(spark, tmp_path):
    schema = "row bigint, id bigint, title string, at timestamp, tag string, variants array<struct<id bigint, price string, available boolean>>"
    data = [(1, 9, "x", T1, "clash", [(90, "1.5", True), None, (None, "2", None)]), (2, 9, None, T2, None, None), (3, None, "y", T1, None, [(1, "1", True)]), (4, 8, "z", T1, None, [])]
    records = spark.createDataFrame(data, schema)
    rows = nested.emit_typed(records, PRODUCT, F.col("row"), F.col("at"))
    path = nested.write_tables(rows, str(tmp_path / "t"))
    products = {r.pk: r for r in nested.read_table(spark, path, "product", "title string").collect()}
    assert {k: (r.own_id, r.children.get("variant"), r.title) for k, r in products.items()} == {"1": (9, 2, "x"), "2": (9, None, None), "3": (None, 1, "y"), "4": (8, 0, "z")}
    variants = nested.read_table(spark, path, "variant", "price string, available boolean").collect()
    assert sorted((r.parent_pk, r.own_id or 0, r.price, r.available) for r in variants) == [("1", 0, "2", None), ("1", 90, "1.5", True), ("3", 1, "1", True)]
    assert sorted(map(tuple, nested.latest_children(nested.read_tagged(spark, path), "product", "variant").collect())) == [(9, 90)]


def test_structs_maps_and_several_children(spark):
    rules = (VARIANT, nested.TableRule("maker", "maker", columns={"name": ("name",)}), nested.TableRule("price", "prices", columns={"cents": ("cents",)}))
    product = nested.TableRule("product", "products", children=rules)
    schema = "row bigint, id bigint, at timestamp, variants array<struct<id bigint>>, maker struct<id bigint, name string>, prices map<string, struct<id bigint, cents int>>"
    data = [(1, 9, T1, [(1,), (2,)], (5, "Acme"), {"us": (7, 10), "de": None}), (2, 8, T1, None, None, {}), (3, 7, T2, [], None, None)]
    got = nested.emit_typed(spark.createDataFrame(data, schema), product, F.col("row"), F.col("at")).collect()
    assert {r.pk: r.children for r in got if r.tag == "product"} == {"1": {"variant": 2, "maker": 1, "price": 1}, "2": {"price": 0}, "3": {"variant": 0}}
    assert sorted((r.tag, r.parent_pk, r.own_id) for r in got if r.tag in ("maker", "price")) == [("maker", "1", 5), ("price", "1", 7)]
    page = json.dumps({"products": [{"id": 9, "variants": [{"id": 1}], "maker": {"id": 5, "name": "Acme"}, "prices": []}]})
    got = nested.emit_json(pages(spark, [(page, T1)]), product, "key", "body", "at").collect()
    assert got[0].children == {"variant": 1, "maker": 1, "price": 0} and len(got) == 3


def test_empty_table(spark):
    assert nested.latest_children(tagged(spark, []), "product", "variant").count() == 0


def test_numbers_in_ids():
    assert [nested.number_in(x) for x in (5, "7", "gid://s2/V/123?a=1", 4.0, True, None, "x", 2**70, 1.5)] == [5, 7, 123, 4, None, None, None, None, None]
