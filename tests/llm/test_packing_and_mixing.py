import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skeinworks.llm import mixing, packing, tokens


def brute(sizes, capacity):
    left, out = [], []
    for s in sizes:
        fits = [(x, i) for i, x in enumerate(left) if x >= s]
        if fits:
            x, _ = min(fits)
            i = next(i for y, i in fits if y == x)
        else:
            left.append(capacity)
            i = len(left) - 1
        left[i] -= s
        out.append(i)
    return sorted(left)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 17), max_size=80))
def test_best_fit_decreasing_leaves_what_brute_force_leaves(sizes):
    sizes = sorted(sizes, reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    steps, opened = packing.best_fit_decreasing(counts, 17)
    left, placed = [17] * opened, {}
    for size, rank, items, first, each in steps:
        assert rank == placed.get(size, 0)
        placed[size] = rank + items
        for i in range(items):
            left[first + i // each] -= size
    assert placed == counts and all(x >= 0 for x in left) and sorted(left) == brute(sizes, 17)


def test_the_plan_is_short():
    rnd = random.Random(2)
    counts = {s: rnd.randrange(1, 10**9) for s in range(1, 4097)}
    steps, _ = packing.best_fit_decreasing(counts, 4096)
    assert len(steps) <= 3 * 4096 * 12 and sum(s[2] for s in steps) == sum(counts.values())


def packs_of(spark, data, capacities):
    items = spark.createDataFrame(data, "doc bigint, n int, pack string")
    return packing.packed(items, "doc", "n", spark.createDataFrame(capacities, "name string, cap int"), "name", "cap")


def test_packs_are_those_of_one_run_over_all(spark):
    rnd = random.Random(4)
    data = [(i, rnd.choice([7, 7, 7, rnd.randrange(1, 40)]), "") for i in range(500)]
    got = packs_of(spark, data, [("a", 40)]).groupBy("pack").agg(F.sum("size").alias("n")).collect()
    assert sorted(40 - r["n"] for r in got) == brute(sorted((n for _, n, _ in data), reverse=True), 40)


def test_every_token_is_packed_once(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice([0, 5, 90, 100, 101, 999, rnd.randrange(1, 400)]), "clash") for i in range(300)] + [(900, None, None), (None, 7, None)]
    got = packs_of(spark, data, [("a", 100), ("b", 350), ("c", None), ("d", 0)]).collect()
    for name, cap in (("a", 100), ("b", 350)):
        mine = [r for r in got if r["pack_name"] == name]
        fill = {}
        for r in mine:
            fill[r["pack"]] = fill.get(r["pack"], 0) + r["size"]
        assert max(fill.values()) <= cap and sum(fill.values()) > 0.9 * cap * len(fill)
        pieces = {}
        for r in mine:
            pieces.setdefault(r["doc"], []).append((r["start"], r["size"]))
        for doc, n, _ in data:
            if doc is not None and n:
                parts = sorted(pieces[doc])
                assert sum(s for _, s in parts) == n and (n > cap or len(parts) == 1)
                assert [a for a, _ in parts] == [k * cap for k in range(len(parts))]
            else:
                assert doc not in pieces
    assert {r["pack_name"] for r in got} == {"a", "b"}


def test_empty_packing(spark):
    assert packs_of(spark, [], [("a", 10)]).count() == 0 and packs_of(spark, [(1, 5, "")], []).count() == 0


DOCS = "doc bigint, source string, size int, weight double, text_hash string, extra string"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **how):
    t = spark.createDataFrame(targets, TARGETS)
    m = mixing.mixed(spark.createDataFrame(docs, DOCS), t, "doc", **how)
    return m, {r["source"]: r for r in mixing.shares(m, t).collect()}


def test_shares_are_reached_within_repeats(spark):
    rnd = random.Random(3)
    docs = [(i, s, rnd.randrange(1, 50), rnd.random(), f"h{i}", "x") for i, s in enumerate(["big"] * 2000 + ["small"] * 100 + ["other"] * 300)]
    docs += [(9000 + i, "small", 10, 1.0, "same", "x") for i in range(50)] + [(9999, None, 5, 1.0, "n", ""), (9998, "stranger", 5, 1.0, "s", ""), (9997, "big", 0, 1.0, "z", "")]
    m, got = mix(spark, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("other", 0.1, 3), ("absent", 0.1, 2)])
    assert abs(got["big"]["share"] - 0.5 / 0.9) < 0.01 and abs(got["small"]["share"] - 0.3 / 0.9) < 0.01 and abs(got["other"]["share"] - 0.1 / 0.9) < 0.01
    assert got["absent"]["tokens"] == 0 and got["small"]["most_uses"] == 4 and got["big"]["most_uses"] == 1
    rows = m.collect()
    assert len({r["doc"] for r in rows}) == len(rows) and sum(9000 <= r["doc"] < 9050 for r in rows) == 1
    again, _ = mix(spark, docs, [("big", 0.5, 1), ("small", 0.3, 4), ("other", 0.1, 3), ("absent", 0.1, 2)])
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_heavier_texts_are_drawn_more_often(spark):
    docs = [(i, "a", 1, 9.0 if i % 2 else 1.0, f"h{i}", "") for i in range(2000)]
    m, got = mix(spark, docs, [("a", 1.0, 1)], total=500)
    drawn = [r["doc"] for r in m.collect()]
    assert got["a"]["tokens"] == 500 and sum(d % 2 for d in drawn) > 400


def test_plan_and_empty(spark):
    assert mixing.plan({"a": 100, "b": 10}, [("a", 0.5, 1), ("b", 0.5, 3)]) == {"a": (0, 30.0), "b": (3, 0.0)}
    assert mixing.plan({}, [("a", 1.0, 1)]) == {} and mixing.plan({"a": 5}, [("a", 1.0, 2)], total=99) == {"a": (2, 0.0)}
    m, got = mix(spark, [], [("a", 1.0, 1)])
    assert m.count() == 0 and got["a"]["share"] == 0.0


def test_tokens(spark, rows):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    texts = ["", None, "Hello  world's\n12TB <|endoftext|> é ", "x" * 3000, "  \n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    want = [len(other.encode(t, add_special_tokens=False).ids) if t else 0 for t in texts]
    assert [n for _, n in sorted(rows(df.select("i", tokens.n_tokens(F.col("t")))))] == want


def test_tokens_of_long_blank_runs():
    assert tokens.count(" " * 300_000 + "a b") == tokens.count(" " * 1_000 + "a b") + 299_000
    assert tokens.count("x" * 100_000) > 0


def test_repeated_targets_and_capacities_count_once(spark):
    m, got = mix(spark, [(1, "a", 5, 1.0, "h", "")], [("a", 1.0, 2), ("a", 1.0, 2), (None, 0.5, 1)])
    t = spark.createDataFrame([("a", 1.0, 2), ("a", 1.0, 2)], TARGETS)
    assert mixing.shares(m, t).count() == 1 and got["a"]["tokens"] == 10
    kinds = spark.createDataFrame([("p", 10), ("p", 10)], "name string, cap int")
    packs = packing.packed(spark.createDataFrame([(1, 4), (2, 6), (3, 6)], "doc bigint, n int"), "doc", "n", kinds, "name", "cap")
    assert [tuple(r) for r in packing.fill(packs, kinds, "name", "cap").collect()] == [("p", 10, 2, 16, 0.8)]
