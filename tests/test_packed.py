import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinworks.operators import packed

VALUES = ["brand:Acme", "brand:Bolt", "capacity:4TB", "condition:used - good", "24/7", "3,5 in", 'size 3.5"', "note:a; b, c", "New", "kind:x|y", "O'Neil"]


def written_with(values, mark, rnd):
    out = []
    for v in values:
        inside = mark.strip() in v and not (mark.strip() == "," and v == "3,5 in")
        if inside or rnd.random() < 0.1:
            v = '"' + v.replace('"', '""') + '"'
        out.append(v)
    return mark.join(out)


def corpus(n=400):
    rnd = random.Random(3)
    for k in range(n):
        values = rnd.sample(VALUES, rnd.randrange(2, 6))
        yield k, written_with(values, rnd.choice([", ", ",", ";", " | ", "\n", " > "]), rnd), values


def test_round_trip_of_mixed_dialects(spark, rows):
    data = list(corpus())
    df = spark.createDataFrame([(k, t, None, "clash") for k, t, _ in data], "row bigint, tags string, kind string, field string")
    got = {}
    for key, field, pos, val in rows(packed.values(df, "row", ["tags", "kind"])):
        assert field == "tags"
        got.setdefault(key, []).append((pos, val))
    right = sum([v for _, v in sorted(got[k])] == values for k, _, values in data)
    assert right >= 0.98 * len(data)
    assert all([p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_nulls_blanks_lists_and_long_texts(spark, rows):
    long = ", ".join(["a b"] * 5000)
    data = [(1, None), (2, ""), (3, "  \n"), (4, '["a", "", "b, c", null, 3]'), (5, "['x', 'O\\'Neil']"), (6, "[broken, list"), (7, long), (7, "a b"), (8, ",, ;")]
    df = spark.createDataFrame(data, "row bigint, tags string")
    got = {}
    for key, _, pos, val in rows(packed.values(df, "row", ["tags"])):
        got.setdefault(key, []).append(val)
    assert got[4] == ["a", "b, c", "3"] and got[5] == ["x", "O'Neil"]
    assert 1 not in got and 2 not in got and 3 not in got and len(got[7]) == 5001
    assert packed.values(df.limit(0), "row", ["tags"]).count() == 0


def test_two_uses_make_an_entry_in_tables_of_any_size(spark, rows):
    """A value of two texts among 20,000 others keeps its code: it is not cut at the comma."""
    others = [(k, f"kind {k % 97};size {k};make {k % 89}") for k in range(20_000)]
    rare = [(-k, f"Alfa, Beta Gamma;size {20_000 + k};tone {k}") for k in (1, 2)]
    commas = [(-10 - k, f"left {k}, right {k % 7}") for k in range(3_000)]
    df = spark.createDataFrame(others + rare + commas, "row bigint, tags string")
    got = rows(packed.values(df, "row", ["tags"]).where("row in (-1, -2) and pos = 1").select("val"))
    assert got == [("Alfa, Beta Gamma",)] * 2


def test_any_number_of_marks_is_tried_in_all_sets():
    text = "a, b; c | d\te > f » g • h::i"
    marks = packed._marks(text)
    tried = list(packed.dialects(marks, text))
    assert len(tried) == len(set(tried)) == 2 ** len({m for *_, m in marks}) == 256
    counts = {v: 500 for v in ("a, b", "c", "d\te > f » g", "h::i")}
    assert packed.Codebook(counts, 5000, {}, {}).parse(text.replace("•", ";").replace("|", ";")) == ("a, b", "c", "d\te > f » g", "h::i")


def parse(text, chosen, quote='"'):
    return packed.split(text, packed._marks(text), frozenset(chosen), quote)[0]


def test_rules_of_one_parse():
    assert parse('a, "b, c" ,d', ",") == ["a", "b, c", "d"]
    assert parse('"size 3.5""",x', ",") == ['size 3.5"', "x"]
    assert parse("price 1,299.00, y", ",") == ["price 1,299.00", "y"]
    assert parse("only\\, parts,z", ",") == ["only, parts", "z"]
    assert parse('3.5", "q"', ",") == ['3.5"', "q"]
    assert parse("24/7 / x-y / -z", ["/"]) == ["24/7", "x-y", "-z"]
    assert parse("a -> b->c", ["->"]) == ["a", "b", "c"]
    assert parse('"open, b', ",") == ['"open', "b"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab,;| \"'\\\n[]1", max_size=40))
def test_any_text_parses(text):
    book = packed.Codebook({}, 1, {}, {})
    values = book.parse(text)
    assert all(v and v == v.strip() for v in values)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab,;|> -\t\n1'\"", max_size=30))
def test_parses_are_those_of_split(text):
    numbers, marks = {}, packed._marks(text)
    if packed.list_literal(text) is None:
        got = {(tuple(sorted(m for m, _ in working if m not in "'\"")), tuple(list(numbers)[i] for i in values), tuple(sorted(inner))) for values, _, inner, working, _, _ in packed.parses(text, numbers)}
        want = set()
        for chosen, quote in packed.dialects(marks, text):
            values, _, _, inner = packed.split(text, marks, chosen, quote)
            want.add((tuple(sorted(chosen)), tuple(values), tuple(sorted({m: inner.count(m) for m in inner}.items()))))
        assert got == want


def test_many_quotes_take_no_long_time():
    import time

    book, began = packed.Codebook({}, 1, {}, {}), time.monotonic()
    for text in ('"a,' * 20_000, "'a; " * 20_000, '"a",' * 20_000, 'a, b; "c' * 5_000):
        book.parse(text)
    assert time.monotonic() - began < 30
