import random

import pytest

from skeinworks.llm import listings

COLUMNS = "id string, title string, hint_mpn string, hint_model string, hint_brand string, aspects_json string, last_seen_ns bigint, body string"


#: Makers that no code knows: prefix and letters between, how the size is written, where the interface stands.
MAKERS = {"Acme": "AX{t}{c}{i}7", "Bolt": "{b}KLM{c}{i}", "Crux": "ZQ-{c}.{i}{t}", "Dune": "{c}-{g}{i}"}


def built(maker, code, size, i):
    letter = {"SAS": "S", "SATA": "T"}[i]
    return MAKERS[maker].format(c=code, i=letter, t=f"{size // 100:03d}", b=size // 1000, g=size)


def catalogue(seed=9):
    """(models, a catalogue of their listings from which structures can be learnt)."""
    rnd = random.Random(seed)
    models = [(m, "".join(rnd.choices("BDFGHJKM", k=2)) + str(rnd.randrange(1000, 9999)), size, i) for m in MAKERS for size in (2000, 4000, 18000) for i in ("SAS", "SATA") for _ in range(4)]
    out = []
    for m, code, size, i in models:
        part = built(m, code, size, i)
        out += [(f"{m} {code} {size // 1000}TB {i} {part} drive", part, None), (f"{code} {m} {size}GB {i} new", part + "_SR", code)]
    return models, out


def grammar_of(listed):
    counts = {}
    for title, mpn, model in listed:
        for e in listings.evidence(title, mpn, model):
            counts[e] = counts.get(e, 0) + 1
    return listings.Grammar.learnt(counts)


def test_structures_are_learnt_from_the_listings():
    models, listed = catalogue()
    g = grammar_of(listed)
    assert {t for t, *_ in g.structures} >= {"AX{t}{c}", "{b}KLM{c}", "ZQ{c}S{t}", "ZQ{c}T{t}", "{c}{g}"}
    for m, code, size, i in models:
        part = built(m, code, size, i)
        for text in (part, part.lower() + "_ug", part + "#AB", part.replace("1", "I", 1), part[:4] + "-" + part[4:]):
            assert g.part(text, size) == (code, size, i), text
    assert g.part("N/A") is None and g.part("") is None and g.part("x" * 5000) is None


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Acme BD 2954 4000GB SAS 12Gb/s Recertified 3,5 Zoll 7200 rpm", ([], ["BD2954"], 4000, "SAS")), ("TVX | Vaultrow BD2o5I | 18tb | SATA", (["BD2051"], [], 18000, "SATA")), ("HCY - FJ8344 - 2T - SATA3 - 512MB Cache", (["FJ8344"], [], 2000, "SATA")),
        ("", ([], [], None, None)), (None, ([], [], None, None)),
    ],
)
def test_titles(title, want):
    a = listings.attributes(grammar_of(catalogue()[1]), title, None, None, None, None)
    assert (a.words, a.joined, a.capacity, a.interface) == want


@pytest.mark.parametrize("model", ["ST16000NM001G", "WUH721818ALE6L4", "MG08ACA16TE", "WD80EFZZ", "HUH721212ALE600"])
def test_model_numbers_of_no_learnt_structure_are_codes(model):
    g = grammar_of(catalogue()[1])
    for title, mpn in ((f"Seagate Exos {model} 18TB SATA 7200RPM 256MB Cache", None), ("Enterprise drive 18 TB", model.lower())):
        assert listings.attributes(g, title, mpn, None, None, None).words == [model]


def test_accessories_and_pieces():
    assert listings.attributes(grammar_of(catalogue()[1]), "Caddy tray for Acme Vaultrow BD5984 18.0TB", None, None, None, None) is None


def made(n, seed=5):
    rnd = random.Random(seed)
    models = [(f"{a}{b}{rnd.randrange(1000, 9999)}", size, i) for a, b in ("XA", "QB", "RK", "TL") for size in (4, 8) for i in ("SAS", "SATA")]
    out = []
    for k in range(n):
        code, size, i = m = rnd.choice(models)
        parts = [rnd.choice(["Acme", "ACME Corp", "acme"]), rnd.choice([code, code[:2] + " " + code[2:], code.lower(), code.replace("0", "O").replace("1", "I")]), rnd.choice([f"{size}TB", f"{size}000GB", f"{size}.0 TB"]), i, rnd.choice(["used", "L@@K", "new", ""])]
        rnd.shuffle(parts)
        out.append((f"o{k:03}", " | ".join(p for p in parts if p), rnd.choice([None, "N/A", ""]), None, rnd.choice(["Acme", "ACME", None, "House Label"]), "{}", k, "clash", m))
    return out


def test_groups_of_known_models(spark, rows):
    data = made(300)
    df = spark.createDataFrame([d[:-1] for d in data] + [data[0][:-1], ("acc", "Mounting screws kit fits Acme XA1234 4TB SAS", None, None, None, None, 1, ""), ("nul", None, None, None, None, None, None, None), (None, "x", None, None, None, None, 1, None)], COLUMNS)
    got = set(rows(listings.same_model(listings.grouped(df))))
    want = {(a[0], b[0]) for a in data for b in data if a[0] < b[0] and a[-1] == b[-1]}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(got)


def test_empty(spark):
    assert listings.same_model(listings.grouped(spark.createDataFrame([], COLUMNS))).count() == 0


def test_em_tells_matches_from_chance():
    patterns = {(2, 2, 2, 2): 430.0, (2, 2, 0, 2): 500.0, (2, 2, 0, 0): 420.0, (2, 2, 2, 0): 40.0, (None, 2, 2, 2): 30.0, (0, 2, 0, 0): 5.0, (0, 0, 2, 2): 300.0, (2, 0, 2, 2): 20.0, (2, 1, 2, 2): 3.0, (2, 2, 2, None): 2.0}
    chance = listings.fit(patterns, {"code": 0.0005, "capacity": 0.08, "interface": 0.46})
    assert chance[2, 2, 2, 2] > 0.85 and chance[None, 2, 2, 2] > 0.8
    assert max(chance[p] for p in ((2, 2, 0, 2), (2, 2, 0, 0), (2, 2, 2, 0), (0, 0, 2, 2), (2, 0, 2, 2))) < 0.5
    assert listings.fit({}, {"code": 0.1, "capacity": 0.1, "interface": 0.1}) == {}


def test_an_open_field_joins_no_two_models(spark, rows):
    data = []
    for k in range(12):
        data += [(f"s{k}", "Acme XA1234 4TB SAS", k), (f"t{k}", "Acme XA1234 4TB SATA", k), (f"u{k}", "Acme QB9876 4TB SAS", k), (f"w{k}", f"Acme RK55{k:02} 8TB SATA", k)]
    data += [("open", "Acme XA1234 4TB", 1), ("one", "Acme QB9876 4TB", 1)]
    df = spark.createDataFrame([(i, t, None, None, "Acme", None, n, None) for i, t, n in data], COLUMNS)
    got = dict(rows(listings.grouped(df).select("id", "model")))
    assert got["s0"] == got["s1"] != got["t0"] == got["t1"] and got["open"] not in (got["s0"], got["t0"]) and got["one"] == got["u3"]


def test_open_classes_do_not_keep_each_other_from_the_full_one(spark, rows):
    found = [("full", "X", 16, "SATA"), ("size", "X", 16, None), ("plug", "X", None, "SATA"), ("p", "Y", 8, None), ("q", "Y", None, "SAS"), ("r", "Z", 8, None), ("s", "Z", 4, None), ("t", "Z", None, "SAS")]
    columns = "class string, code string, capacity int, interface string"
    classes = spark.createDataFrame(found, columns).selectExpr("*", "'Acme' as maker")
    level = lambda x, y: None if x is None or y is None else 2 if x == y else 0
    at = {"code": 1, "capacity": 2, "interface": 3}
    made = [(a[0], b[0], *(level(a[at[f]], b[at[f]]) if f in at else 2 for f in listings.FIELDS)) for a in found for b in found if a[0] < b[0] and a[1] == b[1]]
    pairs = spark.createDataFrame(made, "a string, b string, " + ", ".join(f"{f} int" for f in listings.FIELDS))
    linking = [p for p in {m[2:] for m in made} if 0 not in p]
    links, _ = listings.linked(pairs, linking, classes)
    assert sorted(rows(links.select("a", "b"))) == [("full", "plug"), ("full", "size"), ("p", "q")]


def test_components_of_a_long_chain(spark, rows):
    edges = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}") for i in range(40)] + [("x", "y"), ("y", "x"), ("z", "z")], "a string, b string")
    got = dict(rows(listings.components(edges)))
    assert {got[f"v{i:02}"] for i in range(41)} == {"v00"} and got["y"] == "x" and got["z"] == "z"
    assert listings.components(edges.limit(0)).count() == 0
