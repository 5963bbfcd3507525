"""Misspelt names against a plain sequence comparison of every word group with every name."""

import difflib
import random

from pyspark.sql import functions as F

from isohaline.operators import names as module
from isohaline.operators.names import SHORTEST, common_blocks, exact_names, fuzzy_names, like_names, met_groups, pieces
from isohaline.plans import questions
from isohaline.vocabulary import REGION_NAME_ORDER

KINDS = {"place": questions._names_once(questions._PLACES), "region": questions._names_once(REGION_NAME_ORDER)}
NAMES = sorted({n for names in KINDS.values() for n in names})


def mangled(rng, name):
    out = list(name)
    for _ in range(rng.randint(0, 4)):
        i = rng.randrange(len(out) + 1)
        what = rng.randrange(4)
        if what == 0 and i < len(out):
            del out[i]
        elif what == 1:
            out.insert(i, rng.choice("aehimnorst "))
        elif what == 2 and i < len(out):
            out[i] = rng.choice("aeiounrst")
        elif i + 1 < len(out):
            out[i], out[i + 1] = out[i + 1], out[i]
    return " ".join("".join(out).split())


def closest(gram, names):
    hit = difflib.get_close_matches(gram, list(names), n=1, cutoff=0.85) if len(gram) >= SHORTEST else []
    return names[hit[0]] if hit else None


def test_common_blocks(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 9)))) for _ in range(300)]
    pairs += [(n, mangled(rng, n)) for n in NAMES]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", common_blocks(F.col("a"), F.col("b")).alias("m")).collect()
    for r in rows:
        assert r.m == sum(b.size for b in difflib.SequenceMatcher(None, r.a, r.b).get_matching_blocks()), r


def test_a_piece_of_every_like_name_is_in_place():
    rng = random.Random(2)
    like = 0
    for _ in range(20_000):
        name = rng.choice(NAMES)
        gram = mangled(rng, name)
        if len(gram) >= SHORTEST and difflib.SequenceMatcher(None, name, gram).ratio() >= 0.85:
            like += 1
            assert any(length == len(gram) and gram[at : at + len(p)] == p for length, at, p in pieces(name)), (name, gram)
    assert like > 8000


def test_most_similar_names(spark):
    rng = random.Random(3)
    grams = {mangled(rng, rng.choice(NAMES)) for _ in range(1500)} | {"goa", "", "bay", "x" * 300} | set(NAMES)
    got = {(r.gram, r.kind): r.target for r in like_names(spark.createDataFrame([(g,) for g in grams], "gram string"), KINDS).collect()}
    want = {(g, k): closest(g, names) for g in grams for k, names in KINDS.items()}
    assert got == {k: v for k, v in want.items() if v}


def test_first_group_of_a_text_counts(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice([mangled(rng, rng.choice(NAMES)), "salinity", "near", "the", "profile", "of"]) for _ in range(rng.randint(0, 6))) for _ in range(200)] + ["", None, "mumbbai mumbbai"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, bare string")
    got = {r.id: (r.place, r.region) for r in fuzzy_names(df, "id", "bare", KINDS).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = (t or "").split(" ")
        grams = [" ".join(words[k : k + n]) for n in (3, 2, 1) for k in range(len(words) - n + 1)]
        found = tuple(next((c for g in grams if (c := closest(g, names))), None) for names in KINDS.values())
        if any(found):
            want[i] = found
    assert got == want and len(want) > 40


def test_no_texts(spark):
    assert fuzzy_names(spark.createDataFrame([], "id long, bare string"), "id", "bare", KINDS).count() == 0


def test_groups_met_in_one_pass(monkeypatch):
    """Every group like a name or equal to a short one, in texts cut anywhere; of other words none."""
    monkeypatch.setattr(module, "CHUNK", 40)
    rng = random.Random(5)
    other = ["salinity", "near", "the", "of", "ü", "", "\U0001f30a" * 3, "y" * 45]
    texts = [" ".join(rng.choice([mangled(rng, rng.choice(NAMES)), "goa", *other]) for _ in range(rng.randint(0, 40))) for _ in range(120)] + ["", " ", "goa"]
    lookup = module._Lookup(NAMES, ["goa"])
    got = {(*g,) for chunk in module._chunks(texts) for g in lookup.groups(chunk)}
    groups = set()
    for row, text in enumerate(texts):
        words = text.split(" ")
        groups |= {(row, ((3 - n) << 40) + k, " ".join(words[k : k + n])) for n in (3, 2, 1) for k in range(len(words) - n + 1)}
    assert got <= groups
    near = {gram: any(difflib.SequenceMatcher(None, name, gram).ratio() >= 0.85 for name in NAMES) for gram in {g[2] for g in groups}}
    want = {g for g in groups if g[2] == "goa" or (len(g[2]) >= SHORTEST and near[g[2]])}
    assert want <= got and len(want) > 400
    assert len(got - want) < 0.02 * len(groups)


def test_only_close_groups_leave_a_text(spark):
    text = "the salinity of the water column was measured near the shelf during every cruise of the year " * 200 + "off mahrasthra and goa"
    df = spark.createDataFrame([(7, text), (8, None), (9, "")], "id long, bare string")
    got = met_groups(df, "id", "bare", NAMES, ["goa"])
    assert {(r.id, r.gram) for r in got.collect()} == {(7, "mahrasthra"), (7, "goa")}  # of 9,000 groups
    first = exact_names(got, "id", {"place": {"goa": "Goa"}, "region": {"nowhere": "x"}}).collect()
    assert [(r.id, r.place, r.region) for r in first] == [(7, "Goa", None)]
