import random
import re

from pyspark.sql import functions as F

from isohaline.llm.licenses import TEMPLATES, find_licenses


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D.,;:!?()\"'/]+", (t or "").lower()) if w]


def shingled(t):
    w = words(t)
    return [tuple(w[i : i + 3]) for i in range(len(w) - 2)]


def brute(text):
    """Licenses with 80 % of their shingles in a stretch of their own length, and in the text at all."""
    s = shingled(text)
    close, anywhere = set(), set()
    for name, notice in TEMPLATES:
        t = set(shingled(notice))
        if len(t & set(s)) >= 0.8 * len(t):
            anywhere.add(name)
        if any(len(t & set(s[i : i + len(t) + 2])) >= 0.8 * len(t) for i in range(len(s))):
            close.add(name)
    return close, anywhere


def test_against_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for i in range(160):
        filler = [f"word{rng.randrange(900)}" for _ in range(rng.randint(0, 120))]
        notice = rng.choice(TEMPLATES)[1].split()
        if i % 5 == 1:
            notice[rng.randrange(len(notice))] = "changed"
        if i % 5 == 2:
            notice = [w.upper() for w in notice]
        if i % 5 == 3:
            notice = []
        at = rng.randint(0, len(filler))
        texts.append(" ".join(filler[:at] + notice + filler[at:]))
    texts += [None, "", "All", "all rights", "All rights reserved. " * 500, "pad " * 50_000 + "Released under the MIT License."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"h": F.lit(1), "w": F.lit("w"), "license": F.lit("z"), "band": F.lit(0)})
    got = {}
    for r in find_licenses(docs).collect():
        assert 0.8 <= r.containment <= 1 and r.places >= 1
        got.setdefault(r.doc_id, set()).add(r.license)
    for i, t in enumerate(texts):
        close, anywhere = brute(t)
        assert close <= got.get(i, set()) <= anywhere, (t or "")[:300]


def test_repeated_and_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "All rights reserved."), (1, "All rights reserved."), (None, "Released under the MIT License.")], "doc_id long, text string")
    got = find_licenses(docs).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "all-rights-reserved"), (None, "MIT")} and len(got) == 2
    assert find_licenses(docs.limit(0)).count() == 0
    assert find_licenses(docs, [("x", "too short")]).count() == 0


def test_every_planted_line_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License.", "all-rights-reserved": "All rights reserved.",
    }
    want = {(r.doc_id, n) for n, x in lines.items() for r in docs.filter(F.col("text").contains(x)).select("doc_id").collect()}
    assert {(r.doc_id, r.license) for r in find_licenses(docs).collect()} == want and want
