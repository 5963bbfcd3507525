import random

import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from isohaline.llm.pieces import MODEL, decode, encode, folded, lattice, load, merge_word

WORDS = ["the", "naïve", "Straße", "日本語", "\U0001f600\U0001f680", "re-entry", "1234567", "don't", "ÉTÉ", "x" * 40, "&&&", "e.g.", "http://a.b/c?d=1", "<s>", "<0x41>", "\t", "á"]


@pytest.fixture(scope="module")
def model():
    return SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def vocab():
    return load()


def texts(n=120):
    rng = random.Random(12)
    out = ["".join(rng.choice(WORDS + [chr(rng.randrange(33, 500))]) + rng.choice([" ", " ", "  ", "\n", "", "   "]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    return out + ["", " ", "   ", "\n", " a", "a ", "\n\n x", "a" * 3000, "ab " * 40_000, "▁x"]


def test_word_merges_equal_the_tokenizer(model, vocab):
    rng = random.Random(2)
    for _ in range(400):
        w = "".join(rng.choice("etaoinshréß1.,-Q") for _ in range(rng.randint(1, 60)))
        assert merge_word("▁" + w, vocab) == model.encode(w)


def test_lattice_fold_equals_the_tokenizer(spark, model, vocab):
    rng = random.Random(3)
    words = {"▁" + w for w in WORDS if len(w) < 45} | {"▁" + "".join(rng.choice("etaoinshrlqé中.") for _ in range(rng.randint(1, 30))) for _ in range(300)}
    df = spark.createDataFrame([(w,) for w in words], "word string")
    got = {r.word: r.ids for r in folded(lattice(df, vocab), vocab).collect()}
    assert got == {w: model.encode(w[1:]) for w in words}


@pytest.mark.parametrize("limit", [0, 20, 100_000])
def test_encoding_equals_the_tokenizer_and_decodes(spark, model, limit):
    given = texts()
    rows = [*enumerate(given), (None, "the end"), (3, given[3]), (9999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "pieces": F.lit("p"), "edges": F.lit(0)})
    out = encode(docs, limit=limit)
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(given):
        assert by[i].pieces == model.encode(t), repr(t[:80])
        assert by[i].n_pieces == len(by[i].pieces) and by[i].round_trip == ("▁" not in t)
    assert by[9999].pieces == [] and by[None].pieces == model.encode("the end")
    back = {r.doc_id: r.text for r in decode(out).collect()}
    assert all(back[i] == t for i, t in enumerate(given) if "▁" not in t)


def test_empty_table(spark):
    assert encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
