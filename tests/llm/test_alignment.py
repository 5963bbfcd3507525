import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from isohaline.llm import alignment
from isohaline.llm.alignment import BYTE_MODEL, PIECE_MODEL, Csr, align, byte_vocabulary, overlaps, product, spans, token_links, with_counts
from isohaline.llm.queries import QUERIES

WORDS = ["the", "naïve", "Straße", "日本語", "\U0001f600\U0001f680", "re-entry", "1234567", "don't", "ÉTÉ", "x" * 40, "&&&", "<|endoftext|>", "<s>", "<0x41>", "\t", "  ", "\r\n"]


def texts(n=80):
    rng = random.Random(3)
    out = ["".join(rng.choice(WORDS + [chr(rng.randrange(33, 900))]) + rng.choice([" ", " ", "  ", "\n", "", "   "]) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return out + ["", " ", "a", "\n\n x", "▁x", "the end", "the end", "ab " * 30_000, "long" * 20_000, " " * 70_000, None]


@pytest.fixture(scope="module")
def models():
    a = Tokenizer.from_file(BYTE_MODEL)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECE_MODEL)


def brute(given, models):
    """Tokens, overlap links and group links by comparing all tokens of a text with each other where they lie."""
    a_model, b_model = models
    a_raw = byte_vocabulary(open(BYTE_MODEL, encoding="utf-8").read())[1]
    b_raw = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    cut = []
    for t in given:
        a, b = (a_model.encode(" " + t, add_special_tokens=False).ids, b_model.encode(t)) if t else ([], [])
        ra, rb = [a_raw[i] for i in a], [b_raw(i) for i in b]
        if t and not b"".join(ra) == b"".join(rb) == (" " + t).encode():
            a, b, ra, rb = [], [], [], []
        cut.append((a, b, np.cumsum([len(x) for x in ra]).tolist(), np.cumsum([len(x) for x in rb]).tolist()))
    links = [[(a[ae.index(e)], b[be.index(e)]) for e in sorted(set(ae) & set(be))] if len(ae) < 2000 else _by_end(a, b, ae, be) for a, b, ae, be in cut]
    count = Counter(p for x in links for p in x)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    rows = []
    for (a, b, ae, be), mine in zip(cut, links):
        ends, groups, i, j = sorted(set(ae) & set(be)), [], 0, 0
        for e in ends:
            p, q = i, j
            while i < len(a) and ae[i] <= e:
                i += 1
            while j < len(b) and be[j] <= e:
                j += 1
            groups.append(f"{','.join(map(str, a[p:i]))}|{','.join(map(str, b[q:j]))}")
        text = ";".join(groups)
        rows.append((len(a), len(b), len(ends), len(mine), sum(count[p] == top[p[1]] for p in mine), sum(count[p] for p in mine), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return rows, cut


def _by_end(a, b, ae, be):
    at, bt = dict(zip(ae, a)), dict(zip(be, b))
    return [(at[e], bt[e]) for e in sorted(at.keys() & bt.keys())]


def test_products_equal_dense_ones():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.integers(0, 3, (5, 7)), rng.integers(0, 3, (7, 4))
        x[rng.integers(5)] = 0
        sparse = lambda m: Csr(np.concatenate(([0], np.cumsum((m > 0).sum(1)))), np.nonzero(m)[1], m[m > 0], m.shape[1])
        for m, p in ((x @ y, product(sparse(x), sparse(y))), (y.T, sparse(y).transposed)):
            dense = np.zeros(m.shape, dtype=int)
            dense[p.rows, p.col] = p.val
            assert (dense == m).all() and len(p.val) == (m > 0).sum()
    empty = spans(np.zeros(0, dtype=int), np.zeros(0, dtype=int), 3)
    assert len(product(empty, spans(np.array([0]), np.array([2]), 2)).val) == 0


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_overlaps_in_blocks(block):
    rng = random.Random(4)
    for _ in range(40):
        cut = lambda: np.array(sorted({40, *(rng.randint(1, 40) for _ in range(rng.randint(0, 20)))}))
        a, b = cut(), cut()
        want = []
        for i, (lo, hi) in enumerate(zip([0, *a], a)):
            for j, (p, q) in enumerate(zip([0, *b], b)):
                if min(hi, q) > max(lo, p):
                    want.append((i, j, min(hi, q) - max(lo, p)))
        assert list(zip(*map(list, overlaps(a, b, block)))) == want
    assert [len(x) for x in overlaps(np.zeros(0, dtype=int), np.zeros(0, dtype=int))] == [0, 0, 0]


@pytest.mark.parametrize("small", [500_000, 5])
def test_alignment_equals_brute_force(spark, models, monkeypatch, small):
    monkeypatch.setattr(alignment, "CHUNK", 5000)
    given = texts()
    docs = spark.createDataFrame([*enumerate(given), (None, "no id")], "doc_id long, text string").withColumns({"row": F.lit(1), "pair": F.lit("p"), "count": F.lit(0)})
    want, _ = brute([*given, "no id"], models)
    out = with_counts(align(docs).withColumn("sha", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))), small)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.sha) for r in out.collect()}
    assert got == dict(zip([*range(len(given)), None], want))


def test_links_equal_brute_force(spark, models):
    given = [t for t in texts(25) if t is None or len(t) < 2000]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    _, cut = brute(given, models)
    over, group = set(), set()
    for n, (a, b, ae, be) in enumerate(cut):
        for i, (lo, hi) in enumerate(zip([0, *ae], ae)):
            for j, (p, q) in enumerate(zip([0, *be], be)):
                if min(hi, q) > max(lo, p):
                    over.add((n, i, j, a[i], b[j], min(hi, q) - max(lo, p)))
                ends = sorted(set(ae) & set(be))
                if sum(e < hi for e in ends) == sum(e < q for e in ends):
                    group.add((n, i, j, a[i], b[j], 1))
    assert {tuple(r) for r in token_links(docs).collect()} == over
    assert {tuple(r) for r in token_links(docs, grouped=True).collect()} == group


def test_empty_table_and_query(spark, models, tmp_path):
    assert with_counts(align(spark.createDataFrame([], "doc_id long, text string"))).count() == 0
    given = texts(30)
    spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op12_alignment"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [t for _, t in out.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(tuple(r)[1:] for r in out.collect()) == sorted(brute(given, models)[0])
