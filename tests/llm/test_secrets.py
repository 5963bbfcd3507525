import math
import random
import re

import pytest
from pyspark.sql import functions as F

from isohaline.llm.secrets import ENCODINGS, joined, randomness, scan, upper_chi2

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def p_brute(token):
    """The battery, written from its definition."""
    core = token.rstrip("=")
    if not re.search("[0-9]", core):
        return None
    for _, pattern, alphabet, parts in ENCODINGS:
        if re.match(pattern, core):
            break
    else:
        return None
    v, k, n = [alphabet.index(c) for c in core], len(alphabet), len(core)
    normal = lambda z: max(math.erfc(abs(z) / 2**0.5), 1e-30)
    x, lo = 0.0, 0
    for p in parts:
        x += (sum(lo <= y < lo + p for y in v) - n * p / k) ** 2 * k / (n * p)
        lo += p
    df = len(parts) - 1
    tail = {2: math.exp(-x / 2), 3: math.erfc((x / 2) ** 0.5) + (2 * x / math.pi) ** 0.5 * math.exp(-x / 2), 4: math.exp(-x / 2) * (1 + x / 2)}[df]
    high = [2 * y >= k for y in v]
    one = sum(high)
    mu, r = 2 * one * (n - one) / n + 1, 1 + sum(a != b for a, b in zip(high, high[1:]))
    runs = 1e-30 if mu <= 2 else normal((r - mu) / math.sqrt((mu - 1) * (mu - 2) / (n - 1)))
    m = sum(v) / n
    var = sum((y - m) ** 2 for y in v)
    serial = 1e-30 if var == 0 else normal((sum((a - m) * (b - m) for a, b in zip(v, v[1:])) / var + 1 / n) * n**0.5)
    h = min(-(math.log(max(tail, 1e-30)) + math.log(runs) + math.log(serial)), 700)
    return max(math.exp(-h) * (1 + h + h * h / 2), 1e-30)


def tokens(n, seed=1):
    rng = random.Random(seed)
    sets = ["0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyz0123456789"]
    sets += [sets[3] + sets[4][:26], sets[3] + sets[4][:26] + "+/", sets[3] + sets[4][:26] + "-_"]
    return ["".join(rng.choice(sets[i % 8]) for _ in range(rng.randint(20, 90))) for i in range(n)]


def test_p_values_against_the_definition(spark):
    given = tokens(64) + ["a" * 30 + "1", "A1" * 20, "onlylettersonlyletters", "12345678901234567890", "Ab1" * 9 + "=="]
    got = spark.createDataFrame([(t,) for t in given], "t string").select("t", randomness(F.col("t")).alias("p")).collect()
    for r in got:
        want = p_brute(r.t)
        assert (r.p is None) == (want is None) and (want is None or r.p == pytest.approx(want, rel=1e-3, abs=1e-6)), (r.t, r.p, want)


@pytest.mark.parametrize("df", [2, 3, 4])
def test_chi_squared_tail_falls_from_one(spark, df):
    got = [r[0] for r in spark.range(0, 40).select(upper_chi2(F.col("id").cast("double"), F.lit(df))).collect()]
    assert got[0] == pytest.approx(1, abs=1e-6) and all(a >= b for a, b in zip(got, got[1:]))


def test_base_spans_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["password=", "Token: ", "api_key", "APIKEY=\"", "secret", "'", " = ", ":", "abcdef0", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "é", "\U0001f600", " ", "\n", "0123456789abcdef01234567"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(300)]
    texts += [None, "", "secret: token: abcdefgh", "token=ab", "AKIAAKIA" + "A" * 20, "x" * 100_000 + " password=hunter22"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"base": F.lit(1), "found": F.lit("x"), "_tokens": F.lit(2)})
    for r in scan(docs).collect():
        want = brute(texts[r.doc_id])
        assert [tuple(x) for x in r.base] == want, texts[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert set(map(tuple, r.base)) <= set(map(tuple, r.found))


def test_random_tokens_are_added_and_ordinary_ones_are_not(spark):
    secret = next(t for t in tokens(64) if len(t) == 40 or p_brute(t) > 0.5)
    plain = ["An ordinary sentence with Donaudampfschifffahrtsgesellschaft in it.", "k" * 40 + "1", "Aa1" * 12, "AAAAAAAAAAbbbbbbbbbb0000000000", "x" * 25 + "Y2"]
    docs = spark.createDataFrame([(i, f"see {t} here") for i, t in enumerate([secret, *plain, secret])] + [(None, None)], "doc_id long, text string")
    got = {r.doc_id: r.s for r in scan(docs).select("doc_id", joined(F.col("found")).alias("s")).collect()}
    assert got[0] == got[6] == f"random:4:{4 + len(secret)}"
    assert all(got[i] == "" for i in range(1, 6)) and got[None] == ""


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
