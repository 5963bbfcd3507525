"""Secret scan: fixed patterns, and a randomness test battery over other encoded-looking tokens.

Tokens of 20 or more characters whose characters fit an encoding (hex, base32, base36, base62, base64) are tested for
being random over it: chi-squared uniformity over parts of the alphabet, a runs test about the middle of the alphabet
and a serial correlation test, combined by Fisher's rule. A weighted Benjamini-Hochberg step over all tokens of the
corpus, with weights in proportion to length since longer tokens carry more evidence, calls tokens ordinary; at most the
share ``RATE`` of them is expected to be random after all. The other tokens are reported as secrets.

Everything is column expressions. P-values are counted on a logarithmic grid of fixed size, so the step needs one small
aggregate whatever the number of tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isohaline.session import written

RATE = 0.05
GRID = 100  # grid steps of a decade of p-values
FLOOR = 1e-30  # smaller p-values count as this

ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
# name, pattern of the characters, alphabet in order, sizes of its consecutive parts for the uniformity test
ENCODINGS = (
    ("hex", "^(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef", (4, 4, 4, 4)),
    ("hex_upper", "^(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF", (4, 4, 4, 4)),
    ("base32", "^(?=.*[A-Z])[A-Z2-7]+$", _UPPER + "234567", (13, 13, 6)),
    ("upper36", "^(?=.*[A-Z])[0-9A-Z]+$", _UPPER + _DIGITS, (13, 13, 10)),
    ("lower36", "^(?=.*[a-z])[0-9a-z]+$", _LOWER + _DIGITS, (13, 13, 10)),
    ("base62", "^(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS, (13, 13, 13, 13, 10)),
    ("base64", "^(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/]+$", _UPPER + _LOWER + _DIGITS + "+/", (13, 13, 13, 13, 12)),
    ("base64url", "^(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z_-]+$", _UPPER + _LOWER + _DIGITS + "-_", (13, 13, 13, 13, 12)),
)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, part>> of all leftmost matches, in code points; ``part`` is the given group.

    The pieces between matches give the positions; both functions walk the text alike.
    """
    pieces = F.struct(
        F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("parts"),
    )
    kind = "array<struct<start:int,end:int,part:string>>"
    ends = "array<struct<gap:int,hit:int,part:string>>"

    def place(p: Column) -> Column:
        sizes = F.arrays_zip(F.transform(F.slice(p["gaps"], 1, F.size(p["hits"])), F.length), F.transform(p["hits"], F.length), p["parts"]).cast(ends)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            s, e = acc["at"] + x["gap"], acc["at"] + x["gap"] + x["hit"]
            row = F.struct(s.alias("start"), e.alias("end"), x["part"].alias("part"))
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

        return F.aggregate(sizes, start, step, lambda acc: acc["out"])

    return F.when(text.rlike(pattern), let(pieces, place)).otherwise(F.array().cast(kind))


def two_sided(z: Column) -> Column:
    """Two-sided normal tail, by the rational approximation 7.1.26 of Abramowitz and Stegun (error under 2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.greatest(poly * F.exp(-x * x), F.lit(FLOOR))


def upper_chi2(x: Column, df: Column) -> Column:
    """Upper tail of chi-squared for 2, 3 or 4 degrees of freedom, in closed form."""
    root = F.sqrt(x)
    three = two_sided(root) + F.sqrt(2 * x / 3.141592653589793) * F.exp(-x / 2)
    return F.greatest(F.when(df == 2, F.exp(-x / 2)).when(df == 3, three).otherwise(F.exp(-x / 2) * (1 + x / 2)), F.lit(FLOOR))


def randomness(token: Column) -> Column:
    """Combined p-value of a token's randomness over its encoding; null where no encoding fits.

    An encoding needs a digit and a letter, so words and numbers are never tested. Padding is left out.
    """
    core = F.regexp_replace(token, "=+$", "")
    number = F.lit(None).cast("int")
    for i, (_, pattern, _, _) in reversed(list(enumerate(ENCODINGS))):
        number = F.when(core.rlike(pattern), F.lit(i)).otherwise(number)
    number = F.when(core.rlike("[0-9]"), number)
    alphabet = F.element_at(F.array(*[F.lit(a) for _, _, a, _ in ENCODINGS]), number + 1)
    parts = F.element_at(F.array(*[F.array(*map(F.lit, p)) for *_, p in ENCODINGS]), number + 1)

    def with_values(t: Column) -> Column:
        values = F.transform(F.filter(F.split(t["core"], "", -1), lambda c: c != ""), lambda c: F.instr(t["alphabet"], c) - 1)
        return let(F.struct(values.alias("v"), F.length(t["alphabet"]).alias("k"), t["parts"].alias("parts")), tests)

    def tests(s: Column) -> Column:
        n, k, v = F.size(s["v"]).cast("double"), s["k"].cast("double"), s["v"]
        edges = F.aggregate(s["parts"], F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + p)))
        cells = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), s["parts"], lambda lo, p: F.struct(lo.alias("lo"), p.alias("p")))
        x = F.aggregate(cells, F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(v, lambda y: (y >= c["lo"]) & (y < c["lo"] + c["p"]))) - n * c["p"] / k, F.lit(2.0)) * k / (n * c["p"]))
        high = F.transform(v, lambda y: (2 * y >= k).cast("int"))
        ones = F.aggregate(high, F.lit(0), lambda a, y: a + y).cast("double")
        turns = F.aggregate(F.zip_with(F.slice(high, 1, F.size(high) - 1), F.slice(high, 2, F.size(high) - 1), lambda a, b: (a != b).cast("int")), F.lit(1), lambda a, y: a + y).cast("double")
        runs = let(2 * ones * (n - ones) / n + 1, lambda mu: F.when(mu <= 2, F.lit(FLOOR)).otherwise(two_sided((turns - mu) / F.sqrt((mu - 1) * (mu - 2) / (n - 1)))))

        def serial(m: Column) -> Column:
            var = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - m) * (y - m))
            cov = F.aggregate(F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: (a - m) * (b - m)), F.lit(0.0), lambda a, y: a + y)
            return F.when(var <= 0, F.lit(FLOOR)).otherwise(two_sided((cov / var + 1 / n) * F.sqrt(n)))

        mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
        logs = F.log(upper_chi2(x, F.size(s["parts"]) - 1)) + F.log(runs) + F.log(let(mean, serial))
        half = F.least(-logs, F.lit(700.0))  # half of Fisher's statistic, chi-squared with six degrees of freedom
        return F.greatest(F.exp(-half) * (1 + half + half * half / 2), F.lit(FLOOR))

    return F.when(number.isNotNull(), let(F.struct(core.alias("core"), alphabet.alias("alphabet"), parts.alias("parts")), with_values))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base array, found array: spans as struct<start, rank, end, kind>, sorted.

    ``base`` has the spans of the fixed patterns, ``found`` also those of the battery; a random token that overlaps a
    base span is not repeated. Null text counts as empty. One row per row of ``docs``, repeated ids included.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    span = "array<struct<start:int,rank:int,end:int,kind:string>>"

    def spans(found: Column, kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"))).cast(span)

    assign = F.filter(matches(text, ASSIGN, 2), lambda x: F.length(x["part"]) >= 6)
    found = docs.select(
        "doc_id", spans(assign, "assign").alias("_assign"), spans(matches(text, ACCESS), "access").alias("_access"),
        spans(matches(text, HEX), "hex").alias("_hex"), matches(text, TOKEN).alias("_tokens"),
    )
    scored = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["end"] - x["start"]).alias("n"), randomness(x["part"]).alias("p"))
    tokens = F.filter(F.transform("_tokens", scored), lambda x: x["p"].isNotNull())
    tokens = F.when(F.size("_tokens") > 0, tokens).otherwise(F.array().cast("array<struct<start:int,end:int,n:int,p:double>>"))
    found = found.select(
        "doc_id", F.size("_assign").cast("long").alias("n_assign"), F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"), F.array_sort(F.concat("_assign", "_access", "_hex")).alias("base"), tokens.alias("_tokens"),
    )
    found = written(found, "tokens")
    each = found.select(F.explode("_tokens").alias("t")).select("t.n", "t.p")
    facts = each.agg(F.count("*"), F.avg("n")).collect()[0]
    total, mean = facts[0], float(facts[1] or 1.0)
    step = lambda n, p: F.ceil(F.log10(F.greatest(F.least(p * mean / n, F.lit(1.0)), F.lit(FLOOR))) * GRID)
    grid = each.groupBy(step(F.col("n"), F.col("p")).alias("b")).agg(F.count("*").alias("c"))
    grid = grid.withColumn("upto", F.sum("c").over(Window.orderBy("b")))
    ordinary = grid.filter(F.pow(F.lit(10.0), F.col("b") / GRID) <= RATE * F.col("upto") / max(total, 1)).agg(F.max("b")).collect()[0][0]
    limit = -(10**9) if ordinary is None else ordinary
    random = F.filter("_tokens", lambda t: (step(t["n"], t["p"]) > limit) & ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.array_sort(F.concat("base", spans(random, "random"))).alias("found"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the given order."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
