import random
import re

import numpy as np
from pyspark.sql import functions as F

from isohaline.llm.repetition import counts, judge, rate_repetition, repeated_lengths, spans_of


def brute(s, least):
    out = []
    for i in range(len(s)):
        best = 0
        for j in range(len(s)):
            n = 0
            while i != j and max(i, j) + n < len(s) and s[i + n] == s[j + n]:
                n += 1
            best = max(best, n)
        out.append(best if best >= least else 0)
    return out


def codes(s):
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32)


def test_lengths_against_brute_force():
    rng = random.Random(3)
    for t in range(150):
        s = "".join(rng.choice("ab" if t % 3 else "abcdé\U0001f600") for _ in range(rng.randint(0, 50)))
        s = s + s[:15] + s if t % 4 == 0 else s
        for least in (1, 3, 9, 20):
            assert repeated_lengths(codes(s), least).tolist() == brute(s, least)


def test_spans_are_merged():
    assert spans_of(np.array([3, 0, 2, 0, 0, 1])) == [(0, 4), (5, 6)]
    assert spans_of(np.zeros(4, dtype=int)) == []


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_counts_against_the_definition():
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b c\x85d", "a\x1cb"]
    texts += ["".join(rng.choice(["a ", "b\n", "c\t", "é", "#", "x y z w v "]) for _ in range(rng.randint(1, 80))) for _ in range(120)]
    for t in texts:
        assert counts(t) == slow_counts(t), repr(t)


def test_verdicts_and_odd_rows(spark):
    fine = " ".join(f"word{i}" for i in range(80))
    passage = " ".join(f"again{i}" for i in range(30))
    rows = [(1, fine), (2, None), (3, ""), (4, "too few words"), (5, f"{passage}\n{passage}"), (6, "ab" * 60_000), (7, fine), (7, fine), (None, fine)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "spans": F.lit(1)})
    got = {r.doc_id: r for r in rate_repetition(docs).collect()}
    assert rate_repetition(docs).count() == 9
    assert got[1].kept and got[7].kept and got[None].kept
    assert not any(got[i].kept for i in (2, 3, 4, 5, 6))
    assert got[2].base_failed and got[3].n_words == 0 and got[6].longest_repeat == 119_998
    assert got[5].n_repeat_words == 60 and got[5].covered_chars == 2 * len(passage)
    assert rate_repetition(docs.limit(0)).count() == 0


def test_long_repeats_without_spaces_are_rejected_by_the_suffix_array_alone():
    unit = "".join(random.Random(1).choice("abcdefgh") for _ in range(400))
    text = " ".join(f"w{i}" for i in range(20)) + unit + "x" + unit
    assert not judge(text)["base_failed"] and not judge(text)["kept"]
