"""Quality rules for repeated text: counting rules, and repeats found with a suffix array of every whole text.

The suffix array of a text is built by prefix doubling over code points in numpy. Common prefixes of neighbours in it
give, for every position, the longest substring that starts there and occurs elsewhere too; the union of these spans is
the union of all occurrences of all maximal repeated substrings. Spans under ``MIN_REPEAT`` code points are ignored, so
suffixes that are already unique at that length leave the array early.

A text is one row and is handled in memory: a doubling level takes 8 bytes per code point.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from isohaline.llm.common import travels

MIN_REPEAT = 50  # code points of the shortest repeat that counts
MAX_COVERED = 0.4  # covered share of the text above which it is rejected
MAX_LONGEST = 0.3  # longest repeat, as a share of the text, above which it is rejected
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
_SYMBOLS = b"#*$%&|<>"


def repeated_lengths(codes: np.ndarray, least: int = MIN_REPEAT) -> np.ndarray:
    """For each position the length of the longest substring starting there that occurs elsewhere; 0 if under ``least``.

    Overlapping occurrences count.
    """
    n = len(codes)
    out = np.zeros(n, dtype=np.int64)
    if n <= least or not _may_repeat(codes, least):
        return out
    bits = int(codes.max() + 1).bit_length()
    step = max(1, min(63 // bits, least))
    key = codes.astype(np.int64) + 1
    width = 1
    while width * 2 <= step:
        key = (key << (bits * width)) | _ahead(key, width)
        width *= 2
    step = width  # 8 code points for ASCII, fewer for wide alphabets
    levels = []
    live = np.arange(n)
    rank = np.zeros(n, dtype=np.int64)
    second = key
    base = np.zeros(n, dtype=np.int64)  # where the group of a live position begins
    while len(live):
        if levels:  # within equal ranks, order by the rank `width` further on
            by = second[live]
            order = np.lexsort((by, base[live]))
        else:
            by = second
            order = np.argsort(by)
        at, by = live[order], by[order]
        group = base[at]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (by[1:] != by[:-1]) | (group[1:] != group[:-1])
        first_of_group = np.ones(len(at), dtype=bool)
        first_of_group[1:] = group[1:] != group[:-1]
        index = np.arange(len(at))
        offset = index - np.maximum.accumulate(np.where(first_of_group, index, 0))
        start = np.maximum.accumulate(np.where(new, index, 0))
        fresh = group + offset[start] if levels else start
        rank = rank.copy()
        rank[at] = fresh
        levels.append((width, rank))
        same = np.zeros(len(at), dtype=bool)
        same[1:] = ~new[1:]
        same[:-1] |= ~new[1:]
        at = at[same]
        live = at
        base = rank
        if not len(live):
            break
        second = np.full(n, -1, dtype=np.int64)
        if width < n:
            second[: n - width] = rank[width:]
        width *= 2
    # Order of the suffixes that share at least the last length under `least` with another one.
    top = max((i for i, (w, _) in enumerate(levels) if w <= least), default=0)
    ranks = levels[top][1]
    sizes = np.bincount(ranks, minlength=n)
    kept = np.flatnonzero(sizes[ranks] > 1)
    if not len(kept):
        return out
    kept = kept[np.argsort(levels[-1][1][kept], kind="stable")]
    lcp = _common(codes, levels, kept[:-1], kept[1:])
    best = np.zeros(len(kept), dtype=np.int64)
    best[1:] = lcp
    best[:-1] = np.maximum(best[:-1], lcp)
    out[kept] = np.where(best >= least, best, 0)
    return out


def _may_repeat(codes: np.ndarray, least: int) -> bool:
    """False proves that no window of ``least`` code points occurs twice: equal windows have equal hashes."""
    n = len(codes) - least + 1
    power, width, whole, done = np.uint64(0x9E3779B97F4A7C15), 1, None, 0
    part = codes.astype(np.uint64) + np.uint64(1)
    left = least
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                piece = part[done : done + n]
                whole = piece.copy() if whole is None else whole * power + piece
                done += width
            left >>= 1
            if left:
                part = part[:-width] * power + part[width:]
                width, power = width * 2, power * power
    whole.sort()
    return bool((whole[1:] == whole[:-1]).any())


def _ahead(a: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(a)
    out[:-by] = a[by:]
    return out


def _common(codes, levels, i, j) -> np.ndarray:
    """Common prefix lengths of the suffixes at i and j, from equal ranks at falling lengths."""
    n = len(codes)
    got = np.zeros(len(i), dtype=np.int64)
    for width, rank in reversed(levels):
        a, b = i + got, j + got
        fits = (a + width <= n) & (b + width <= n)
        got += np.where(fits & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]), width, 0)
    going = np.ones(len(i), dtype=bool)
    for _ in range(levels[0][0]):
        a, b = i + got, j + got
        going &= (a < n) & (b < n)
        going &= codes[np.minimum(a, n - 1)] == codes[np.minimum(b, n - 1)]
        got += going
    return got


def spans_of(lengths: np.ndarray) -> list[tuple[int, int]]:
    """Union of [i, i + lengths[i]) as sorted disjoint spans."""
    at = np.flatnonzero(lengths)
    if not len(at):
        return []
    ends = np.maximum.accumulate(at + lengths[at])
    cut = np.flatnonzero(at[1:] > ends[:-1])
    starts = at[np.concatenate(([0], cut + 1))]
    return list(zip(starts.tolist(), ends[np.concatenate((cut, [len(at) - 1]))].tolist()))


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; all 0 for null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    blank = sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
    chars = len(text or "") - blank
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = Counter(windows)
        reach = 0
        for i, w in enumerate(windows):
            if often[w] > 1:
                repeated += i + WINDOW - max(i, reach)
                reach = i + WINDOW
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def judge(text: str | None) -> dict:
    n_words, chars, symbols, dup_lines, repeated = counts(text)
    failed = n_words < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n_words
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = repeated_lengths(codes)
    spans = spans_of(lengths)
    covered, longest = sum(b - a for a, b in spans), int(lengths.max()) if len(lengths) else 0
    bad = covered > MAX_COVERED * len(codes) or longest > MAX_LONGEST * len(codes)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "base_failed": failed, "kept": not failed and not bad, "covered_chars": covered, "longest_repeat": longest, "spans": spans,
    }


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_chars long, longest_repeat long, spans array<array<long>>"


def rate_repetition(docs: DataFrame) -> DataFrame:
    """doc_id and the columns of ``judge`` for every row; ``spans`` are the repeated parts as [start, end) code points.

    Null and empty texts have no words and fail the base rule. Repeated rows and null ids give a row each; an empty
    table gives none.
    """

    def run(batches):
        for b in batches:
            out = pd.DataFrame([judge(t) for t in b["text"]])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, {COLUMNS}")


travels(__name__)
