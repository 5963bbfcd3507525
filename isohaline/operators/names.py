"""Misspelt names in a table of texts, found by equality joins.

Similarity is 2 M / T, where M counts the characters in the longest common block of two words and, recursively, to the left
and right of it, and T is the characters of both. A word group matches a name if that is at least ``LIKE``.

Groups of one to three words are looked up where they stand, and those that meet the index are taken once per table. If M is that large, at most d = T - 2 M characters stand outside the
common blocks. Cut a name into d + 1 pieces: each of those characters touches one piece at most, so a piece is left whole and
stands in the group, shifted by no more than the characters before it. The index lists, for every name, group length and
shift, the pieces with their place, and groups meet it on (length, place, piece): first in a pass over the texts, which leaves
out all groups that are close to no name, so that only the others are shuffled, then by joins that say which name. A pair that meets is screened by edit
distance, which is never above d, and only then measured.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohaline.session import BROADCAST_ROWS, broadcast_if_small, written

LIKE = 0.85
SHORTEST = 5  # characters of a word group; shorter ones collide with too many words
SIZES = (3, 2, 1)  # words of a group, in the order in which groups of a text count
CHUNK = 1_000_000  # characters of texts that are looked through at once


def spoken(name: str) -> str:
    """A name as bare words, the form in which it is looked up in texts."""
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", name.casefold())).strip()


def ngrams(words: Column, sizes=(1, 2, 3)) -> Column:
    """Distinct word groups of a word array, which has to be a column: an expression would be worked out for every group."""
    def of(size: int):
        starts = F.sequence(F.lit(1), F.size(words) - (size - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(size)), " "))
        return F.when(F.size(words) >= size, grams).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(s) for s in sizes]))


def common_blocks(a: Column, b: Column) -> Column:
    """M of two strings: characters in the longest common block, its first place in ``a`` and then ``b``, and so on beside it.

    Every step of the fold takes all pieces of one depth; it is over when none has a common block left.
    """
    def longest(p: Column) -> Column:
        n = F.char_length(p["a"])

        def starting(i: Column) -> Column:
            ends = F.sequence(F.lit(1), n - i + 1)
            found = F.transform(ends, lambda k: F.struct(k.alias("k"), (-i).alias("i"), F.position(F.substring(p["a"], i, k), p["b"]).alias("j")))
            return F.array_max(F.filter(found, lambda f: f["j"] > 0))

        return F.array_max(F.transform(F.sequence(F.lit(1), n), starting))

    def step(state: Column, _: Column) -> Column:
        hits = F.transform(state["parts"], lambda p: F.struct(p.alias("p"), longest(p).alias("h")))
        hits = F.filter(hits, lambda x: x["h"].isNotNull())

        def beside(x: Column) -> Column:
            a, b, k, i, j = x["p"]["a"], x["p"]["b"], x["h"]["k"], -x["h"]["i"], x["h"]["j"]
            left = F.struct(F.substring(a, F.lit(1), i - 1).alias("a"), F.substring(b, F.lit(1), j - 1).alias("b"))
            right = F.struct(F.substring(a, i + k, F.char_length(a)).alias("a"), F.substring(b, j + k, F.char_length(b)).alias("b"))
            return F.array(left, right)

        rest = F.filter(F.flatten(F.transform(hits, beside)), lambda p: (p["a"] != "") & (p["b"] != ""))
        total = F.aggregate(hits, state["m"], lambda m, x: m + x["h"]["k"])
        return F.struct(total.alias("m"), rest.alias("parts"))

    whole = F.filter(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: (p["a"] != "") & (p["b"] != ""))
    start = F.struct(F.lit(0).alias("m"), whole.alias("parts"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(a))), start, step)["m"]


def similarity(a: Column, b: Column) -> Column:
    return 2.0 * common_blocks(a, b) / (F.char_length(a) + F.char_length(b))


def pieces(name: str, like: float = LIKE):
    """(length, place, piece): where a piece of ``name`` may stand whole in a group of that length that matches it."""
    n = len(name)
    for length in range(SHORTEST, math.floor(n * (2 - like) / like) + 1):
        both = n + length
        apart = math.floor((1 - like) * both + 1e-9)
        apart -= (apart - both) % 2
        if apart < abs(n - length):
            continue
        more, fewer = (apart + length - n) // 2, (apart - length + n) // 2  # characters that only the group, only the name has
        cuts = [n * i // (apart + 1) for i in range(apart + 2)]
        for lo, hi in zip(cuts, cuts[1:]):
            for at in range(max(0, lo - fewer), min(length - (hi - lo), lo + more) + 1):
                yield length, at, name[lo:hi]


def name_index(spark: SparkSession, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """length, at, piece, kind, name: the index of all names, given by kind as spoken name -> target."""
    rows = sorted({(*p, kind, name) for kind, names in kinds.items() for name in names for p in pieces(name)})
    return _constant(spark, dict(zip(("length", "at", "piece", "kind", "name"), zip(*rows))))


def _constant(spark: SparkSession, columns: dict) -> DataFrame:
    """A table of fixed values, held in the plan itself."""
    return spark.createDataFrame(pa.table({c: list(v) for c, v in columns.items()}))


def like_names(groups: DataFrame, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """gram, kind, target: the most similar name of each kind for the word groups ``gram`` that are like one.

    Of equally similar names the last in order counts. The index grows with the names (a few hundred rows each), not with
    the texts.
    """
    spark = groups.sparkSession
    index = name_index(spark, kinds)
    if sum(len(names) for names in kinds.values()) * 1000 <= BROADCAST_ROWS:  # a name has under 1000 pieces
        index = F.broadcast(index)
    sizes = sorted({(length, at, len(piece)) for names in kinds.values() for name in names for length, at, piece in pieces(name)})
    probes = F.broadcast(_constant(spark, dict(zip(("length", "at", "n"), zip(*sizes)))))  # places and sizes to look at
    lengths = groups.withColumn("length", F.char_length("gram")).join(probes, "length")
    looked = lengths.select("gram", "length", "at", F.substring("gram", F.col("at") + 1, F.col("n")).alias("piece"))
    met = looked.join(index, ["length", "at", "piece"]).select("gram", "kind", "name", "length")
    apart = F.floor((1 - LIKE) * (F.col("length") + F.char_length("name")) + 1e-9).cast("int")
    met = met.where(F.levenshtein("gram", "name") <= apart).distinct()
    near = met.withColumn("like", similarity(F.col("name"), F.col("gram"))).where(F.col("like") >= LIKE)
    best = near.groupBy("gram", "kind").agg(F.max(F.struct("like", "name"))["name"].alias("name"))
    targets = _constant(spark, dict(zip(("kind", "name", "target"), zip(*[(k, n, t) for k, names in kinds.items() for n, t in names.items()]))))
    return best.join(F.broadcast(targets), ["kind", "name"]).select("gram", "kind", "target")


def _chunks(texts: list[str]) -> Iterator[list[tuple[int, int, str]]]:
    """Texts as (row, number of its first word, text), about ``CHUNK`` characters at once.

    Longer texts are cut at blanks. Parts overlap by two words, so every group stands whole in one of them, but for groups with
    a word of ``CHUNK`` characters, which are like no name.
    """
    chunk, size = [], 0
    for row, text in enumerate(texts):
        start = number = 0
        stop = 0
        while stop >= 0:
            stop = text.find(" ", start + CHUNK)
            chunk.append((row, number, text[start:stop] if stop >= 0 else text[start:]))
            size += len(chunk[-1][2]) + 1
            if size >= CHUNK:
                yield chunk
                chunk, size = [], 0
            if stop >= 0:
                last = text.rfind(" ", start, stop)
                before = text.rfind(" ", start, last) if last >= 0 else -1
                back = before if before >= 0 else last if last >= 0 else stop
                number += text.count(" ", start, back + 1)
                start = back + 1
    if chunk:
        yield chunk


class _Lookup:
    """Finds the word groups of texts that may be like a name: all groups of a length meet the index together.

    Groups that meet a piece of a name are screened by the longest common subsequence of both, which is never shorter than their
    common blocks. It is counted in the bits of one integer (Hyyro), so names above 63 characters are not screened.
    """

    def __init__(self, names: Iterable[str], exact: Iterable[str]):
        known = [(n, False) for n in sorted(set(names))] + [(n, True) for n in sorted(set(exact)) if n]
        entries = {(*p, i) for i, (n, same) in enumerate(known) for p in ([(len(n), 0, n[:6])] if same else pieces(n))}
        letters = {c: i for i, c in enumerate(sorted({c for n, _ in known for c in n}), 1)}
        self.width, steps, nodes = len(letters) + 1, {}, {"": 1}  # node 0: no piece begins like this
        for *_, piece, _ in entries:
            for i in range(len(piece)):
                up, at = nodes[piece[:i]], nodes.setdefault(piece[: i + 1], len(nodes) + 1)
                steps[up * self.width + letters[piece[i]]] = at
        self.steps = np.zeros((len(nodes) + 1) * self.width, np.int32)
        self.steps[list(steps)] = list(steps.values())
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = list(letters.values())
        self.deepest = max((len(e[2]) for e in entries), default=0)
        self.size = len(nodes) + 1
        self.wanted: dict[int, dict[tuple[int, int], list]] = {}
        for length, at, piece, i in sorted(entries):
            self.wanted.setdefault(length, {}).setdefault((at, len(piece)), []).append((nodes[piece], i))
        for places in self.wanted.values():
            for place, met in places.items():
                node, name = map(np.array, zip(*sorted(met)))
                is_met = np.zeros(self.size, bool)
                is_met[node] = True
                places[place] = is_met, node, name
        self.chars = np.array([len(n) for n, _ in known], np.int64)
        self.same = np.array([same for _, same in known], bool)
        self.bits = np.zeros((len(known), self.width), np.uint64)
        for i, (n, _) in enumerate(known):
            for j, c in enumerate(n[:63]):
                self.bits[i, letters[c]] |= np.uint64(1 << j)

    def _close(self, letters: np.ndarray, places: np.ndarray, names: np.ndarray, length: int) -> np.ndarray:
        """Whether the groups of ``length`` at ``places`` have enough characters in common with the names beside them."""
        free = np.full(len(places), np.iinfo(np.uint64).max, np.uint64)
        for j in range(length):
            used = free & self.bits[names, letters[places + j]]
            free = (free + used) | (free - used)
        chars = self.chars[names]
        mask = (np.uint64(1) << np.minimum(chars, 63).astype(np.uint64)) - np.uint64(1)
        common = np.bitwise_count(~free & mask)
        need = np.where(self.same[names], np.minimum(chars, 63), LIKE * (chars + length) / 2 - 1e-6)
        return (common >= need) | (~self.same[names] & (chars > 63))

    def groups(self, chunk: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        """row, place among the groups of its text, and the group, for the groups that may be like a name."""
        joined = " ".join(text for *_, text in chunk)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = np.concatenate([self.letter[points], np.zeros(self.deepest, np.int32)])
        node, depth = np.ones(len(points), np.int32), {}
        for d in range(1, self.deepest + 1):
            node = self.steps[node * self.width + letters[d - 1 : d - 1 + len(points)]]
            depth[d] = node
        blanks = np.flatnonzero(points == 32)
        starts, ends = np.concatenate([[0], blanks + 1]), np.concatenate([blanks, [len(points)]])
        begins = np.cumsum([0] + [len(text) + 1 for *_, text in chunk[:-1]])
        text_of = np.searchsorted(begins, starts, "right") - 1
        first_word = np.searchsorted(starts, begins)
        for size in SIZES:
            words = np.arange(max(0, len(starts) - size + 1))
            length = ends[words + size - 1] - starts[words]
            length[text_of[words] != text_of[words + size - 1]] = -1
            by_length = np.argsort(length, kind="stable")
            ordered = length[by_length]
            for n, looks in self.wanted.items():
                some = words[by_length[np.searchsorted(ordered, n) : np.searchsorted(ordered, n + 1)]]
                places, pairs = starts[some], []
                for (at, size_of), (is_met, nodes, names) in looks.items():
                    here = depth[size_of][places + at]
                    met = np.flatnonzero(is_met[here])
                    if len(met):
                        lo, hi = np.searchsorted(nodes, here[met]), np.searchsorted(nodes, here[met], "right")
                        many = hi - lo
                        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        pairs.append(np.repeat(met, many) * len(self.chars) + names[np.repeat(lo, many) + nth])
                if not pairs:
                    continue
                met, name = np.divmod(np.unique(np.concatenate(pairs)), len(self.chars))
                for w in some[np.unique(met[self._close(letters, places[met], name, n)])].tolist():
                    row, number, _ = chunk[text_of[w]]
                    order = ((SIZES[0] - size) << 40) + number + int(w - first_word[text_of[w]])
                    yield row, order, joined[starts[w] : starts[w] + n]


def met_groups(texts: DataFrame, key: str, words: str, names: Iterable[str], exact: Iterable[str] = ()) -> DataFrame:
    """key, at, gram: the word groups of every text that may be like one of ``names``, and those that are one of ``exact``.

    Every group that is like a name is among them, others are only close to one. ``at`` puts groups of three
    words before two and one, then the order of the text. One pass that shuffles nothing.
    """
    names, exact = sorted(names), sorted(exact)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = _Lookup(names, exact)
        for batch in batches:
            keys = batch.column(0)
            for chunk in _chunks(batch.column(1).to_pylist()):
                found = list(lookup.groups(chunk))
                if found:
                    rows, at, gram = zip(*found)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(at, pa.int64()), pa.array(gram, pa.string())], [key, "at", "gram"])

    given = texts.where(F.col(words).isNotNull()).select(key, words)
    kind = given.schema[key].dataType.simpleString()
    return given.mapInArrow(look, f"`{key}` {kind}, at bigint, gram string")


def exact_names(groups: DataFrame, key: str, ranked: dict[str, dict[str, str]]) -> DataFrame:
    """key, and for each kind the target of the first name in order that is a group of the text."""
    rows = [(kind, name, target, i) for kind, names in ranked.items() for i, (name, target) in enumerate(names.items())]
    listed = F.broadcast(_constant(groups.sparkSession, dict(zip(("kind", "gram", "target", "rank"), zip(*rows)))))
    first = [F.min_by("target", F.when(F.col("kind") == k, F.col("rank"))).alias(k) for k in ranked]
    return groups.join(listed, "gram").groupBy(key).agg(*first)


def fuzzy_names(texts: DataFrame, key: str, words: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """key, and for each kind the target of the first word group that is like a name: groups of three words before two and
    one, then in the order of the text. Texts without such a group have no row; null texts have no groups.
    """
    names = {name for of in kinds.values() for name in of}
    return like_first(written(met_groups(texts, key, words, names), "groups"), key, kinds)


def like_first(groups: DataFrame, key: str, kinds: dict[str, dict[str, str]]) -> DataFrame:
    """As ``fuzzy_names``, from the groups of ``met_groups``, which are read twice."""
    groups = groups.where(F.char_length("gram") >= SHORTEST)
    found = written(like_names(groups.select("gram").distinct(), kinds), "names")
    found, _ = broadcast_if_small(found)
    hits = groups.join(found, "gram")
    first = [F.min_by("target", F.when(F.col("kind") == k, F.col("at"))).alias(k) for k in kinds]
    return hits.groupBy(key).agg(*first)
