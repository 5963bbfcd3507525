"""SentencePiece encoding and decoding as a relational lattice.

Distinct words are exploded into their substrings up to the longest piece, substrings are equi-joined to the piece table,
the edges found are grouped by word, and a higher-order aggregate folds the lattice of each word into its pieces. The
public vocabulary is of the merging kind, whose scores are merge ranks: adding them up along a path, as a best-path fold
does, gives other pieces than the tokenizer does. So the fold merges instead: it starts from single characters and, step
by step, drops the boundary whose two neighbours form the lattice edge of the highest score, leftmost first.

No piece continues over the start of a word (white space stands before words only) or over a line feed, so words are
encoded alone. Frequent words, up to ``DICTIONARY``, go through the lattice and are broadcast as a dictionary of proven
size; where texts are assembled, a task merges the rare words that are left by the same rule and the same piece table.
"""

from __future__ import annotations

import heapq
import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isohaline.llm.common import travels
from isohaline.session import written

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DICTIONARY = 250_000  # words that may be broadcast; with LONGEST_WORD this bounds the dictionary at about 80 MB a process
RARE = 60_000  # rare words that a task remembers
ROWS_OUT = 500  # documents of one output batch
LONGEST_WORD = 48  # code points of a dictionary word
MAX_PIECES = 300_000
SPACE = "▁"
UNITS = f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+"


@dataclass
class Vocabulary:
    """Pieces with scores, the ids of single bytes, and what each id decodes to."""

    ids: dict[str, int]
    scores: dict[str, float]
    byte_ids: list[int]
    raw: list[bytes]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids), default=1)


def load(path: str = MODEL) -> Vocabulary:
    """The piece table of a SentencePiece model of the merging kind with byte fallback."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    if n > MAX_PIECES:
        raise ValueError(f"{n} pieces; the broadcast is bounded at {MAX_PIECES}")
    ids, scores, byte_ids, raw = {}, {}, [-1] * 256, [b""] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value], raw[i] = i, bytes([value])
        elif not (model.is_control(i) or model.is_unknown(i)):
            ids[piece], scores[piece], raw[i] = i, model.get_score(i), piece.replace(SPACE, " ").encode()
    spans = [p for p in ids if "\n" in p or SPACE in p.lstrip(SPACE)]
    if spans or -1 in byte_ids:
        raise ValueError("pieces must not continue over a word start or line feed, and every byte needs a piece")
    return Vocabulary(ids, scores, byte_ids, raw)


def frequent_words(docs: DataFrame, limit: int = DICTIONARY) -> DataFrame:
    """Distinct words, marked, by count: all with at least the smallest power of two that leaves ``limit`` of them."""
    texts = docs.filter(F.col("text") != "").select(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("u"))
    counts = texts.select(F.explode("u").alias("word")).groupBy("word").count()
    counts = counts.select(F.concat(F.lit(SPACE), "word").alias("word"), "count").filter(F.char_length("word") <= LONGEST_WORD)
    counts = written(counts.filter("count > 1"), "words").withColumn("level", F.floor(F.log2("count")))
    least, total = 64, 0
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["level"]):
        total += r["n"]
        if total > limit:
            break
        least = r["level"]
    return counts.filter(F.col("level") >= least).select("word")


def lattice(words: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, edges): every substring of a word that is a piece, as struct<key, score, id>; key is start * 64 + end."""
    spark = words.sparkSession
    rows = [(p, vocab.scores[p], i) for p, i in vocab.ids.items()]
    table = spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "score", "id"]), "piece string, score double, id int")
    n = F.char_length("word")
    starts = words.select("word", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    spans = starts.select("word", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.col("s") + vocab.longest, F.col("n")))).alias("e"))
    parts = spans.select("word", (F.col("s") * 64 + F.col("e")).alias("key"), F.expr("substring(word, s + 1, e - s)").alias("piece"))
    edges = parts.join(F.broadcast(table), "piece")
    return words.join(edges.groupBy("word").agg(F.collect_list(F.struct("key", "score", "id")).alias("edges")), "word", "left")


def folded(graph: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(word, ids) of a lattice, by merging over its edges; characters without a piece become bytes."""
    n = F.char_length("word")
    edges = F.coalesce("edges", F.array().cast("array<struct<key:int,score:double,id:int>>"))
    scores = F.map_from_entries(F.transform(edges, lambda e: F.struct(e["key"], e["score"])))
    ids = F.map_from_entries(F.transform(edges, lambda e: F.struct(e["key"], e["id"])))
    graph = graph.select("word", n.alias("n"), scores.alias("scores"), ids.alias("ids"))
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))

    def merge(cuts: Column, _: Column) -> Column:
        inner = F.sequence(F.lit(1), F.size(cuts) - 2)
        pairs = F.transform(inner, lambda i: F.struct(F.try_element_at(F.col("scores"), at(cuts, i - 1) * 64 + at(cuts, i + 1)).alias("score"), (-i).alias("i")))
        best = F.array_max(F.filter(pairs, lambda p: p["score"].isNotNull()))
        drop = F.transform(F.array(best), lambda b: F.when(b.isNull(), cuts).otherwise(F.filter(cuts, lambda c: c != at(cuts, -b["i"]))))
        return F.when(F.size(cuts) < 3, cuts).otherwise(F.element_at(drop, 1))

    cuts = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.sequence(F.lit(0), F.col("n")), merge)
    bytes_of = F.array(*[F.lit(i) for i in vocab.byte_ids])

    def emit(c: Column, i: Column, all_: Column) -> Column:
        found = F.try_element_at(F.col("ids"), at(all_, i) * 64 + at(all_, i + 1))
        code = F.hex(F.encode(F.substring(F.col("word"), c + 1, F.lit(1)), "utf-8"))
        raw = F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda k: F.element_at(bytes_of, F.conv(F.substring(code, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + 1))
        return F.when(found.isNotNull(), F.array(found)).otherwise(raw)

    graph = graph.select("word", "ids", cuts.alias("cuts"))
    spans = F.slice("cuts", F.lit(1), F.size("cuts") - 1)
    return graph.select("word", F.flatten(F.transform(spans, lambda c, i: emit(c, i, F.col("cuts")))).alias("ids"))


def merge_word(word: str, vocab: Vocabulary) -> list[int]:
    """Pieces of one word by the same merges."""
    parts = _merged(word, vocab.scores) if len(word) <= 64 else _merged_long(word, vocab.scores)
    out = []
    for t in parts:
        i = vocab.ids.get(t)
        out += [i] if i is not None else [vocab.byte_ids[b] for b in t.encode("utf-8", "surrogatepass")]
    return out


def _merged(word: str, scores: dict[str, float]) -> list[str]:
    none = float("-inf")
    parts = list(word)
    pairs = [scores.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        best = max(pairs)
        if best == none:
            break
        i = pairs.index(best)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = scores.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = scores.get(parts[i - 1] + parts[i], none)
    return parts


def _merged_long(word: str, scores: dict[str, float]) -> list[str]:
    """With a heap, so that a word without end takes n log n steps."""
    text, n = list(word), len(word)
    ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-scores[p], i, p) for i, p in enumerate(map("".join, zip(text, text[1:]))) if p in scores]
    heapq.heapify(heap)

    def offer(i: int, piece: str) -> None:
        if piece in scores:
            heapq.heappush(heap, (-scores[piece], i, piece))

    while heap:
        _, i, piece = heapq.heappop(heap)
        j = ahead[i]
        if not text[i] or j >= n or text[i] + text[j] != piece:
            continue
        text[i], text[j] = piece, ""
        k = ahead[i] = ahead[j]
        if k < n:
            behind[k] = i
            offer(i, piece + text[k])
        if behind[i] >= 0:
            offer(behind[i], text[behind[i]] + piece)
    return [t for t in text if t]


def decode_ids(ids, raw: list[bytes]) -> str:
    """Text of a piece sequence, without the space that stands before the first word."""
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def dictionary(docs: DataFrame, vocab: Vocabulary, limit: int = DICTIONARY) -> dict[str, bytes]:
    """Frequent words and their ids as packed integers; at most ``limit`` words."""
    found = folded(lattice(frequent_words(docs, limit), vocab), vocab)
    return {r["word"]: np.array(r["ids"], dtype=np.int32).tobytes() for r in written(found, "dictionary").toLocalIterator()}


def encode(docs: DataFrame, path: str = MODEL, limit: int = DICTIONARY) -> DataFrame:
    """doc_id, n_pieces, pieces, round_trip for every row of ``docs``.

    ``pieces`` equals the tokenizer's own encoding of the whole text. ``round_trip`` says that decoding gives the text
    back; only texts that hold the mark U+2581 itself, which decodes to a space, do not. Null counts as empty, and an
    empty text has no pieces. Repeated rows and null ids give a row each; an empty table gives none.
    """
    vocab = load(path)
    known_words = docs.sparkSession.sparkContext.broadcast(dictionary(docs, vocab, limit))
    kind = docs.schema["doc_id"].dataType.simpleString()
    find = re.compile(UNITS).findall

    def run(batches):
        known = known_words.value
        rare: dict[str, bytes] = {}
        for b in batches:
            for at in range(0, len(b), ROWS_OUT):
                part = b.iloc[at : at + ROWS_OUT]
                if len(rare) > RARE:
                    rare.clear()
                rows = []
                for text in part["text"]:
                    text = text or ""
                    found = []
                    for u in find(SPACE + text.replace(" ", SPACE)) if text else ():
                        p = known.get(u) or rare.get(u)
                        if p is None:
                            p = array("i", merge_word(u, vocab)).tobytes()
                            if len(u) <= LONGEST_WORD:
                                rare[u] = p
                        found.append(p)
                    ids = np.frombuffer(b"".join(found), dtype=np.int32)
                    rows.append((len(ids), ids, decode_ids(ids.tolist(), vocab.raw) == text))
                out = pd.DataFrame(rows, columns=["n_pieces", "pieces", "round_trip"])
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, n_pieces long, pieces array<int>, round_trip boolean")


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, text of rows with ``pieces``; null pieces give null, ids outside the table raise."""
    raw = load(path).raw
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": [None if p is None else decode_ids(p, raw) for p in b["pieces"]]})

    return encoded.select("doc_id", "pieces").mapInPandas(run, f"doc_id {kind}, text string")


def piece_table(spark: SparkSession, path: str = MODEL) -> DataFrame:
    """The piece table as rows (id, piece, score), for users who join it themselves."""
    vocab = load(path)
    return spark.createDataFrame([(i, p, vocab.scores[p]) for p, i in vocab.ids.items()], "id int, piece string, score double")


travels(__name__)
