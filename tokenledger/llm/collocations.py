"""Collocations: phrases of two to four words that stand together more often than their parts would have it.

Phrases are counted by marginalising the top order. Each word leads one window of four words, made of lead columns and
padded where its piece of text ends; only these longest windows are counted. Every contiguous phrase is the beginning of
exactly one window, so a ROLLUP of the window counts, which sums them over ever shorter beginnings, gives the counts of
all phrases of three, two and one words and of all words of a language.

Most windows are unique, and would cross the network for nothing. So a count-min sketch of words and pairs goes first, one
of the longer phrases of such pairs follows, and windows end before what these prove to be too rare to lie in a candidate. That changes no count of a candidate or its parts.

Counts are combined before every shuffle, so frequent words cost no more than rare ones there; the joins that fetch the
counts of a phrase's parts go through `lookup`, where a frequent part is no heavy key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm.common import blocks, strings, table, written
from tokenledger.llm.countmin import Sketch, sketch, width_for
from tokenledger.llm.lookup import lookup
from tokenledger.llm.repeats import Hashes, mixed

#: Words of the longest phrases.
ORDER = 4
#: Occurrences that make a phrase a candidate.
LEAST = 30
#: A score of one: the phrase makes up all occurrences of both its parts.
SCALE = 2_000_000
#: A candidate goes if a longer one around it has at least so many of a hundred of its occurrences.
ABSORBED = 80
#: Phrases returned for each language.
TOP = 2000
#: Characters that end a piece of text, and its words.
ENDS, BLANKS, END = b".,;:!?\n\v\f\r", b" \t", "."
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KIND = np.array([2 if i in ENDS else 1 if i in BLANKS else 0 for i in range(256)], np.uint8)
LOWER = np.array([i + 32 if ord("A") <= i <= ord("Z") else i for i in range(256)], np.uint8)
#: Bytes of text that are taken together, and hashed at a time; a longer text is taken whole.
TOGETHER, HASHED = 3 << 20, 1 << 19
WORDS = [f"w{i}" for i in range(1, ORDER + 1)]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased bytes of a batch of (lang, text), and of each word its start, end, hash and piece; a piece is a
    number that no other of the batch has."""
    data, bounds = strings(batch.column(1))
    low, high = int(bounds[0]), int(bounds[-1])
    # One byte that ends a piece goes between the documents.
    raw = np.full(high - low + len(bounds) - 1, ord(END), np.uint8)
    raw[np.arange(high - low) + np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))] = LOWER[data[low:high]]
    kind = KIND[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], kind == 0, [False]]).view(np.int8)))
    start, end = edges[::2], edges[1::2]
    piece = np.cumsum(kind == 2, dtype=np.int32)[start]
    hashes = np.empty(len(start), np.uint64)
    parts = np.unique(np.searchsorted(start, np.arange(0, len(raw) + HASHED, HASHED)))
    for a, b in zip(parts, parts[1:]):
        low, high = start[a], end[b - 1]
        hashes[a:b] = Hashes(raw[low:high])(start[a:b] - low, end[a:b] - low)
    return raw, start, end, hashes, piece


def _langs(batch: pa.RecordBatch, raw_start: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different langs of a batch, and which of them each word has."""
    coded = batch.column(0).dictionary_encode()
    _, bounds = strings(batch.column(1))
    ends = bounds[1:] - bounds[0] + np.arange(1, len(bounds))
    return coded.dictionary, coded.indices.to_numpy()[np.searchsorted(ends, raw_start, "right")].astype(np.int64)


def _with_lang(hashes: np.ndarray, langs: pa.Array, lang: np.ndarray) -> np.ndarray:
    salts = [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs.to_pylist()]
    return mixed(hashes ^ np.array(salts, np.uint64)[lang]) if len(hashes) else hashes


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases by one word longer, from those of the phrases that begin at each word; the last ones fall short."""
    n = len(hashes) - 1
    return mixed(hashes[:n] * np.uint64(0x9E3779B97F4A7C15) + words[len(words) - n :]) if n > 0 else hashes[:0]


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, bounds = strings(batch.column(1))
        yield from (batch.slice(a, b - a) for a, b in blocks(bounds, TOGETHER))


def _follows(words: np.ndarray, piece: np.ndarray, screen: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Which words may be frequent, and which of them the next one may follow."""
    frequent = screen.may_reach(words)
    near = piece[:-1] == piece[1:]
    return frequent, near & frequent[:-1] & frequent[1:] & screen.may_reach(_longer(words, words))


def _screens(texts: DataFrame, least: int) -> tuple[Broadcast, Broadcast]:
    """Which words and pairs of neighbours, and which longer phrases of such pairs, may have `least` occurrences in their language."""
    spark = texts.sparkSession.sparkContext
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]

    def pairs(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in _parts([batch]):
            _, start, _, hashes, piece = _words(part)
            words = _with_lang(hashes, *_langs(part, start))
            yield np.concatenate([words, _longer(words, words)[piece[:-1] == piece[1:]]])

    short = spark.broadcast(sketch(texts, pairs, least, width_for(size // 3)))  # about a word and a pair on six bytes

    def longer(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for part in _parts([batch]):
            _, start, _, hashes, piece = _words(part)
            words = _with_lang(hashes, *_langs(part, start))
            phrase, goes_on = words, np.ones(len(words), bool)
            _, follows = _follows(words, piece, short.value)
            for k in range(1, ORDER):
                phrase = _longer(phrase, words)
                goes_on = goes_on[: len(phrase)] & follows[k - 1 :]
                if k > 1:
                    yield phrase[goes_on]

    return short, spark.broadcast(sketch(texts, longer, least, width_for(size // 12)))


def windows(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, w1 to w4 and their number of occurrences: a window for each word, with the words that follow it in its piece.

    A window is padded with empty strings where its piece ends. It also ends before it would hold a word or phrase that the
    screens prove to be rarer than `least`: no candidate holds one. A rare first word leaves a window of padding, so all words are counted.
    """
    lang, text = (F.col(c).cast("string") for c in ("lang", "text"))
    texts = docs.select(F.coalesce(lang, F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    short, long = _screens(texts, least)

    def lead(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            raw, start, end, hashes, piece = _words(batch)
            n = len(start)
            if not n:
                continue
            langs, lang = _langs(batch, start)
            words = _with_lang(hashes, langs, lang)
            frequent, follows = _follows(words, piece, short.value)
            _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
            size = end[first] - start[first]
            offsets = np.append(0, np.cumsum(size))
            chars = raw[np.arange(offsets[-1]) + np.repeat(start[first] - offsets[:-1], size)]
            buffers = [None, pa.py_buffer(np.append(offsets, offsets[-1]).astype(np.int32)), pa.py_buffer(chars)]
            known = pa.StringArray.from_buffers(len(first) + 1, buffers[1], buffers[2])  # the last one is empty
            lead_, goes_on, phrase = [np.where(frequent, number, len(first))], frequent, words
            for k in range(1, ORDER):
                phrase = _longer(phrase, words)
                goes_on = goes_on[: len(phrase)] & follows[k - 1 :]
                if k > 1:
                    goes_on &= long.value.may_reach(phrase)
                column = np.full(n, len(first))
                column[: len(phrase)] = np.where(goes_on, number[n - len(phrase) :], len(first))
                lead_.append(column)
            kinds = lang.astype(np.uint64)
            for column in lead_:
                kinds = mixed(kinds * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64) + np.uint64(1))
            _, one, times = np.unique(kinds, return_index=True, return_counts=True)
            columns = [langs.take(pa.array(lang[one])), *(known.take(pa.array(c[one])) for c in lead_), pa.array(times)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", *WORDS, "n"])

    fields = ", ".join(f"{w} string" for w in WORDS)
    return texts.mapInArrow(lead, f"lang string, {fields}, n long")


def phrase_counts(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, a) of the phrases of one to four words with at least `least` occurrences, and (lang, n)."""
    longest = written(windows(docs, least).groupBy("lang", *WORDS).agg(F.sum("n").alias("a")), "windows")
    # The rolled-up columns come back null; how many are left says the level. The windows themselves are level four.
    sums = longest.rollup("lang", *WORDS[:-1]).agg(F.sum("a").alias("a"), F.grouping_id().alias("gone"))
    levels = written(sums.where((F.col("a") >= least) | (F.col("gone") == 7)), "levels")
    n = levels.where("gone = 7").select("lang", F.col("a").alias("n"))
    parts = levels.where("gone < 7").select("lang", *WORDS[:-1], F.lit(None).cast("string").alias(WORDS[-1]), "a")
    parts = parts.union(longest.where(F.col("a") >= least).select("lang", *WORDS, "a"))
    words = F.array_compact(F.array(*WORDS))
    parts = parts.select("lang", words.alias("words"), "a").where(~F.array_contains("words", ""))
    return written(parts.select("lang", "words", F.array_join("words", " ").alias("phrase"), "a"), "phrases"), n


def _whole(number: str | Column) -> Column:
    return (F.col(number) if isinstance(number, str) else number).cast("decimal(20,0)")


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, absorbed: int = ABSORBED, scale: int = SCALE
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best `top` phrases of each language.

    A null lang is `und`, like a lang of that name; a null text is empty. Rows with one doc_id, and equal rows, are
    documents of their own. Ties in score and occurrences go by the bytes of the phrase, so the ranks are settled. A
    language without candidates, and an empty table, give no rows. Other columns may have any names.
    """
    known, n = phrase_counts(docs.select("text", "lang"), least)
    candidates = known.select("*", F.size("words").alias("k")).where("k > 1")
    cuts = candidates.select("lang", "phrase", "words", "k", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut",
        F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    for part, count in (("first", "l"), ("rest", "r")):
        counts = known.select("lang", F.col("phrase").alias(part), F.col("a").alias(count))
        cuts = lookup(written(cuts, f"cuts-{part}"), counts, ["lang", part]).drop(part)
    # Whole numbers of up to 38 digits; the quotient is at most half the scale.
    score = F.expr(f"(CAST(a AS decimal(20,0)) * {scale}) div (CAST(l AS decimal(20,0)) + CAST(r AS decimal(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    def slices(k: int) -> list[Column]:
        return [F.array_join(F.slice("words", i + 1, size), " ") for size in range(2, k) for i in range(k - size + 1)]

    inner = reduce(lambda so_far, k: F.when(F.col("k") == k, F.array(*slices(k))).otherwise(so_far), range(4, ORDER + 1), F.array(*slices(3)))
    around = candidates.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around.hint("merge"), ["lang", "phrase"], "left")
    kept = kept.where(F.col("longer").isNull() | (_whole("longer") * 100 < _whole("a") * absorbed))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    ranked = kept.select("*", F.row_number().over(order).cast("long").alias("rank")).where(F.col("rank") <= top)
    return ranked.join(n.hint("merge"), "lang").select(
        "lang", "rank", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )


def op13_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH lined AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS row,
         string_split_regex(translate(coalesce(text, ''), '{CAPITALS}', '{CAPITALS.lower()}'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
piece AS (SELECT lang, row, unnest(pieces) AS piece FROM lined),
word AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM piece),
total AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM word GROUP BY lang),
gram AS (
  SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: list_slice(words, i, i + k - 1))) AS words
  FROM word, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
known AS (
  SELECT lang, words, k, array_to_string(words, ' ') AS phrase, count(*) AS a FROM gram GROUP BY lang, words, k HAVING count(*) >= {LEAST}),
cut AS (
  SELECT lang, words, phrase, a, k, unnest(range(1, k)) AS cut FROM known WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.cut, l.a AS l, r.a AS r,
         CAST(CAST(c.a AS HUGEINT) * {SCALE} // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
  FROM cut c JOIN known l ON l.lang = c.lang AND l.words = list_slice(c.words, 1, c.cut)
             JOIN known r ON r.lang = c.lang AND r.words = list_slice(c.words, c.cut + 1, c.k)),
best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM known o WHERE o.lang = b.lang AND o.k > 1 AND o.phrase <> b.phrase
      AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.a >= {ABSORBED} * b.a)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}"""
