"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed 2- and 3-grams of its lower-cased bytes (everything in ASCII that is no letter is a space):
1 + log of the count, times the inverse document frequency, at length one. The vectors of each language's sample are
clustered by spherical k-means, so a language has a few centroids, and a text gets the language of the centroid with the
greatest cosine. A text is rejected if that cosine is under a bound that grows with the number of its different n-grams.
Short texts lie far from any centroid, so of few n-grams only what has less than a quarter of the least cosine in the
language's sample is another language or none. Of more n-grams it is what has less than 0.6 of nearly all sampled texts
of as many; too few such texts give no bound of their own, and that of the next shorter ones holds.

Document frequencies come from all training rows, summed over tasks. The centroids come from a bounded sample of at most
about `sample` rows a language, chosen by a hash of the doc_id; that sample is all that goes to the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import bound_batches, strings, table

BUCKETS = 4096
CLUSTERS = 4
SAMPLE = 300
#: A short text's cosine under this part of the least in the sample is too far.
REJECTED = 0.25
#: Different n-grams from which on a text is longer than short, and from which on the next longer classes begin.
LONGER = (128, 256, 512, 1024)
#: A longer text's cosine under this part of the quantile of the sampled texts of its class is too far.
FAR, QUANTILE = 0.6, 0.01
#: Least number of sampled texts of a class, of the language or else of all, that give a bound.
ENOUGH = 20
#: Bytes of text that become n-grams at a time, and rows at a time.
BLOCK_BYTES, BLOCK_ROWS = 1 << 19, 256
UNKNOWN = "und"

FOLD = bytes(i if i >= 0x80 or chr(i).isalpha() else 0x20 for i in range(256))
LETTERS = re.compile(rb"[A-Za-z]")


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    #: The language of each centroid, and the least cosine that it accepts of short texts and those of each longer class.
    languages: list[str]
    least: np.ndarray


def _slices(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of the rows' texts; long ones in parts that do not cut a code point."""
    for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        while b - a > BLOCK_BYTES:
            end = a + BLOCK_BYTES
            while data[end] & 0xC0 == 0x80:
                end -= 1
            yield row, a, end
            a = end
        yield row, a, b


def count_vectors(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """A row of n-gram counts for each text. Few texts at a time: the result is dense."""
    out = np.zeros((len(bounds) - 1) * buckets, np.float32)
    parts, rows, size = [], [], 0

    def add() -> None:
        raw = np.frombuffer(b"".join(parts), np.uint8)
        owner = np.repeat(np.array(rows), [len(p) for p in parts]) * buckets
        gap = (raw[:-1] == 0x20) & (raw[1:] == 0x20)
        wide = raw.astype(np.uint32)
        two = (wide[:-1] << np.uint32(8)) | wide[1:]
        three = (two[:-1] << np.uint32(8)) | wide[2:]
        for grams, salt, keep in ((two, 0x9E3779B1, ~gap), (three, 0x85EBCA77, ~(gap[:-1] | gap[1:]))):
            hashed = (grams[keep] + np.uint32(1)) * np.uint32(salt) >> np.uint32(32 - (buckets.bit_length() - 1))
            out[:] += np.bincount(owner[: len(grams)][keep] + hashed, minlength=len(out)).astype(np.float32)

    for row, a, b in _slices(data, bounds):
        parts.append(b" " + data[a:b].tobytes().decode("utf-8", "replace").lower().encode().translate(FOLD) + b" ")
        rows.append(row)
        size += b - a
        if size >= BLOCK_BYTES:
            add()
            parts, rows, size = [], [], 0
    if parts:
        add()
    return out.reshape(-1, buckets)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def has_letters(text: bytes) -> bool:
    return bool(LETTERS.search(text)) or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def clustered(vectors: np.ndarray, clusters: int, rounds: int = 12) -> np.ndarray:
    """Centroids of length one by spherical k-means; the first ones are far from each other."""
    chosen = [vectors.sum(axis=0)]
    best = vectors @ (chosen[0] / max(np.linalg.norm(chosen[0]), 1e-9))
    centroids = vectors[[int(np.argmax(best))]]
    for _ in range(min(clusters, len(vectors)) - 1):
        centroids = np.vstack([centroids, vectors[int(np.argmin((vectors @ centroids.T).max(axis=1)))]])
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.array([vectors[own == k].sum(axis=0) if (own == k).any() else centroids[k] for k in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids


def length_class(counts: np.ndarray) -> np.ndarray:
    """0 for short texts, then the place in LONGER."""
    return np.digitize((counts > 0).sum(axis=1), LONGER)


def bounds_by_class(likeness: np.ndarray, classes: np.ndarray, every: tuple[np.ndarray, np.ndarray]) -> list[float]:
    """The least cosine accepted in each class, from the cosines and classes of a language's sample and those of all."""
    out = [REJECTED * float(likeness.min(initial=1))]
    for k in range(1, len(LONGER) + 1):
        own = next((x for x in (likeness[classes == k], every[0][every[1] == k]) if len(x) >= ENOUGH), None)
        out.append(out[-1] if own is None else max(out[-1], FAR * float(np.quantile(own, QUANTILE))))
    return out


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, bounds = strings(batch.column(column))
    for at in range(0, len(bounds) - 1, BLOCK_ROWS):
        yield at, data, bounds[at : at + BLOCK_ROWS + 1]


def fit(training: DataFrame, buckets: int = BUCKETS, clusters: int = CLUSTERS, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of `training` (doc_id, text, lang); null texts are left out."""
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    bound_batches(training.sparkSession)
    rows = training.where("text is not null and lang is not null").select("doc_id", "text", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model(np.ones(buckets, np.float32), np.zeros((0, buckets), np.float32), [], np.zeros((0, len(LONGER) + 1)))

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, bounds in _blocks(batch, 0):
                total += (count_vectors(data, bounds, buckets) > 0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    found = rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    df = np.zeros(buckets)
    for r in found.collect():
        df[r["bucket"]] = r["n"]
    idf = (np.log((1 + sum(sizes.values())) / (1 + df)) + 1).astype(np.float32)

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, bounds in _blocks(batch, 0):
                counts = count_vectors(data, bounds, buckets)
                raw = [np.ascontiguousarray(np.column_stack([i := np.flatnonzero(c), c[i]]), "<u4").tobytes() for c in counts]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(raw)), pa.array(raw, pa.binary())], names=["lang", "counts"])

    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, sample / n)]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < share * (1 << 30)
    vectors: dict[str, list[np.ndarray]] = {}
    for r in rows.where(drawn).select("text", "lang").mapInArrow(sampled, "lang string, counts binary").collect():
        counts = np.zeros(buckets, np.float32)
        pairs = np.frombuffer(r["counts"], "<u4").reshape(-1, 2)
        counts[pairs[:, 0]] = pairs[:, 1]
        vectors.setdefault(r["lang"], []).append(counts)
    centroids, languages, found = [], [], []
    for lang in sorted(vectors):
        counts = np.array(vectors.pop(lang))
        own = weighted(counts, idf)
        own = own[order := np.lexsort(own[:, :8].T)]
        middle = clustered(own, clusters)
        centroids.append(middle)
        languages += [lang] * len(middle)
        found.append(((own @ middle.T).max(axis=1), length_class(counts)[order], len(middle)))
    every = tuple(np.concatenate([x[i] for x in found]) if found else np.zeros(0) for i in (0, 1))
    least = [bounds_by_class(likeness, classes, every) for likeness, classes, n in found for _ in range(n)]
    middle = np.vstack(centroids) if centroids else np.zeros((0, buckets), np.float32)
    return Model(idf, middle, languages, np.array(least).reshape(-1, len(LONGER) + 1))


NAMES = ("lang_pred", "score", "rejected")


def predict(docs: DataFrame, model: Model, keep: list[str], names: tuple[str, str, str] = NAMES) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score (the greatest cosine) and rejected, or what `names` calls them.

    A null text, or one without a letter, is `und` with score 0 and rejected; so is every text if nothing was learned.
    A text with no known n-gram gets the first language and is rejected. Only the text is looked at.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    text = F.col("text").cast("string").alias("text")
    own = docs.select([text if c == "text" else F.col(c) for c in (keep if "text" in keep else ["text", *keep])])
    at = own.columns.index("text")
    out = [f for f in own.schema if f.name != "text" or "text" in keep]
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType(out + [T.StructField(name, kind) for name, kind in zip(names, kinds)])

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        for batch in batches:
            langs, scores, rejected = [], [], []
            for _, data, bounds in _blocks(batch, at):
                if not model.languages:
                    n = len(bounds) - 1
                    langs, scores, rejected = langs + [UNKNOWN] * n, scores + [0.0] * n, rejected + [True] * n
                    continue
                counts = count_vectors(data, bounds, len(model.idf))
                likeness, classes = weighted(counts, model.idf) @ model.centroids.T, length_class(counts)
                best = likeness.argmax(axis=1)
                for row, (k, a, b) in enumerate(zip(best.tolist(), bounds[:-1].tolist(), bounds[1:].tolist())):
                    known = has_letters(data[a:b].tobytes())
                    score = min(1.0, max(0.0, float(likeness[row, k]))) if known else 0.0
                    langs.append(model.languages[k] if known else UNKNOWN)
                    scores.append(score)
                    rejected.append(not known or score < model.least[k, classes[row]])
            marks = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            columns = [batch.column(f.name) for f in out] + marks
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return own.mapInArrow(nearest, schema)


def held_out() -> Column:
    """Whether a row is kept from training: crc32 of its doc_id as text leaves 1 over 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()))
    return predict(docs, model, ["doc_id"]).withColumn("held_out", held_out())
