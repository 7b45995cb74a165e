"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the smallest hash among its s-mers lies at its first or last place. Whether it is
one depends on the k-mer alone, so equal passages have equal anchors wherever they stand. A fingerprint holds the `size`
anchors with the smallest hashes and the place of each. Two fingerprints are compared by the anchors they share in the
same order: their number, as a part of the smallest `size` anchors of both together.

The comparison of neighbours deals documents out by ranges of doc_id, so a task has nearly every document's next one.
Only the first and last document of each range need another task's, and those meet in a join by the number of the range.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import packed, table, written

K, S = 24, 8
SIZE = 64
#: Code points that are hashed at a time.
CHUNK = 1 << 17
MULTIPLIER = 0x9E3779B97F4A7C15

Fingerprint = tuple[np.ndarray, np.ndarray]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of all n-grams of code points; n is a sum of doublings."""
    base = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    out, have, power, width, step = None, 0, base, 1, MULTIPLIER
    while n - have:
        if (n - have) & width:
            if out is None:
                out = power
            else:
                m = min(len(out) - width, len(power))
                out = power[:m] * np.uint64(pow(MULTIPLIER, have, 1 << 64)) + out[width : width + m] if m > 0 else power[:0]
            have += width
        if len(power) > width:
            power = power[:-width] * np.uint64(step) + power[width:]
        else:
            power = power[:0]
        step, width = step * step % (1 << 64), 2 * width
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _window_min(values: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        values, width = np.minimum(values[:-width], values[width:]), 2 * width
    rest = n - width
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def anchors(text: str, k: int = K, s: int = S) -> Iterator[Fingerprint]:
    """(hashes, places) of the closed syncmers of a text, part by part. A text shorter than k is its own anchor, and the k-mer
    of least hash is that of a longer one without a closed syncmer; from 2 k - s code points on there always is one."""
    codes = _codes(text)
    if 0 < len(codes) < k:
        yield gram_hashes(codes, len(codes)) >> np.uint64(32), np.zeros(1, np.int64)
    for at in range(0, len(codes) - k + 1, CHUNK):
        part = codes[at : at + CHUNK + k - 1]
        inner = gram_hashes(part, s)
        least = _window_min(inner, k - s + 1)
        place = np.flatnonzero((inner[: len(least)] == least) | (inner[k - s :] == least))
        grams = gram_hashes(part, k)
        if not len(place) and len(codes) < 2 * k - s:
            place = np.array([grams.argmin()])
        yield grams[place] >> np.uint64(32), place + at


def fingerprint(text: str, size: int = SIZE, k: int = K, s: int = S) -> Fingerprint:
    """The `size` smallest hashes of anchors, ascending, and the first place of each. Empty for an empty text."""
    hashes, places = np.empty(0, np.uint64), np.empty(0, np.int64)
    for more, at in anchors(text, k, s):
        if len(hashes) == size:
            few = more < hashes[-1]
            more, at = more[few], at[few]
        hashes, first = np.unique(np.concatenate([hashes, more]), return_index=True)
        places = np.concatenate([places, at])[first][:size]
        hashes = hashes[:size]
    return hashes, places


def as_bytes(own: Fingerprint) -> bytes:
    """Eight bytes for each anchor: hash and place."""
    return np.column_stack([own[0], own[1].astype(np.uint64)]).astype(">u4").tobytes()


def likeness(a: Fingerprint, b: Fingerprint, size: int = SIZE) -> float:
    """From 0 to 1; 1 for equal fingerprints, also for two empty ones."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    union = np.union1d(a[0], b[0])[:size]
    shared, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inside = shared <= union[-1]
    order = np.argsort(a[1][i[inside]], kind="stable")
    tails: list[int] = []  # of rising runs of places, by their length
    for place in b[1][j[inside]][order].tolist():
        at = bisect_left(tails, place)
        tails[at : at + 1] = [place]
    return len(tails) / len(union)


def fingerprints(docs: DataFrame, size: int = SIZE, k: int = K, s: int = S) -> DataFrame:
    """doc_id, hashes and places (arrays of the anchors kept) of every document; a null text is an empty one."""
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [T.StructField(name, T.ArrayType(T.LongType())) for name in ("hashes", "places")]
    )

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t or "", size, k, s) for t in batch.column(1).to_pylist()]
            columns = [pa.array([x[i].astype(np.int64).tolist() for x in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(mark, schema)


FIELDS = (
    "n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
)


def _compared(text: str, own: Fingerprint, following: str, its: Fingerprint) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + following[: n // 2]
    mark = fingerprint(edited)
    sha = hashlib.sha256(edited.encode()).hexdigest()
    return n, sha, as_bytes(own), as_bytes(mark), likeness(own, mark), likeness(own, its)


def neighbours(docs: DataFrame) -> DataFrame:
    """Every document against its edited text and against the next document by doc_id; the last one's next is the first.

    The edited text has its last floor(n / 2) code points replaced by as many from the start of the next document, or all.
    Null texts are empty; rows with one doc_id follow each other by a hash of the text; a null doc_id comes first; one
    document alone is its own next; no documents give no rows. Fingerprints are hexadecimal, 16 digits for each anchor.
    """
    id_type = docs.schema["doc_id"].dataType
    kinds = [T.StructField("doc_id", id_type), *T._parse_datatype_string(FIELDS).fields]
    edge = [T.StructField("part", T.IntegerType()), T.StructField("place", T.StringType()), T.StructField("text", T.BinaryType())]
    schema = T.StructType(kinds + edge)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = packed(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tie")))

    def walk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, press = TaskContext.get().partitionId(), None, zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, small in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = press.decompress(small).decode()
                mark = fingerprint(text)
                if last is None:
                    rows.append((doc_id, *[None] * 6, part, "first", small))
                else:
                    rows.append((last[0], *_compared(last[1], last[2], text, mark), None, None, None))
                last = doc_id, text, mark, small
            yield _arrow(rows, schema, batch.schema.field(0).type)
            kind = batch.schema.field(0).type
        if last is not None:
            yield _arrow([(last[0], *[None] * 6, part, "last", last[3])], schema, kind)

    # The place of a row counts, so rows are dealt out once and kept as a table.
    walked = written(own.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(walk, schema), "neighbours")
    parts = walked.where("place = 'first'").select("part")
    ring = parts.select("part", F.lead("part").over(Window.orderBy("part")).alias("after"))
    ring = ring.crossJoin(parts.agg(F.min("part").alias("least"))).select("part", F.coalesce("after", "least").alias("after"))
    firsts = walked.where("place = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))
    lasts = walked.where("place = 'last'").select("doc_id", "part", "text").join(ring, "part").join(firsts, "after")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, *both in zip(*(c.to_pylist() for c in batch.columns)):
                text, following = (press.decompress(x).decode() for x in both)
                rows.append((doc_id, *_compared(text, fingerprint(text), following, fingerprint(following))))
            yield _arrow(rows, T.StructType(kinds), batch.schema.field(0).type)

    closed = lasts.select("doc_id", "text", "following").mapInArrow(close, T.StructType(kinds))
    every = walked.where("place is null").select([f.name for f in kinds]).union(closed)
    return every.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def _arrow(rows: list[tuple], schema: T.StructType, id_kind: pa.DataType) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    types = [id_kind] + [kinds[f.dataType.simpleString()] for f in schema.fields[1:]]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=schema.names)


def op5_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "documents"))
