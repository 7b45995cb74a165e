"""Quality by importance resampling.

Texts are bags of hashed grams: runs of letters and digits or of other signs between white space, ASCII lower-cased, and
pairs of such runs that follow each other. Two models give each gram a probability, one from the target (documents labelled as good), one
from all raw documents, both with one added to every count. A document's weight is the product of the ratios of the two
over its grams; its logarithm tells good from bad text. Documents are drawn without replacement in proportion to the weights by
adding Gumbel noise to the logarithms and keeping the k greatest. The noise is a hash of the doc_id and the text, so a draw can
be repeated, and rows that share a doc_id, or have none, are drawn independently unless their texts are equal too.

The counts cover all documents and cross the network as one vector for each task. The k greatest are found exactly: rows
are dealt out by ranges of the noisy weight, and a row's rank is the number of rows in the ranges above plus its rank within
its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import blocks, packed, strings, table, unpacked, written
from tokenledger.llm.repeats import Hashes, mixed

BUCKETS = 1 << 14
SEED = 17
#: Bytes of text that become grams at a time.
BLOCK_BYTES = 1 << 18

KIND = np.array([0 if i in b"\t\n\x0b\x0c\r " else 1 if chr(i).isalnum() or i >= 128 else 2 for i in range(256)], np.uint8)
LOWER = np.array([i | 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


def runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of signs of one kind, and the text (by its place in `starts`) of each."""
    kind = KIND[raw]
    turn = np.ones(len(raw), bool)
    turn[1:] = kind[1:] != kind[:-1]
    turn[starts[starts < len(raw)]] = True
    begin = np.flatnonzero(turn)
    end = np.append(begin[1:], len(raw))
    keep = kind[begin] > 0
    begin, end = begin[keep], end[keep]
    return Hashes(LOWER[raw])(begin, end), np.searchsorted(starts, begin, "right") - 1


def grams(data: np.ndarray, bounds: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of grams, rows they belong to) of rows of texts: many short texts at a time, or a part of a long one.

    A long text is cut at white space, and its next part is told the last run before the cut.
    """
    bits = np.uint64(64 - (buckets.bit_length() - 1))
    for first, last in blocks(bounds, BLOCK_BYTES):
        at, end = int(bounds[first]), int(bounds[last])
        before = np.empty(0, np.uint64)
        while at < end:
            stop, starts = end, bounds[first:last] - at
            if last - first == 1:
                stop, starts = min(end, at + BLOCK_BYTES), np.zeros(1, np.int64)
                while stop < end and KIND[data[stop]]:
                    stop += 1
            one, row = runs(data[at:stop], starts)
            chain, rows = np.concatenate([before, one]), np.concatenate([row[:1], row]) if len(before) else row
            two = mixed(chain[:-1] * np.uint64(3) + chain[1:])
            same = rows[1:] == rows[:-1]
            found = (np.concatenate([one, two[same]]) >> bits).astype(np.int64)
            yield found, np.concatenate([row, rows[1:][same]]) + first
            before, at = one[-1:] if len(one) else before, stop


def fit(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The log ratio of each bucket. target: doc_id of the good documents; ids that docs has not are ignored.

    With no target at all every ratio is that of the smoothing alone.
    """
    if buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    good = target.where("doc_id is not null").select("doc_id").distinct().withColumn("good", F.lit(True))
    own = packed(docs.select("doc_id", F.col("text").cast("string").alias("text"))).join(good.hint("merge"), "doc_id", "left")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            data, bounds = unpacked(batch.column("text"))
            chosen = batch.column("good").fill_null(False).to_numpy(zero_copy_only=False)
            for found, rows in grams(data, bounds, buckets):
                total[0] += np.bincount(found, minlength=buckets)
                total[1] += np.bincount(found[chosen[rows]], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), *map(pa.array, total)], names=["bucket", "raw", "good"])

    sums = own.select("text", "good").mapInArrow(count, "bucket long, raw long, good long")
    counts = np.zeros((2, buckets))
    for r in sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():
        counts[:, r["bucket"]] = r["raw"], r["good"]
    probability = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + buckets))
    return probability[1] - probability[0]


def weigh(docs: DataFrame, ratios: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight and noisy_weight (with Gumbel noise). A text without grams, or null, weighs 0."""
    spread = docs.sparkSession.sparkContext.broadcast(ratios)
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("uniform double, n_grams long, log_weight double").fields])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = spread.value
        for batch in batches:
            data, bounds = strings(batch.column("text"))
            n, weight = np.zeros(len(bounds) - 1, np.int64), np.zeros(len(bounds) - 1)
            for found, rows in grams(data, bounds, len(ratios)):
                first, size = int(rows[0]) if len(rows) else 0, int(rows.max(initial=-1)) + 1
                n[first:size] += np.bincount(rows - first, minlength=size - first)
                weight[first:size] += np.bincount(rows - first, ratios[found], size - first)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(weight)], names=schema.names)

    text = F.col("text").cast("string")
    uniform = (F.pmod(F.xxhash64("doc_id", text, F.lit(seed)), F.lit(1 << 48)) + 0.5) / float(1 << 48)
    rows = docs.select("doc_id", uniform.alias("uniform"), text.alias("text")).mapInArrow(score, schema)
    noise = -F.log(-F.log("uniform"))
    return rows.select("doc_id", "n_grams", "log_weight", (F.col("log_weight") + noise).alias("noisy_weight"))


def resample(docs: DataFrame, target: DataFrame, share: float, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """Every document with n_grams, log_weight, noisy_weight, rank (from 1) and selected: the floor(share * n) first.

    Repeated rows are rows of their own; ties are ordered by doc_id and then freely. An empty table gives an empty one.
    """
    marked = written(weigh(docs, fit(docs, target, buckets), seed), "marks")
    order = [F.col("noisy_weight").desc(), F.col("doc_id")]
    dealt = written(marked.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "weights")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    bases = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    limit = int(share * dealt.count())
    rank = F.col("base") + F.row_number().over(Window.partitionBy("range").orderBy(*order))
    ranked = dealt.join(bases, "range").withColumn("rank", rank.cast("long"))
    return ranked.select("doc_id", "n_grams", "log_weight", "noisy_weight", "rank", (F.col("rank") <= limit).alias("selected"))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Target: documents labelled good and not toxic. As large a part is kept as is labelled good."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    share = labels.agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0] or 0.0
    return resample(table(spark, sf_dir, "documents"), labels.where("quality = 1 and toxic = 0").select("doc_id"), share)
