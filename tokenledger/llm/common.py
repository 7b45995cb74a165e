"""Helpers that several operators share: tables, Arrow strings, blocks of rows, scratch tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tokenledger.session import scratch_dir

#: Bytes of one Arrow batch on its way to Python; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
#: Rows of one batch.
BATCH_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, with Arrow batches of bounded size for what follows."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def written(df: DataFrame, purpose: str) -> DataFrame:
    """`df` as a table in the shared folder: read again, it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = scratch_dir(spark, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each row starts in them (one entry more than rows); null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def blocks(bounds: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows, each of at most `limit` bytes or of one row."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def packed(docs: DataFrame) -> DataFrame:
    """docs with the text compressed, for a shuffle."""

    def press(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            data, bounds = strings(batch.column("text"))
            small = pa.array([press.compress(data[a:b].tobytes()) for a, b in zip(bounds, bounds[1:])], pa.binary())
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", small)

    schema = T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in docs.schema])
    return docs.mapInArrow(press, schema)


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Like `strings`, for a column of compressed texts."""
    press = zstandard.ZstdDecompressor()
    texts = [press.decompress(x) for x in column.to_pylist()]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds
