"""Token-ID output: flat files of unsigned integers with 64-bit document offsets.

Documents go in ascending doc_id order. Each task writes the files of one range of ids: `.bin` with the ids of its
documents one after another (16 bits each if the vocabulary allows, else 32), `.idx` with 64-bit offsets of its documents
in `.bin`, one more than documents, and `.docs`, an Arrow file of their doc_ids. File names are new for each attempt of a task, and
only those of attempts that succeeded are in the manifest, so a lost executor leaves nothing that is read. The manifest's
prefix sums are the bases: the number of ids and documents before a part.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import strings, table
from tokenledger.llm.word_tokens import loaded
from tokenledger.session import scratch_dir

END = 2
#: Ids that a reader works on at a time.
READ_IDS = 1 << 20

MANIFEST = "part int, file string, documents long, ids long, width int"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END) -> None:
    """Writes `docs` (doc_id, text) under `folder`, which all executors must reach.

    A null or empty text is the end id alone. Rows with one doc_id stay rows of their own, ordered by text; a null doc_id
    comes first. An empty table gives a manifest without documents.
    """
    spark = docs.sparkSession

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = loaded(tokenizer), TaskContext.get().partitionId()
        fs, base = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name, documents, ids_before = f"{task:06d}-{uuid.uuid4().hex}", 0, 0
        doc_file = None
        with fs.open_output_stream(f"{base}/{name}.bin") as ids_out, fs.open_output_stream(f"{base}/{name}.idx") as idx_out:
            idx_out.write(np.zeros(1, "<i8").tobytes())
            for batch in batches:
                ids, starts = words.encode(*strings(batch.column(1)))
                ids_out.write(np.insert(ids, starts[1:], end_id).tobytes())
                ends = starts[1:] + np.arange(1, len(starts))
                idx_out.write((ends + ids_before).astype("<i8").tobytes())
                own = pa.RecordBatch.from_arrays([batch.column(0)], names=["doc_id"])
                if doc_file is None:
                    sink = fs.open_output_stream(f"{base}/{name}.docs")
                    doc_file = pa.ipc.new_file(sink, own.schema)
                doc_file.write_batch(own)
                documents += len(own)
                ids_before += int(ends[-1]) if len(ends) else 0
        if doc_file is not None:
            doc_file.close()
            sink.close()
            row = {"part": [task], "file": [name], "documents": [documents], "ids": [ids_before], "width": [words.dtype.itemsize]}
            kinds = pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("width", pa.int32())])
            yield pa.RecordBatch.from_pydict(row, kinds)

    own = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    ordered = own.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row for each part, with the number of ids and documents before it. There is a row for each task that wrote."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    base = {f"{name}_before": F.coalesce(F.sum(name).over(before), F.lit(0)) for name in ("ids", "documents")}
    return found.withColumns(base)


def read_token_files(spark: SparkSession, folder: str, id_type: T.DataType = T.LongType(), with_ids: bool = False) -> DataFrame:
    """One row for each document, read back from the files: doc_id, start, n_tokens, ids_crc32, and ids if asked for."""
    schema = T.StructType(
        [T.StructField("doc_id", id_type)]
        + [T.StructField(name, T.LongType()) for name in ("start", "n_tokens", "ids_crc32")]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pa.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(fs, f"{base}/{row['file']}", row["ids_before"], np.dtype(f"<u{row['width']}"), schema.names)

    parts = manifest(spark, folder).select("file", "ids_before", "width")
    return parts.repartition(spark.sparkContext.defaultParallelism * 4).mapInArrow(read, schema)


def mapped(fs: pa.fs.FileSystem, path: str, dtype: np.dtype) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local, else fetched."""
    if fs.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(fs, pa.fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def _documents(fs: pa.fs.FileSystem, path: str, before: int, dtype: np.dtype, names: list[str]) -> Iterator[pa.RecordBatch]:
    ids, offsets = mapped(fs, f"{path}.bin", dtype), mapped(fs, f"{path}.idx", np.dtype("<i8"))
    with fs.open_input_file(f"{path}.docs") as f:
        doc_ids = pa.ipc.open_file(f).read_all().column(0).combine_chunks()
    first = 0
    while first < len(doc_ids):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + READ_IDS, "right")) - 1)
        last = min(last, len(doc_ids))
        bounds = offsets[first : last + 1] - offsets[first]
        own = np.asarray(ids[offsets[first] : offsets[last]], "<u4")
        raw = memoryview(own.tobytes())
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        columns = [doc_ids.slice(first, last - first), pa.array(offsets[first:last] + before), pa.array(np.diff(bounds)), pa.array(crc, pa.int64())]
        if len(names) > 4:
            columns.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(own.astype(np.int32))))
        yield pa.RecordBatch.from_arrays(columns, names=names)
        first = last


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), scratch_dir(spark, "token-files")
    write_token_files(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, docs.schema["doc_id"].dataType)
