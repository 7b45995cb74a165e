"""Best-fit packing: documents as token pieces in sequences of a fixed size.

Best-fit decreasing puts each piece, longest first, into the fullest sequence that still has room for it. Pieces of one
length are alike, so the whole run follows from how many pieces there are of each length: at most `size` numbers, whatever
the corpus. A segment tree over the remaining capacities, with the number of open sequences at each, finds the tightest
one in logarithmic time, and a whole run of equal pieces goes into a run of equal sequences at once. The driver makes that
plan from the counts; each piece finds its place in it by its length and its rank among pieces of its length, which comes
from prefix sums over the tasks that cut the texts.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import strings, table, written
from tokenledger.llm.word_tokens import loaded

SIZE = 4096
SEPARATOR = 1


class Capacities:
    """A segment tree that counts open sequences by what room they have left."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room of an open sequence that is `need` or more."""
        at = self.leaves + need
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.count[2 * at] else 2 * at + 1
                return at - self.leaves
            at >>= 1
        return None


def plan(counts: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """Best-fit decreasing over `counts` (length: number of pieces).

    Returns runs, ordered by length and rank: the pieces of `length` from rank `rank` on go into the sequences from
    `sequence` on, `each` to a sequence, the first of them at offset `offset`.
    """
    tree, open_, runs, made = Capacities(size), defaultdict(list), [], 0

    def opened(room: int, first: int, n: int) -> None:
        if room and n:
            open_[room].append((first, n))
            tree.add(room, n)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens does not fit into {size}")
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, n = size, made, -(-left // (size // length))
                made += n
            else:
                first, n = open_[room].pop()
                tree.add(room, -n)
            each = room // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, first, each, size - room))
                opened(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n:
                if left and left < each:
                    runs.append((length, rank, first + full, left, size - room))
                    opened(room - left * length, first + full, 1)
                    full, left = full + 1, 0
                opened(room, first + full, n - full)
    table_ = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "each", "offset"), table_.T))


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Each document's token ids and the separator, cut into pieces of `size`; the last may be shorter.

    Columns doc_id, piece, start, length, ids_crc32 (over little-endian 32-bit ids), and ids if asked for. A null or empty
    text is one piece: the separator. Rows with one doc_id are documents of their own.
    """
    return _cut(docs, tokenizer, size, separator, with_ids).drop("task", "rank_in_task")


def _cut(docs: DataFrame, tokenizer: str, size: int, separator: int, with_ids: bool) -> DataFrame:
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType())]
        + [T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())]
        + [T.StructField("task", T.IntegerType()), T.StructField("rank_in_task", T.LongType())]
        + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])
    )

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = loaded(tokenizer), TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            data, bounds = strings(batch.column(1))
            ids, starts = words.encode(data, bounds)
            ids = np.insert(ids.astype("<u4"), starts[1:], separator)
            starts = starts + np.arange(len(starts))
            total = np.diff(starts)
            n = -(-total // size)
            doc = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * size
            length = np.minimum(size, total[doc] - start)
            at, raw = starts[doc] + start, memoryview(ids.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist())]
            rank = _rank_within(length, seen)
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start)]
            columns += [pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int32)), pa.array(rank)]
            if with_ids:
                bounds32 = np.append(at, starts[-1]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(bounds32), pa.array(ids.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, schema)


def _rank_within(length: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each entry's rank among equal ones, going on from `seen`, which is brought up to date."""
    order = np.argsort(length, kind="stable")
    ordered = length[order]
    first = np.searchsorted(ordered, ordered)
    rank = np.empty(len(length), np.int64)
    rank[order] = np.arange(len(length)) - first + seen[ordered]
    seen += np.bincount(length, minlength=len(seen))
    return rank


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """The pieces of `docs`, each with its sequence_id and its offset in the sequence.

    Null and empty texts are pieces of one token; documents with one doc_id, equal texts and ties in length are placed one
    by one. An empty table gives an empty one. What goes to the driver is a count for each length, `size` at most, and
    the plan that goes back is bounded by the size, not by the documents.
    """
    cut = written(_cut(docs, tokenizer, size, separator, with_ids), "pieces")
    tasks = cut.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = written(tasks.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    runs = plan({r["length"]: r["n"] for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()}, size)
    spread = docs.sparkSession.sparkContext.broadcast(runs)
    ranked = cut.join(tasks.select("length", "task", "base").hint("merge"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("rank_in_task"))
    kept = ranked.drop("task", "rank_in_task", "base")
    out = T.StructType([f for f in kept.schema if f.name != "rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = spread.value
        key = runs["length"] << 44 | runs["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = np.searchsorted(key, length << 44 | rank, "right") - 1
            ahead = rank - runs["rank"][run]
            sequence = runs["sequence"][run] + ahead // runs["each"][run]
            offset = runs["offset"][run] + ahead % runs["each"][run] * length
            columns = [batch.column(name) for name in out.names[:-2]] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return kept.mapInArrow(place, out)


def sequences(packed: DataFrame) -> DataFrame:
    """The token ids of each sequence, from `pack(..., with_ids=True)`. A sequence holds `size` tokens at most."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.doc_id").alias("doc_ids")
    )


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
