"""Exact top-k search by inner product: tiles of queries times shards, a partial selection per tile, and a merge tree.

Queries and candidates are packed into matrices of a few megabytes, rows in order of their ids. Every pair of a query
matrix and a candidate matrix is a tile, one row of a join on the tile's number, so tiles spread over the cluster however
many there are and nothing is broadcast. A tile is multiplied block by block and gives the best k + 1 of each query; the
lists of a query are merged a few dozen at a time, level by level, so that no merge sees more than a bounded list.

A query is not its own candidate, but an equal row is. So one entry more than asked for is kept all the way, and in the end
the entry that looks like the query's own row (its id and its product with itself) goes, or else the last one.

Components are whole numbers. They are multiplied as doubles if no sum can pass 2^53, as 64-bit integers if none can
pass 2^63, and else as Python integers, so products are exact; a score outside 64 bits counts as the end that it passed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm.common import table, written

SCALE = 1024
TOP = 10
#: Ids that are divisible by this are queries.
EVERY = 100
#: Bytes of a packed matrix, and rows of one at most.
MATRIX_BYTES, MATRIX_ROWS = 4 << 20, 1 << 15
#: Queries and candidates of a block of a tile.
BLOCK_QUERIES, BLOCK_ROWS = 256, 8192
#: Lists of a query that are merged at a time.
FAN_IN = 32
MATRIX = "shard long, n long, width long, wide long, ids binary, nulls binary, own binary, data binary"
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _packed(vectors: DataFrame, limit: int) -> DataFrame:
    """Matrices of the valid vectors of `vectors` (id, v, own): own numbers the row, ids are sorted with nulls last."""

    def matrix(ids, nulls, own, data) -> pa.RecordBatch:
        ids, nulls, own, data = (np.concatenate(x) for x in (ids, nulls, own, data))
        order = np.lexsort((own, ids, nulls))
        largest = np.abs(data).max(initial=0)
        kind = "<i2" if largest < 1 << 15 else "<i4" if largest < 1 << 31 else "<f8"
        data = np.ascontiguousarray(data[order].astype(kind))
        raw = [ids[order].astype("<i8").tobytes(), nulls[order].tobytes(), own[order].astype("<i8").tobytes(), data.tobytes()]
        numbers = [len(ids), data.shape[1], data.dtype.itemsize]
        columns = [*(pa.array([x], pa.int64()) for x in numbers), *(pa.array([x], pa.binary()) for x in raw)]
        return pa.RecordBatch.from_arrays(columns, names=["n", "width", "wide", "ids", "nulls", "own", "data"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            id_, vector, own = batch.columns
            value = vector.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            size = vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.append(0, np.cumsum(size))
            nulls = id_.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
            ids, own = id_.fill_null(0).to_numpy().astype(np.int64), own.to_numpy().astype(np.int64)
            for width in np.unique(size).tolist():
                rows = np.flatnonzero(size == width)
                most = min(limit, max(1, MATRIX_BYTES // (8 * max(width, 1))))
                for at in range(0, len(rows), most):
                    some = rows[at : at + most]
                    data = value[start[some][:, None] + np.arange(width)]
                    with np.errstate(over="ignore"):
                        data = np.floor(data * SCALE)
                    good = np.isfinite(data).all(axis=1)
                    own_ = held.setdefault(width, [[], [], [], [], 0])
                    for column, more in zip(own_, (ids[some], nulls[some], own[some], data)):
                        column.append(more[good])
                    own_[4] += int(good.sum())
                    if own_[4] >= most:
                        yield matrix(*held.pop(width)[:4])
        for *columns, n in held.values():
            if n:
                yield matrix(*columns)

    rest = MATRIX.split(", ", 1)[1]
    shards = vectors.mapInArrow(pack, rest).withColumn("shard", F.monotonically_increasing_id())
    return written(shards.select("shard", *(c.split()[0] for c in rest.split(", "))), "matrices")


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    kind = {2: "<i2", 4: "<i4", 8: "<f8"}[row["wide"]]
    data = np.frombuffer(row["data"], kind).reshape(row["n"], row["width"])
    return np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], np.uint8), np.frombuffer(row["own"], "<i8"), data


def _largest(data: np.ndarray) -> int:
    return int(np.abs(data.astype(np.float64)).max(initial=0))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, exactly or as an end of 64 bits; components that one side lacks count as zero."""
    width = min(queries.shape[1], rows.shape[1])
    queries, rows = queries[:, :width], rows[:, :width]
    bound = width * _largest(queries) * _largest(rows)
    if bound < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if bound < 1 << 63:
        return queries.astype(np.int64) @ rows.T.astype(np.int64)
    whole = [[[int(x) for x in row] for row in side.tolist()] for side in (queries, rows)]
    return np.array([[min(HIGH, max(LOW, sum(map(int.__mul__, q, r)))) for r in whole[1]] for q in whole[0]], np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest of each row, of equal ones those further left; by a partial selection."""
    n = scores.shape[1]
    if n <= k:
        row, column = np.divmod(np.arange(scores.size), n)
        return row, column
    bits = (n - 1).bit_length()
    if max(abs(int(scores.max())), abs(int(scores.min()))) < 1 << (62 - bits):
        ranked = (scores << bits) + (n - 1 - np.arange(n))
        column = np.argpartition(ranked, n - k, axis=1)[:, n - k :]
        return np.repeat(np.arange(len(scores)), k), column.ravel()
    order = np.argsort(~scores, axis=1, kind="stable")[:, :k]
    return np.repeat(np.arange(len(scores)), k), order.ravel()


def _tiles(queries: DataFrame, shards: DataFrame, k: int) -> DataFrame:
    """own, query_id, self, shard, id and score of the k best of each query in each tile."""
    names = [c.split()[0] for c in MATRIX.split(", ")]
    spark = shards.sparkSession
    buckets = max(1, min(shards.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    # Each candidate matrix moves once, to one bucket; every bucket gets all query matrices.
    right = shards.withColumn("bucket", F.pmod(F.xxhash64("shard"), F.lit(buckets)).cast("int"))
    left = queries.select(*(F.col(n).alias(f"q_{n}") for n in names))
    left = left.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = ["own", "query_id", "self", "shard", "id", "score"]

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                cells = {n: batch.column(n)[row].as_py() for n in batch.schema.names}
                ids, nulls, _, rows = _matrix(cells)
                query_ids, _, own, asked = _matrix({n: cells[f"q_{n}"] for n in names})
                for at in range(0, len(asked), BLOCK_QUERIES):
                    part = asked[at : at + BLOCK_QUERIES]
                    selves = [sum(int(x) * int(x) for x in q) for q in part.tolist()]
                    found: list[list[np.ndarray]] = [[], [], []]
                    for low in range(0, len(rows), BLOCK_ROWS):
                        scores = products(part, rows[low : low + BLOCK_ROWS])
                        query, column = best(scores, k)
                        for own_, more in zip(found, (query, column + low, scores[query, column])):
                            own_.append(more)
                    query, column, score = (np.concatenate(x) for x in found)
                    if len(rows) > BLOCK_ROWS:  # the lists of the blocks to one for the tile
                        order = np.lexsort((column, ~score, query))
                        rank = np.arange(len(order)) - np.searchsorted(query[order], query[order])
                        order = order[rank < k]
                        query, column, score = query[order], column[order], score[order]
                    self_ = np.array([min(HIGH, x) for x in selves], np.int64)[query]
                    arrays = [pa.array(own[at:][query]), pa.array(query_ids[at:][query]), pa.array(self_)]
                    arrays += [pa.array(np.full(len(query), cells["shard"])), pa.array(ids[column], mask=nulls[column] == 1)]
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(score)], names=out)

    pairs = right.join(left.hint("merge"), "bucket").drop("bucket")
    return pairs.mapInArrow(multiply, ", ".join(f"{n} long" for n in out))


def _merged(lists: DataFrame, k: int, matrices: int) -> DataFrame:
    """The k best of each query: the lists of FAN_IN parts are merged to one, level by level."""
    parts = 1
    while parts * FAN_IN < matrices:
        parts *= FAN_IN
    lists = lists.withColumn("part", F.pmod(F.xxhash64("shard"), F.lit(parts))).drop("shard")
    while True:
        order = Window.partitionBy("own", "part").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        lists = lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if parts == 1:
            return lists.drop("part")
        parts //= FAN_IN
        lists = lists.drop("rank").withColumn("part", F.pmod("part", F.lit(parts)))


def top_products(
    vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", k: int = TOP, every: int = EVERY
) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose id is divisible by `every`.

    Vectors that are null or hold a component that is null or not finite, also after scaling, take no part. Ties go to the
    smaller id, a null id last; a row without id is a candidate, but no query. Each row is a query or candidate of its own,
    also if another has its id or is equal. Where lengths differ, missing components count as zero. Fewer than k
    candidates give all of them, an empty table none.
    """
    whole = vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    whole = whole.where("v IS NOT NULL")
    queries = written(whole.where(F.col("id") % every == 0).withColumn("own", F.monotonically_increasing_id()), "queries")
    asked = _packed(queries, MATRIX_ROWS)
    shards = _packed(whole.withColumn("own", F.lit(0).cast("long")), MATRIX_ROWS)
    lists = written(_tiles(asked, shards, k + 1), "lists")
    merged = _merged(lists, k + 1, shards.count())
    mine = (F.col("id") == F.col("query_id")) & (F.col("score") == F.col("self"))
    of_query = Window.partitionBy("own")
    gone = F.coalesce(F.min(F.when(mine, F.col("rank"))).over(of_query), F.lit(k + 1))
    ranked = merged.withColumn("gone", gone).where(F.col("rank") != F.col("gone"))
    rank = F.col("rank") - F.when(F.col("rank") > F.col("gone"), 1).otherwise(0)
    return ranked.select("query_id", rank.cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def op11_exact_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH whole AS (
  SELECT vec_id, row_number() OVER () AS row,
         list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.row <> q.row WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= {TOP}"""
