"""Running sums along ordered groups, where one group may hold any part of the rows.

Rows are range-partitioned by (key, order) and sorted, so a long group lies in several partitions one after another. Each
partition sums its own part and ends with the sums of its first and last group; these two rows a partition go to the
driver, which adds up what reaches each partition from those before it, and a second pass adds that to its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import written

WRAP = (1 << 64) - 1


def power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base to the exponents, modulo 2^64."""
    out, exponent = np.ones(len(exponent), np.uint64), exponent.astype(np.uint64)
    while exponent.any():
        out *= np.where(exponent & np.uint64(1), np.uint64(base), np.uint64(1))
        base, exponent = base * base & WRAP, exponent >> np.uint64(1)
    return out


def running(rows: DataFrame, key: str, order: Sequence[str], sums: Mapping[str, tuple[str, int]]) -> DataFrame:
    """`rows`, all of whose columns are longs and whose key is never null, as a written table with more columns:

    `n`, the row's place in its group from 1 on, and for each name in `sums`, given as (column, base), the sum of column *
    base^(n - 1) over the group up to the row, modulo 2^64. Nulls order first. Rows that are equal in `order` follow each
    other in any order.
    """
    columns, names = rows.columns, list(sums)
    fields = [*columns, "n", *names, "__part", "__edge"]
    schema = T.StructType([T.StructField(f, T.LongType()) for f in fields])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = now = None  # (key, n, sums): the first group of the partition once it has ended, and the latest
        for batch in batches:
            keys = batch.column(columns.index(key)).to_numpy()
            if not len(keys):
                continue
            new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            start = np.repeat(new, np.diff(np.append(new, len(keys))))
            n = np.arange(len(keys)) - start + 1
            goes_on = now is not None and now[0] == keys[0]
            if goes_on:
                n[: new[1] if len(new) > 1 else len(n)] += now[1]
            out = []
            for i, (column, base) in enumerate(sums.values()):
                value = batch.column(columns.index(column)).to_numpy().astype(np.uint64)
                total = np.cumsum(value * power(base, n - 1))
                total -= np.where(start > 0, total[start - 1], np.uint64(0))
                if goes_on:
                    total[: new[1] if len(new) > 1 else len(n)] += np.uint64(now[2][i])
                out.append(total)
            ends = [0] if len(new) > 1 else []
            if first is None and now is not None and (not goes_on or ends):
                first = now if not goes_on else (now[0], int(n[new[1] - 1]), [int(t[new[1] - 1]) for t in out])
            elif first is None and ends:
                first = (int(keys[0]), int(n[new[1] - 1]), [int(t[new[1] - 1]) for t in out])
            now = (int(keys[-1]), int(n[-1]), [int(t[-1]) for t in out])
            more = [pa.array(n), *(pa.array(t.astype(np.int64)) for t in out)]
            edge = [pa.array(np.full(len(n), part)), pa.array(np.zeros(len(n), np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more, *edge], names=fields)
        if now is not None:
            yield from (edge_row(part, i, group) for i, group in ((1, first or now), (2, now)))

    def edge_row(part: int, which: int, group: tuple) -> pa.RecordBatch:
        value = {key: group[0], "n": group[1], "__part": part, "__edge": which}
        value |= {name: (x ^ 1 << 63) - (1 << 63) for name, x in zip(names, group[2])}
        return pa.RecordBatch.from_arrays([pa.array([value.get(f)], pa.int64()) for f in fields], names=fields)

    placed = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(key, *order)
    partial = written(placed.mapInArrow(add, schema), "running")
    edges: dict[int, dict[int, tuple]] = {}
    for row in partial.where("__edge > 0").collect():  # two rows a partition
        group = (row[key], row["n"], [row[name] & WRAP for name in names])
        edges.setdefault(row["__part"], {})[row["__edge"]] = group
    bases, carries, before = [base for _, base in sums.values()], {}, None
    for part in sorted(edges):
        first, last = edges[part][1], edges[part][2]
        if before is not None and before[0] == first[0]:
            carries[part] = before
            if last[0] == first[0]:
                total = [b + pow(x, before[1], 1 << 64) * t & WRAP for b, x, t in zip(before[2], bases, last[2])]
                last = (last[0], before[1] + last[1], total)
        before = last
    kept = partial.where("__edge = 0").drop("__edge")
    if not carries:
        return kept.drop("__part")

    def carry(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f: batch.column(batch.schema.get_field_index(f)) for f in fields[:-1]}
            keys, parts, n = (column[f].to_numpy() for f in (key, "__part", "n"))
            n, total = n.copy(), {name: column[name].to_numpy().astype(np.uint64) for name in names}
            for part in np.unique(parts).tolist():
                if part in carries:
                    to, count, so_far = carries[part]
                    at = np.flatnonzero((parts == part) & (keys == to))
                    n[at] += count
                    for name, base, more in zip(names, bases, so_far):
                        total[name][at] = total[name][at] * np.uint64(pow(base, count, 1 << 64)) + np.uint64(more)
            columns_ = [*(column[f] for f in columns), pa.array(n), *(pa.array(total[x].astype(np.int64)) for x in names)]
            yield pa.RecordBatch.from_arrays(columns_, names=fields[:-2])

    return written(kept.mapInArrow(carry, T.StructType(schema.fields[:-2])), "carried")
