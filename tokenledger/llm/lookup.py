"""A join with a table of unique keys that no key of the other side can make heavy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenledger.llm.common import written

#: A key with more than one in so many rows is heavy; there are fewer heavy keys than this, so they can be broadcast.
HEAVY = 1000


def lookup(
    rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", counts: DataFrame | None = None
) -> DataFrame:
    """`rows`, a written table, joined (inner or left) with the one row at most that `table` has for a key without nulls.

    `counts` may give the rows of each key as n, if they are known, at least for keys with many.

    Rows of heavy keys stay where they are and meet a broadcast of fewer than HEAVY rows. All others go through a
    sort-merge join in which no key has more than a HEAVY-th of the rows.
    """
    on = list(on)
    total = rows.count()
    if counts is None:
        counts = rows.groupBy(*on).agg(F.count("*").alias("n"))
    heavy = written(counts.where(F.col("n") * HEAVY > total).select(*on), "heavy")
    if heavy.isEmpty():
        return rows.join(table.hint("merge"), on, how)
    few = table.join(F.broadcast(heavy), on, "left_semi")
    rest = rows.join(F.broadcast(heavy), on, "left_anti").join(table.hint("merge"), on, how)
    return rows.join(F.broadcast(heavy), on, "left_semi").join(F.broadcast(few), on, how).union(rest)
