"""Where the keys of a table are: a side table of (key, part), bucketed by a hash of the key.

An upsert reads the buckets that its own keys fall into, and no other, to learn which parts hold older rows of them. It
adds a row for each key that is new or has moved; the versions of a bucket are gathered when there are many. The lists
of a bucket's versions lie in the record of the table itself, so table and index change together.

A row with `reset` supersedes all earlier ones of its key. A bulk append adds rows without it, since it may give a key a
second part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.operators.versions import GATHER, Parts, Versions
from tokenledger.schemas import TableSpec

BUCKET = "bucket"


class KeyIndex:
    def __init__(self, spark: SparkSession, path: str, spec: TableSpec, buckets: int):
        self.keys, self.buckets = list(spec.keys), buckets
        self.files = Versions(spark, path, BUCKET)
        keys = [spec.schema[k] for k in self.keys]
        text = T.StringType()
        more = [("part", text), ("seq", T.LongType()), ("reset", T.BooleanType()), ("before", T.ArrayType(text)), (BUCKET, T.IntegerType())]
        self.schema = T.StructType([*keys, *(T.StructField(n, t) for n, t in more)])

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[str]:
        """The bucket folders of some keys: at most as many values as there are buckets."""
        return [f"{BUCKET}={r[0]}" for r in rows.select(self.bucket()).distinct().collect()]

    def entries(self, versions: Parts, folders: Sequence[str]) -> DataFrame:
        return self.files.read(self.schema, {f: versions.get(f, []) for f in folders})

    def where(self, entries: DataFrame) -> DataFrame:
        """Each key with the parts that may hold rows of it."""
        seen = entries.groupBy(*self.keys).agg(
            F.max(F.when(F.col("reset"), F.col("seq"))).alias("since"), F.collect_set(F.struct("seq", "part")).alias("all")
        )
        live = F.filter("all", lambda e: F.col("since").isNull() | (e["seq"] >= F.col("since")))
        return seen.select(*self.keys, F.array_distinct(F.transform(live, lambda e: e["part"])).alias("parts"))

    def holding(self, versions: Parts, rows: DataFrame) -> list[str]:
        """The parts that may hold rows of the keys of `rows`: at most as many values as the table has parts."""
        entries = self.entries(versions, self.touched(rows)).join(rows.select(*self.keys).distinct(), self.keys, "left_semi")
        return [r[0] for r in self.where(entries).select(F.explode("parts")).distinct().collect()]

    def _shaped(self, rows: DataFrame, seq: int, reset: bool, before: Column) -> DataFrame:
        columns = [F.lit(seq).cast("long").alias("seq"), F.lit(reset).alias("reset"), before.cast("array<string>").alias("before")]
        return rows.select(*self.keys, "part", *columns, self.bucket().alias(BUCKET))

    def _add(self, versions: Parts, rows: DataFrame, folders: Sequence[str], seq: int) -> tuple[str, Parts]:
        """Write rows, together with those of buckets that have become many versions."""
        many = [f for f in folders if len(versions.get(f, [])) >= GATHER]
        if many:
            live = self.where(self.entries(versions, many)).select(*self.keys, F.explode("parts").alias("part"))
            rows = rows.unionByName(self._shaped(live, seq - 1, False, F.array()))
        version, filled = self.files.write(rows, seq)
        return version, versions | {f: [*([] if f in many else versions.get(f, [])), version] for f in filled}

    def moved(self, versions: Parts, rows: DataFrame, seq: int) -> tuple[Parts, list[str]]:
        """Put the keys of `rows` (key and part, one row a key) where they are now; also the parts that they leave."""
        folders = self.touched(rows)
        entries = self.entries(versions, folders).join(rows.select(*self.keys), self.keys, "left_semi")
        known = rows.join(self.where(entries), self.keys, "left")
        changed = known.where(F.col("parts").isNull() | (F.col("parts") != F.array("part")))
        before = F.coalesce(F.array_except("parts", F.array("part")), F.array().cast("array<string>"))
        version, versions = self._add(versions, self._shaped(changed, seq, True, before), folders, seq)
        written = self.files.read(self.schema, {f: [version] for f in folders if version in versions.get(f, [])})
        left = written.where(F.col("seq") == seq).select(F.explode("before")).distinct().collect()
        return versions, [r[0] for r in left]

    def added(self, versions: Parts, rows: DataFrame, seq: int, reset: bool = False) -> Parts:
        """Add keys of `rows` (key and part) without asking where they were."""
        rows = rows.select(*self.keys, "part").distinct()
        return self._add(versions, self._shaped(rows, seq, reset, F.array()), self.touched(rows), seq)[1]
