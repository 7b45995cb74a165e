"""Sharding by sampled splitters, in DataFrame operations only.

Rows are ordered by (hash of the text, range, row number), so equal texts lie next to each other. A sample that prefers large
rows gives splitters that cut this order into many ranges of about equal weight; a group of equal texts that takes several
splitters is dealt over as many ranges of its own by a hash of the row number. Ranges are counted exactly, and those that
came out overfull are subdivided by a sample of their own. Each range is sorted on its own, and prefix sums over the ranges
give every row its exact place among all bytes; a shard is a stretch of total / shards bytes of that. So the sample decides
how the work is spread, and never how the shards come out.

A shard boundary that falls into a group of equal texts moves to the nearer end of the group if the group is small
against a shard (`whole_share`), however many ranges the group takes; a larger group is subdivided at the boundary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenledger.llm.common import table, written

SHARDS = 16
#: Groups up to this part of a shard stay whole.
WHOLE_SHARE = 0.02
#: Rows of a range to aim at, and the least and greatest number of ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 50_000, 256, 65_536
#: Sampled rows for each range.
OVERSAMPLE = 16
#: Ranges of more than this many times the mean weight are subdivided, in at most so many rounds.
OVERFULL, ROUNDS = 3, 3


def drawn(rows: DataFrame, ranges: int, total: int, n: int, seed: str = "sample") -> dict[int, int]:
    """Quantiles of a sample of keys, each row drawn in proportion to its part of all bytes and of all rows.

    Gives the hashes that a range starts at, and how many quantiles fall on each. The sample has about ranges * OVERSAMPLE
    keys for the whole table, whatever the number of rows, and as much less for a part of it.
    """
    weight = (F.col("size") / F.lit(total) + F.lit(1 / n)) / 2 * ranges * OVERSAMPLE
    uniform = F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.select("hash", F.floor(weight + uniform).alias("times")).where("times > 0")
    marks, at = {}, 0
    for hash_, times in sorted((r["hash"], r["times"]) for r in sample.collect()):
        if passed := (at + times) // OVERSAMPLE - at // OVERSAMPLE:
            marks[hash_] = marks.get(hash_, 0) + passed
        at += times
    return marks


def lookup(spark: SparkSession, marks: dict[int, int]) -> DataFrame:
    """The splitters as a table: for each stretch of hashes, the range it starts in and the splitters inside.

    A splitter has a hash, its first range, the number of ranges its own group takes, and the range of what follows. The
    table has about as many rows as there are splitters, so it may be broadcast.
    """
    bits = max(1, len(marks).bit_length())
    inside: list[list[tuple[int, int, int, int]]] = [[] for _ in range(1 << bits)]
    starts, following = [0] * (1 << bits), 0
    for hash_ in sorted(marks):
        pieces = marks[hash_]
        first, following = following + 1, following + (1 if pieces == 1 else pieces + 1)
        inside[(hash_ >> (64 - bits)) + (1 << (bits - 1))].append((hash_, first, pieces, following))
    for i in range(1, 1 << bits):
        starts[i] = inside[i - 1][-1][3] if inside[i - 1] else starts[i - 1]
    schema = "stretch long, start int, splitters array<struct<hash: long, first: int, pieces: int, following: int>>"
    return spark.createDataFrame([(i, starts[i], inside[i]) for i in range(1 << bits)], schema)


def placed_in(rows: DataFrame, marks: dict[int, int]) -> DataFrame:
    """Rows with their `range` and, for a group that is dealt over several ranges, the first of these as `head`."""
    bits = max(1, len(marks).bit_length())
    stretch = F.shiftright("hash", 64 - bits) + F.lit(1 << (bits - 1))
    found = rows.withColumn("stretch", stretch.cast("long")).join(F.broadcast(lookup(rows.sparkSession, marks)), "stretch")
    last = F.try_element_at(F.filter("splitters", lambda x: x["hash"] <= F.col("hash")), F.lit(-1))
    found = found.withColumn("last", last)
    own = (F.col("last.hash") == F.col("hash")) & (F.col("last.pieces") > 1)
    piece = F.col("last.first") + F.pmod(F.xxhash64("row", F.lit("piece")), F.col("last.pieces"))
    range_ = F.when(F.col("last").isNull(), F.col("start")).when(own, piece).otherwise(F.col("last.following"))
    return found.select(*rows.columns, range_.cast("int").alias("range"), F.when(own, F.col("last.first")).alias("head"))


def subdivided(rows: DataFrame, ranges: int, total: int, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows in ranges of at most OVERFULL times the mean weight, as far as single rows allow, and the sums of the ranges."""
    marks = drawn(rows, ranges, total, n)
    weight = (F.col("range_size") / F.lit(total) + F.col("range_rows") / F.lit(n)) / 2 * ranges
    for again in range(ROUNDS + 1):
        placed = placed_in(rows, marks)
        sums = placed.groupBy("range", "head").agg(F.sum("size").alias("range_size"), F.count("*").alias("range_rows"))
        sums = written(sums, "ranges")
        overfull = sums.where((weight > OVERFULL) & (F.col("range_rows") > 1)).select("range")
        if again == ROUNDS or overfull.isEmpty():
            return placed, sums
        crowded = placed.join(F.broadcast(overfull), "range", "left_semi")  # at most ranges / OVERFULL rows
        for hash_, more in drawn(crowded, ranges, total, n, f"again {again}").items():
            marks[hash_] = marks.get(hash_, 0) + more


def shard(docs: DataFrame, shards: int = SHARDS, whole_share: float = WHOLE_SHARE, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: sizes, not keys, decide) of every document.

    A null text has size 1 and the checksum of an empty one. Rows with one doc_id, and equal rows, are rows of their own.
    An empty table gives an empty one; fewer rows than shards leave some shards empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "sizes")  # from here on the row numbers stay
    of_all = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("total")).first()
    n, total = of_all["n"], of_all["total"]
    ranges = ranges or min(MOST_RANGES, max(LEAST_RANGES, n // RANGE_ROWS))
    if not n:
        placed = rows.select("*", F.lit(0).alias("range"), F.lit(None).cast("int").alias("head"))
        sums = placed.groupBy("range", "head").agg(F.sum("size").alias("range_size"), F.count("*").alias("range_rows"))
    else:
        placed, sums = subdivided(rows, ranges, total, n)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    bases = sums.select(
        "range",
        F.coalesce(F.sum("range_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("range_rows").over(before), F.lit(0)).alias("rows_before"),
        "range_size",
        F.col("head").alias("of"),
    )
    # Size and start of a group that is dealt over several ranges, of which some may be empty.
    dealt = Window.partitionBy("of")
    for name, value in (("dealt_size", F.sum("range_size")), ("dealt_before", F.min("size_before"))):
        bases = bases.withColumn(name, F.when(F.col("of").isNotNull(), value.over(dealt)))
    inside = Window.partitionBy("range").orderBy("hash", "row")
    group = Window.partitionBy("range", "hash")
    running = placed.select(
        "*",
        (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("ahead"),
        (F.row_number().over(inside) - 1).alias("rank"),
    )
    grouped = running.select("*", F.min("ahead").over(group).alias("group_ahead"), F.sum("size").over(group).alias("group_size"))
    group_size = F.coalesce("dealt_size", "group_size")
    group_before = F.coalesce("dealt_before", F.col("size_before") + F.col("group_ahead"))
    whole = group_size <= F.lit(whole_share * total / shards)
    own = 2 * (F.col("size_before") + F.col("ahead")) + F.col("size")
    middle = F.when(whole, 2 * group_before + group_size).otherwise(own).cast("decimal(38,0)")  # twice the middle's place
    number = F.floor(middle * shards / F.lit(2 * max(total, 1)).cast("decimal(38,0)")).cast("int")
    spread = grouped.join(F.broadcast(bases), "range").select(  # at most MOST_RANGES rows
        "doc_id", "size", "text_crc32", number.alias("shard"), (F.col("rows_before") + F.col("rank")).alias("at")
    )
    spread = written(spread, "shards")
    firsts = spread.groupBy("shard").agg(F.min("at").alias("first"))
    return spread.join(F.broadcast(firsts), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
