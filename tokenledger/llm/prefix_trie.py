"""The prefix trie of conversations: every distinct beginning is a node, with its members and what sharing it would save.

A beginning is known by a 128-bit digest, two sums of turn digests times powers of an odd base, so digests of all
beginnings are running sums (`running`), and a conversation is rebuilt from another's beginning and its own rest by
arithmetic on them. A count-min sketch of all digests screens them first: an estimate of one proves that a beginning has
a single member, so its node is emitted where it is, and only beginnings that may be shared are shuffled and grouped exactly.

Sums over subtrees need no walk through the tree. A node is owned by its smallest member, which then owns all its deeper
nodes on its way as well. So what a member contributes to its nodes from one depth on is a running sum along that
member, and a subtree's sum is the sum of this over the members of its top: two groupings, however deep the trie.

Groupings are combined before the shuffle, and joins go through `lookup`, so a first turn that a third of all conversations
share is no heavy key. A conversation of any length is summed in pieces. The ids of the members that end in a node are
joined to pieces of text by ranges, and only these pieces are fed to the node's one digest, in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenledger.llm.common import table, written
from tokenledger.llm.countmin import sketch, width_for
from tokenledger.llm.lookup import lookup
from tokenledger.llm.repeats import mixed
from tokenledger.llm.running import power, running

#: Conversations of a family share the first turns of the one whose id is a multiple of this.
FAMILY = 5
#: A conversation takes 0 to MOST_SHARED first turns from its family.
MOST_SHARED = 8
BASES = (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93)
#: Bytes of joined ids in a row.
PIECE = 1 << 20
NODE = ["p1", "p2"]
PARENT = ["q1", "q2"]
NOTHING = hashlib.sha256(b"").hexdigest()


def _turns(conversations: DataFrame) -> DataFrame:
    """c, turn, d1, d2, bytes: each turn with a digest of its role and text."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    lanes = [F.conv(F.substring(digest, at, 16), 16, -10).cast("long") for at in (1, 17)]
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        lanes[0].alias("d1"), lanes[1].alias("d2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    return rows.where("c IS NOT NULL")


def _shared(c: Column) -> Column:
    return (F.crc32(c.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """c, depth, the digests p1, p2 of the beginning and q1, q2 of the one before, bytes and `last` (the whole conversation)."""
    sums = {name: (d, base) for name, d, base in zip(NODE, ("d1", "d2"), BASES)}
    turns = running(_turns(conversations), "c", ["turn", "d1", "d2"], sums).drop("turn")
    head = F.when(F.col("n") <= MOST_SHARED, F.struct("n", "d1", "d2", *NODE, "bytes"))
    # At most MOST_SHARED entries each.
    heads = written(turns.groupBy("c").agg(F.max("n").alias("total"), F.array_sort(F.collect_list(head)).alias("head")), "heads")
    family = heads.select(F.col("c").alias("f"), F.col("total").alias("f_total"), F.col("head").alias("f_head"))
    joined = heads.join(family.hint("merge"), F.col("c") - F.col("c") % FAMILY == F.col("f"), "left")
    joined = joined.withColumn("h", _shared(F.col("c")))
    joined = joined.withColumn("m", F.least("h", F.coalesce(F.col("f_total"), F.lit(0))).cast("int"))

    def at(heads: str, n: Column, field: str) -> Column:
        return F.coalesce(F.get(heads, n - 1)[field], F.lit(0).cast("long"))

    own = F.least("h", F.col("total")).cast("int")
    info = joined.select(
        "c", "h", "m", F.slice("f_head", F.lit(1), F.col("m")).alias("lead"),
        *(at("head", own, p).alias(f"b{i}") for i, p in enumerate(NODE, 1)),
        *(at("f_head", F.col("m"), p).alias(f"r{i}") for i, p in enumerate(NODE, 1)),
        (F.col("m") + F.greatest(F.col("total") - F.col("h"), F.lit(0))).cast("long").alias("length"),
    )
    info = written(info, "families")
    names = ["c", "n", "d1", "d2", "p1", "p2", "bytes", "h", "m", "b1", "b2", "r1", "r2", "length"]
    whole = lambda rows: rows.select(*(F.col(x).cast("long").alias(x) for x in names))
    rest = whole(lookup(turns, info.drop("lead"), ["c"]).where("n > h"))
    zero = [F.lit(0).alias(x) for x in ("h", "m", "b1", "b2", "r1", "r2")]
    lead = whole(info.select("c", "length", F.inline("lead")).select("*", *zero))
    top = whole(info.select("c", "length", *(F.lit(0).alias(x) for x in ("n", "d1", "d2", "p1", "p2", "bytes")), *zero))
    out = ["c", "depth", *NODE, *PARENT, "bytes", "last"]

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = {x: batch.column(i).to_numpy() for i, x in enumerate(names)}
            depth = v["m"] + v["n"] - np.where(v["n"] > 0, v["h"], 0)
            found = {"c": v["c"], "depth": depth, "bytes": v["bytes"], "last": (depth == v["length"]).astype(np.int64)}
            for i, base in enumerate(BASES, 1):
                p, d, b, r = (v[f"{x}{i}"].astype(np.uint64) for x in "pdbr")
                back = power(pow(base, -1, 1 << 64), v["h"] - v["m"])
                found[f"p{i}"] = (r + (p - b) * back).astype(np.int64)
                before = p - d * power(base, np.maximum(v["n"] - 1, 0))
                found[f"q{i}"] = (r + (before - b) * back).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found[x]) for x in out], names=out)

    return written(rest.union(lead).union(top).mapInArrow(place, ", ".join(f"{x} long" for x in out)), "rebuilt")


def _hash(batch: pa.RecordBatch, pair: list[str]) -> np.ndarray:
    one, two = (batch.column(batch.schema.get_field_index(x)).to_numpy().astype(np.uint64) for x in pair)
    return mixed(one ^ mixed(two + np.uint64(1)))


def _screened(rows: DataFrame) -> DataFrame:
    """`rows` with `maybe` and `q_maybe`: may the beginning, or the one before it, have two members?"""
    counted = sketch(rows.select(*NODE), lambda batch: [_hash(batch, NODE)], 2, width_for(32 * rows.count()), depth=2)
    known = rows.sparkSession.sparkContext.broadcast(counted)  # two bit arrays of bounded width

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [pa.array(known.value.may_reach(_hash(batch, pair))) for pair in (NODE, PARENT)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *marks], names=[*batch.schema.names, "maybe", "q_maybe"])

    fields = ", ".join(f"{x} long" for x in rows.columns)
    return written(rows.mapInArrow(mark, f"{fields}, maybe boolean, q_maybe boolean"), "screened")


def _ends(rows: DataFrame) -> DataFrame:
    """p1, p2 and the digest of the ascending, comma-joined ids c of each node."""

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size = None, [], 0

        def piece() -> pa.RecordBatch:
            columns = [[node[0]], [node[1]], [ids[0]], [",".join(map(str, ids))]]
            kinds = [pa.int64()] * 3 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "first", "ids"])

        for batch in batches:
            for p1, p2, c in zip(*(column.to_pylist() for column in batch.columns)):
                if ids and (node != (p1, p2) or size > PIECE):
                    yield piece()
                    ids, size = [], 0
                node = (p1, p2)
                ids.append(c)
                size += 12
        if ids:
            yield piece()

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, so_far, done = None, hashlib.sha256(), []
        for batch in batches:
            for p1, p2, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                if node == (p1, p2):
                    so_far.update(b"," + text.encode())
                    continue
                if node is not None:
                    done.append((*node, so_far.hexdigest()))
                node, so_far = (p1, p2), hashlib.sha256(text.encode())
            yield given(done)
            done = []
        if node is not None:
            yield given([(*node, so_far.hexdigest())])

    def given(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=[*NODE, "ends"])

    ranges = rows.select(*NODE, "c").repartitionByRange(*NODE, "c").sortWithinPartitions(*NODE, "c")
    pieces = written(ranges.mapInArrow(join, "p1 long, p2 long, first long, ids string"), "ends")
    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return ordered.mapInArrow(digest, "p1 long, p2 long, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Turns are in order of `turn`, null first, and of a digest where it ties; a null role or text is empty. Rows without
    conv_id take no part. Repeated rows are turns of their own. A family is that of the id less its remainder by FAMILY,
    which has the id's sign. An empty table has no node, not even a root. Other columns may have any names.
    """
    rows = _screened(rebuilt(conversations.select("conv_id", "turn", "role", "text")))
    single = rows.where("NOT maybe")
    shared = written(rows.where("maybe"), "shared")
    nodes = shared.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("c").alias("owner"), F.sum("last").alias("n_ends"))
    nodes = written(nodes, "nodes")
    known = lookup(shared, nodes, NODE)
    own = F.col("owner") == F.col("c")
    one = lambda condition: F.when(condition, 1).otherwise(0).cast("long")
    known = written(
        known.select(
            "c", "depth", *NODE, *PARENT, "last", "n_convs", "owner", "n_ends", (-F.col("depth")).alias("up"),
            F.when(own, (F.col("n_convs") - 1) * F.col("bytes")).otherwise(0).cast("long").alias("saves"),
            one(own & (F.col("last") == 1) & (F.col("n_convs") == F.col("n_ends"))).alias("leaf"),
            F.col("q_maybe").cast("long").alias("q_maybe"),
        ),
        "known",
    )
    along = running(
        known.select("c", "up", *NODE, "saves", "leaf", "last"), "c", ["up"],
        {"saved": ("saves", 1), "leaves": ("leaf", 1), "lasts": ("last", 1)},
    )
    # A member whose last turn is not here ends in a node of its own.
    along = along.select(*NODE, "saved", F.when(F.col("lasts") == 0, 1).otherwise(F.col("leaves")).cast("long").alias("leaves"))
    below = known.where(own & (F.col("depth") > 0)).select("c", *NODE, *PARENT, (F.col("q_maybe") == 1).alias("q_maybe"))
    below = below.withColumn("own", F.lit(True)).union(
        single.where("depth > 0 AND q_maybe").select("c", *NODE, *PARENT, "q_maybe", F.lit(False))
    )
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("parent"))
    below = lookup(written(below, "below"), parents, PARENT, "left")
    below = written(below.withColumn("parent", F.coalesce("parent", "c")), "parents")

    def part(rows: DataFrame, **columns: Column | str) -> DataFrame:
        given = {k: F.col(v) if isinstance(v, str) else v for k, v in columns.items()}
        fields = ["n_convs", "owner", "depth", "saved", "leaves", "parent", "children", "ends"]
        nothing = lambda f: F.lit(None).cast("string" if f == "ends" else "long")
        pair = given.get("pair", F.struct(*NODE))
        return rows.select(pair.alias("pair"), *(given.get(f, nothing(f)).alias(f) for f in fields)).select("pair.*", *fields)

    parts = [
        part(known, n_convs="n_convs", owner="owner", depth="depth"),
        part(along, saved="saved", leaves="leaves"),
        part(below.where("own"), parent="parent"),
        part(below.where("q_maybe"), children=F.lit(1).cast("long"), pair=F.struct(F.col("q1").alias("p1"), F.col("q2").alias("p2"))),
        part(_ends(known.where("last = 1")), ends="ends"),
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.union(more)
    sums = [F.max(x).alias(x) for x in ("n_convs", "owner", "depth", "parent", "ends")]
    sums += [F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(x) for x in ("saved", "leaves", "children")]
    grouped = every.groupBy(*NODE).agg(*sums).select(
        F.col("owner").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
        F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )
    ends = F.when(F.col("last") == 1, F.sha2(F.col("c").cast("string"), 256)).otherwise(NOTHING)
    alone = lambda rows, parent, last: rows.select(
        F.col("c").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
        (1 - F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), ends.alias("ends_sha256"),
    )
    inside = alone(single.where("depth = 0 OR NOT q_maybe"), F.when(F.col("depth") > 0, F.col("c")), None)
    edge = single.where("depth > 0 AND q_maybe").join(
        below.where("NOT own").select(*NODE, "parent").hint("merge"), NODE
    )
    return grouped.union(inside).union(alone(edge, F.col("parent"), None))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
           lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS of_byte),
turn AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, xor(list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda c, b: xor(c >> 8, of_byte[(xor(c, b) & 255) + 1])), 4294967295) % {MOST_SHARED + 1} AS h
  FROM (SELECT DISTINCT conv_id FROM turn), crc),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, n, role, text FROM conv c JOIN turn t ON t.conv_id = c.conv_id - c.conv_id % {FAMILY} WHERE n <= h
  UNION ALL SELECT c.conv_id, 1, n, role, text FROM conv c JOIN turn t ON t.conv_id = c.conv_id WHERE n > h),
path AS (
  SELECT conv_id, row_number() OVER w AS depth, list(sha256(strlen(role) || ':' || role || text)) OVER w AS key, strlen(text) AS bytes
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
  UNION ALL SELECT conv_id, 0, CAST([] AS VARCHAR[]), 0 FROM conv),
step AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM path),
node AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saves,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM step GROUP BY key, depth),
child AS (SELECT key[1:depth - 1] AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT v.key, sum(u.saves) AS saved, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM child c WHERE c.key = u.key)) AS leaves
  FROM node v JOIN node u ON u.depth >= v.depth AND u.key[1:v.depth] = v.key GROUP BY v.key)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(c.n, 0) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM node v JOIN below b ON b.key = v.key LEFT JOIN child c ON c.key = v.key
     LEFT JOIN node p ON p.depth = v.depth - 1 AND p.key = v.key[1:v.depth - 1]"""
