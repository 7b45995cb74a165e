"""SimHash near-duplicates with a pigeonring search.

A text's fingerprint has a bit for each bit that more than half of its shingle hashes have. Fingerprints within
`max_bits` bits of each other are linked, and documents that links connect are one component.

The 64 bits are cut into `boxes` segments that lie in a ring. If two fingerprints differ in at most t bits, then for some
first box every chain of the boxes from there on, however long, has at most (its share of the ring) x t differing bits.
While that share is below one bit, the chain's boxes must be equal: these boxes are the key under which candidates meet.
The longer chains prune the candidates of a key before the whole distance is taken.

Equal fingerprints are one node. A key that very many different fingerprints share is cut on: of the bits that the key
leaves open, cut into t + 1 parts, one part must be equal too, so each part makes a longer key. After four such cuts,
with t = 2, at most eight open bits are left, so the cutting ends, no key ever keeps more than 2,048 fingerprints, and
nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import strings, table, written
from tokenledger.llm.components import components

SHINGLE = 3
MAX_BITS = 2
BOXES = 7
#: Most fingerprints of one key that are compared pair by pair; keys with more are made longer.
GROUP = 2048
#: Hashes whose bits are counted at a time.
COUNTED = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Of lower-cased (A-Z) words between ASCII white space; no words give zero."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[min(shingle, len(words)) - 1 :]
    first = np.concatenate([[0], ends[: n - 1] + 1])
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, COUNTED):
        spans = zip(first[k : k + COUNTED].tolist(), last[k : k + COUNTED].tolist())
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and fingerprint (a long) of every document; a null text counts as an empty one, which has fingerprint
    zero."""
    own = docs.select(F.col("text").cast("string"), *keep)
    schema = T.StructType(own.schema.fields[1:] + [T.StructField("fingerprint", T.LongType())])

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, bounds = strings(batch.column(0))
            found = [fingerprint(data[a:b].tobytes(), shingle) for a, b in zip(bounds, bounds[1:])]
            marks = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], marks], names=schema.names)

    return own.mapInArrow(mark, schema)


def box_masks(boxes: int) -> list[int]:
    edges = [64 * i // boxes for i in range(boxes + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]


def chain_masks(boxes: int, start: int) -> list[int]:
    """The bits of the chains of 1, 2, ... boxes from `start` on."""
    masks, out = box_masks(boxes), []
    for k in range(boxes):
        out.append((out[-1] if out else 0) | masks[(start + k) % boxes])
    return out


def key_mask(boxes: int, start: int, max_bits: int) -> int:
    """The bits of the longest chain from `start` that may not differ at all."""
    equal = -(-boxes // max_bits) - 1
    if equal < 1:
        raise ValueError("the ring needs more boxes than bits that may differ")
    return chain_masks(boxes, start)[equal - 1]


def longer_masks(mask: int, max_bits: int) -> list[int]:
    """`mask` with each of max_bits + 1 parts of its open bits."""
    open_ = [i for i in range(64) if not mask >> i & 1]
    edges = [len(open_) * i // (max_bits + 1) for i in range(max_bits + 2)]
    return [mask | sum(1 << i for i in open_[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def linked(group: np.ndarray, start: int, boxes: int, max_bits: int) -> np.ndarray:
    """Links (pairs of positions) that connect what pairs within `max_bits` connect in a group of one key."""
    steps = [(np.uint64(m), (k + 1) * max_bits // boxes) for k, m in enumerate(chain_masks(boxes, start))]
    pairs = [np.empty((0, 2), np.int64)]
    for at in range(0, len(group), 256):
        own = group[at : at + 256]
        i, j = np.nonzero(np.arange(at, at + len(own))[:, None] < np.arange(len(group))[None, :])
        differ = own[i] ^ group[j]
        for mask, most in steps:  # the last chain is the whole ring
            keep = np.bitwise_count(differ & mask) <= most
            i, j, differ = i[keep], j[keep], differ[keep]
        pairs.append(np.column_stack([i + at, j]))
    found = np.concatenate(pairs)
    if len(found) <= len(group):
        return found
    root = np.arange(len(group))
    while True:
        before = root.copy()
        low = np.minimum(root[found[:, 0]], root[found[:, 1]])
        np.minimum.at(root, found[:, 0], low)
        np.minimum.at(root, found[:, 1], low)
        root = root[root]
        if (root == before).all():
            member = np.flatnonzero(root != np.arange(len(root)))
            return np.column_stack([root[member], member])


def _links(groups: DataFrame, boxes: int, max_bits: int) -> DataFrame:
    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, starts = batch.column("members"), batch.column("start").to_pylist()
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            found = [np.empty((0, 2), np.uint64)]
            for start, a, b in zip(starts, offsets.tolist(), offsets[1:].tolist()):
                group = values[a:b]
                found.append(group[linked(group, start, boxes, max_bits)])
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return groups.select("start", "members").mapInArrow(compare, "a long, b long")


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS, boxes: int = BOXES, group: int = GROUP) -> DataFrame:
    """Links (a, b) between the different fingerprints in `nodes` (fingerprint, no two equal).

    They connect whatever pairs within `max_bits` bits connect; of a clique, a spanning tree is enough.
    """
    if max_bits < 1:
        return nodes.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).limit(0)
    spark = nodes.sparkSession
    masks = [(s, key_mask(boxes, s, max_bits)) for s in range(boxes)]
    keyed = F.explode(F.array(*[F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).alias("mask")) for s, m in masks]))
    keys = nodes.select("fingerprint", keyed.alias("k")).selectExpr("fingerprint", "k.start", "k.mask", "fingerprint & k.mask AS key")
    out = None
    while True:
        keys = written(keys, "keys")
        by = ["start", "mask", "key"]
        sizes = keys.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
        kept = keys.join(sizes.where(F.col("n") <= group).hint("merge"), by).groupBy(*by).agg(F.collect_list("fingerprint").alias("members"))
        links = _links(kept, boxes, max_bits)
        out = links if out is None else out.union(links)
        large = written(sizes.where(F.col("n") > group), "large-keys")
        if large.isEmpty():
            return out
        masks = [(s, m, longer) for s, m in masks for longer in longer_masks(m, max_bits)]
        steps = spark.createDataFrame([(s, _signed(m), _signed(x)) for s, m, x in masks], "start int, mask long, longer long")
        masks = sorted({(s, x) for s, _, x in masks})
        again = keys.join(large.select(*by).hint("merge"), by, "left_semi").join(F.broadcast(steps), ["start", "mask"])
        keys = again.select("fingerprint", "start", F.col("longer").alias("mask")).distinct().selectExpr("*", "fingerprint & mask AS key")


def _rooted(marks: DataFrame, least: Column, max_bits: int, boxes: int) -> DataFrame:
    """Every fingerprint in `marks`, the aggregate `least` of its rows and the root of its component."""
    nodes = written(marks.groupBy("fingerprint").agg(least.alias("least")), "nodes")
    roots = components(near_links(nodes.select("fingerprint"), max_bits, boxes))
    rooted = nodes.join(roots.hint("merge"), F.col("fingerprint") == F.col("node"), "left")
    return rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, boxes: int = BOXES) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id that links reach, its own included; a null doc_id is never that, unless the
    component has no other. Null and empty texts have fingerprint zero and are linked like any other. Rows with one doc_id
    are documents of their own. An empty table gives an empty one.
    """
    marks = written(fingerprints(docs, shingle), "fingerprints")
    rooted = _rooted(marks, F.min("doc_id"), max_bits, boxes)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    members = rooted.join(named.hint("merge"), "root").select("fingerprint", "component_id")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return marks.join(members.hint("merge"), "fingerprint").select("doc_id", hexed, "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, boxes: int = BOXES) -> DataFrame:
    """One row of docs, with all its columns, for every component of `near_duplicates`: that with the smallest doc_id.

    A null doc_id comes last, and of rows with one doc_id the one with the smallest hash of its columns stays. Rows are
    numbered in a table of their own, so neither null nor repeated doc_ids, nor equal rows, are mixed up.
    """
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    order = rows.withColumns({"__null": F.col("doc_id").isNull(), "__tie": F.xxhash64(*docs.columns)})
    first = ("__null", "doc_id", "__tie", "__row")
    marks = written(fingerprints(order, shingle, first), "fingerprints")
    rooted = _rooted(marks, F.min(F.struct(*first)), max_bits, boxes)
    kept = rooted.groupBy("root").agg(F.min("least").alias("least")).select("least.__row")
    return rows.join(kept.hint("merge"), "__row", "left_semi").select(docs.columns)


def op4_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
