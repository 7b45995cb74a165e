"""Benchmark decontamination by q-gram counts in diagonal bands, verified by banded alignment.

Texts are folded: ASCII and Latin-1 letters lowered, every run of other ASCII signs one space. An item of m bytes may
stand in a document with up to k = floor(rate * m) edits. Then, by the q-gram lemma, at least m - q + 1 - k q of its
q-grams stand in the document, on diagonals (place in the document less place in the item) that differ by at most k. So
shared q-grams are counted in bands of diagonals that overlap by k, bands that reach the bound are kept, and each of them is
aligned: edit distance from the whole item to any stretch of the document inside the band.

The items are a query set; they go to all tasks in blocks of at most `block_bytes` of text, and each block passes over
all documents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenledger.llm.common import blocks, strings, table

Q = 8
RATE = 0.1
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are searched at a time; a longer text is searched in parts that overlap.
TEXT_BYTES = 1 << 18
#: Log2 of the number of diagonals in a band, without the overlap.
BAND = 6
#: Candidates that are aligned at a time.
ALIGNED = 64

FOLD = np.array([i | 0x20 if 65 <= i <= 90 else i if 97 <= i <= 122 or 48 <= i <= 57 or i >= 128 else 0x20 for i in range(256)], np.uint8)


def folded(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of texts that begin at `starts`, and which bytes they came from."""
    text = FOLD[raw]
    latin = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
    text[latin] |= 0x20
    space = text == 0x20
    keep = np.ones(len(text), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts[starts < len(text)]] = True
    return text[keep], keep


def places(keep: np.ndarray, ranks: list[int]) -> list[int]:
    """Where the kept bytes with these ranks stand, found block by block."""
    starts = np.arange(0, len(keep), 1 << 16)
    before = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, starts, dtype=np.int64))])
    out = []
    for rank in ranks:
        block = int(np.searchsorted(before, rank, "right")) - 1
        at = int(starts[block])
        out.append(at + int(np.flatnonzero(keep[at : at + (1 << 16)])[rank - before[block]]))
    return out


def folded_text(text: str) -> bytes:
    return folded(np.frombuffer(text.encode(), np.uint8), np.zeros(1, np.int64))[0].tobytes().strip()


def grams(text: np.ndarray) -> np.ndarray:
    """All 8-grams as numbers: the bytes themselves."""
    one = text.astype(np.uint64)
    two = one[:-1] | one[1:] << np.uint64(8)
    four = two[:-2] | two[2:] << np.uint64(16)
    return four[:-4] | four[4:] << np.uint64(32)


@dataclass
class Items:
    """The items of a block, in item number, and an index of their q-grams."""

    ids: list
    texts: list[bytes]
    edits: np.ndarray
    needed: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    count: np.ndarray
    item: np.ndarray
    place: np.ndarray
    sieve: np.ndarray


SIEVE_BITS = 21
SIEVE = np.uint64(0x9E3779B97F4A7C15)


def indexed(rows: list[tuple], rate: float = RATE) -> Items:
    """rows: (item_id, text). Items with fewer than q folded bytes have no q-gram and cannot be looked for."""
    kept = [(i, folded_text(t)) for i, t in rows if t is not None]
    kept = [(i, t) for i, t in kept if len(t) >= Q]
    texts = [t for _, t in kept]
    m = np.array([len(t) for t in texts], np.int64)
    # An item so short that its edits could leave no shared q-gram gets as many as leave one.
    edits = np.minimum(np.floor(m * rate).astype(np.int64), (m - Q) // Q)
    found = [grams(np.frombuffer(t, np.uint8)) for t in texts] or [np.empty(0, np.uint64)]
    keys = np.concatenate(found)
    item = np.repeat(np.arange(len(texts)), [len(g) for g in found][: len(texts)])
    place = np.concatenate([np.arange(len(g)) for g in found])
    order = np.argsort(keys, kind="stable")
    unique, first, count = np.unique(keys[order], return_index=True, return_counts=True)
    sieve = np.zeros(1 << SIEVE_BITS, bool)
    sieve[unique * SIEVE >> np.uint64(64 - SIEVE_BITS)] = True
    return Items([i for i, _ in kept], texts, edits, m - Q + 1 - edits * Q, unique, first, count, item[order], place[order], sieve)


def candidates(text: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(item, band) with enough shared q-grams; band b holds the diagonals from b * 64 to b * 64 + 63 + k."""
    none = np.empty(0, np.int64)
    if len(text) < Q or not len(items.keys):
        return none, none
    own = grams(text)
    at = np.flatnonzero(items.sieve[own * SIEVE >> np.uint64(64 - SIEVE_BITS)])
    key = np.minimum(np.searchsorted(items.keys, own[at]), len(items.keys) - 1)
    known = items.keys[key] == own[at]
    at, key = at[known], key[known]
    n = items.count[key]
    source = np.arange(n.sum()) + np.repeat(items.first[key] - (np.cumsum(n) - n), n)
    item = items.item[source]
    diagonal = np.repeat(at, n) - items.place[source] + (1 << 32)
    band = diagonal >> BAND
    low = diagonal - (band << BAND)
    # A diagonal in the first k of a band is in the overlap of the bands before, as many as k reaches.
    place = items.place[source]
    bands, owners, spots = [band], [item], [place]
    back = 1
    while True:
        more = low + (back - 1) * (1 << BAND) < items.edits[item]
        if not more.any():
            break
        bands.append(band[more] - back)
        owners.append(item[more])
        spots.append(place[more])
        back += 1
    hits = np.concatenate(owners) << 40 | np.concatenate(bands)
    pairs, code, counts = np.unique(hits, return_inverse=True, return_counts=True)
    enough = counts >= items.needed[pairs >> 40]
    if enough.any():
        # A q-gram of the item that stands in a band twice counts once.
        near = enough[code]
        spots = np.concatenate(spots)[near]
        counts = np.bincount(np.unique(code[near] << 32 | spots) >> 32, minlength=len(pairs))
        enough = counts >= items.needed[pairs >> 40]
    pairs = pairs[enough]
    return pairs >> 40, (pairs & (1 << 40) - 1) - (1 << 32 - BAND)


def region_width(items: Items) -> int:
    """Diagonals that an alignment looks at: a band with its overlap, and the edits on either side."""
    return (1 << BAND) + 3 * int(items.edits.max(initial=0)) + 1


def aligned(regions: np.ndarray, numbers: np.ndarray, items: Items, placed: bool = False) -> tuple[np.ndarray, ...]:
    """The least edit distance of an item to any stretch of its region, for many regions at once.

    regions: a row of bytes for each, sorted so that items get no longer; numbers: the item of each. Row i of an alignment's table is
    the item's first i bytes, and its column c a stretch that ends at i + c. With `placed`, also starts and ends of the
    best stretches in the regions.
    """
    size = np.array([len(items.texts[k]) for k in numbers.tolist()])
    longest = int(size[0])
    signs = np.zeros((len(numbers), longest), np.uint8)
    for row, k in enumerate(numbers.tolist()):
        signs[row, : size[row]] = np.frombuffer(items.texts[k], np.uint8)
    width = regions.shape[1] - longest
    columns = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(numbers), width), np.int32)
    start = np.broadcast_to(columns, cost.shape).copy() if placed else None
    out = [np.zeros(len(numbers), np.int64) for _ in range(3)]
    for i in range(longest + 1):
        done = np.searchsorted(-size, -i, "right")  # rows from here on are through with their items
        active = np.searchsorted(-size, -i, "left")
        if active < done:
            best = cost[active:done].argmin(axis=1)
            rows = np.arange(done - active)
            out[0][active:done] = cost[active:done][rows, best]
            if placed:
                out[1][active:done] = start[active:done][rows, best]
                out[2][active:done] = best + i
        if not active:
            break
        cost = cost[:active]
        change = cost + (regions[:active, i : i + width] != signs[:active, i : i + 1])
        skip = cost[:, 1:] + 1
        if placed:
            start = start[:active]
            less = skip < change[:, :-1]
            start = np.column_stack([np.where(less, start[:, 1:], start[:, :-1]), start[:, -1]])
        np.minimum(change[:, :-1], skip, out=change[:, :-1])
        change -= columns  # an insertion goes one column right and costs one
        cost = np.minimum.accumulate(change, axis=1)
        if placed:
            origin = np.maximum.accumulate(np.where(change == cost, columns, 0), axis=1)
            start = np.take_along_axis(start, origin, axis=1)
        cost += columns
    return tuple(out) if placed else out[:1]


@dataclass
class Candidate:
    row: int
    item: int
    #: Where the region begins in the row's folded text, and its bytes.
    base: int
    region: bytes


def exact_or_region(text: np.ndarray, row: int, offset: int, items: Items, width: int) -> Iterator[tuple[int, int] | Candidate]:
    """Of a folded text (or a part that begins at `offset`): (item, place) where one stands as it is, else candidates."""
    item, band = candidates(text, items)
    for k in np.unique(item).tolist():
        m, edits, found = len(items.texts[k]), int(items.edits[k]), []
        for b in band[item == k].tolist():
            base = (b << BAND) - edits
            own = text[max(0, base) : max(0, base + m + width)].tobytes()
            exact = own.find(items.texts[k])
            if exact >= 0:
                yield k, offset + max(0, base) + exact
                break
            found.append(Candidate(row, k, offset + base, b"\0" * max(0, -base) + own))
        else:
            yield from found


def verified(found: list[Candidate], items: Items, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, start, end, edits) of the candidates that keep to their item's edits."""
    found = sorted(found, key=lambda c: -len(items.texts[c.item]))
    for at in range(0, len(found), ALIGNED):
        own = found[at : at + ALIGNED]
        longest = len(items.texts[own[0].item])
        regions = np.zeros((len(own), longest + width), np.uint8)
        for row, c in enumerate(own):
            regions[row, : len(c.region)] = np.frombuffer(c.region, np.uint8)
        numbers = np.array([c.item for c in own])
        (cost,) = aligned(regions, numbers, items)
        near = np.flatnonzero(cost <= items.edits[numbers])
        if len(near):
            cost, start, end = aligned(regions[near], numbers[near], items, placed=True)
            for row, c, a, b in zip(near.tolist(), cost.tolist(), start.tolist(), end.tolist()):
                yield own[row].row, own[row].item, own[row].base + a, own[row].base + b, c


def search_all(data: np.ndarray, bounds: np.ndarray, items: Items) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, start, end, edits), one for each row and item at most: the best place, the first of equals.

    start and end are byte places in the row's text. Short texts are folded many at a time, and a long one is searched in
    parts that overlap by more than an item may reach; all candidates of the rows are aligned together.
    """
    width = region_width(items)
    overlap = 2 * max([len(t) for t in items.texts], default=0) + width
    out = []
    for first, last in blocks(bounds, max(TEXT_BYTES, int(bounds[-1] - bounds[0]) // 4)):
        begin = bounds[first : last + 1] - bounds[first]
        text, keep = folded(data[bounds[first] : bounds[last]], begin[:-1])
        # A text's first byte is always kept.
        kept = np.add.reduceat(np.append(keep, False), begin[:-1], dtype=np.int64) * (np.diff(begin) > 0)
        at = np.concatenate([[0], np.cumsum(kept)]).tolist()
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        found: list[Candidate] = []

        def take(row: int, k: int, start: int, end: int, edits: int) -> None:
            low = min(max(start, 0), at[row + 1] - at[row] - 1)
            match = (edits, at[row] + low, at[row] + min(max(end, low + 1), at[row + 1] - at[row]))
            best[row, k] = min(best.get((row, k), match), match)

        for row in range(last - first):
            for part in range(at[row], at[row + 1], TEXT_BYTES):
                own = text[part : min(at[row + 1], part + TEXT_BYTES + overlap)]
                for hit in exact_or_region(own, row, part - at[row], items, width):
                    if isinstance(hit, Candidate):
                        found.append(hit)
                    else:
                        take(row, hit[0], hit[1], hit[1] + len(items.texts[hit[0]]), 0)
        for hit in verified([c for c in found if (c.row, c.item) not in best], items, width):
            take(*hit)
        for (row, k), (edits, start, end) in sorted(best.items()):
            low, high = places(keep, [start, end - 1])
            out.append((first + row, k, low - int(begin[row]), high + 1 - int(begin[row]), edits))
    return out


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits) for every item that a document holds within its edit budget.

    start and end are byte places in the text of the best stretch. Null texts hold nothing and null or very short items
    (under 8 folded bytes) are not looked for. Repeated documents and items each have rows of their own. An empty table on
    either side gives no rows.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType)]
        + [T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("edits", T.LongType())]
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = None
    for items in _item_blocks(benchmark, rate, block_bytes):
        found = texts.mapInArrow(_searcher(docs.sparkSession.sparkContext.broadcast(items), schema), schema)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark; what counts is as in `find_items`."""

    def without(spread):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {x[0] for x in search_all(*strings(batch.column("text").cast(pa.string())), spread.value)}
                yield batch.take(pa.array([i for i in range(len(batch)) if i not in found], pa.int64()))

        return run

    for items in _item_blocks(benchmark, rate, block_bytes):
        docs = docs.mapInArrow(without(docs.sparkSession.sparkContext.broadcast(items)), docs.schema)
    return docs


def _item_blocks(benchmark: DataFrame, rate: float, block_bytes: int) -> Iterator[Items]:
    """The items by hash, so each block is near its share of the bytes; half of the limit leaves room for chance."""
    own = benchmark.where("text is not null").select("item_id", F.col("text").cast("string").alias("text"))
    total = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes))
    for block in range(n):
        rows = own.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(n)) == block).collect()
        yield indexed([tuple(r) for r in rows], rate)


def _searcher(spread, schema: T.StructType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = spread.value
        for batch in batches:
            found = search_all(*strings(batch.column(1)), items)
            item_ids = pa.array(items.ids)
            columns = [batch.column(0).take(pa.array([x[0] for x in found], pa.int64()))]
            columns.append(item_ids.take(pa.array([x[1] for x in found], pa.int64())))
            columns += [pa.array([x[i] for x in found], pa.int64()) for i in (2, 3, 4)]
            if found:
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
