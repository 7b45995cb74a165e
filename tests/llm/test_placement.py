import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.cases import SMALL, docs, texts
from tokenledger.llm import sharding, syncmers
from tokenledger.llm.sharding import op9_sharding, shard
from tokenledger.llm.syncmers import fingerprint, fingerprints, likeness, neighbours, op5_document_fingerprints


def check_shards(rows, got, shards=16):
    want = sorted((d is not None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == want
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards for r in got)
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    total, largest = sum(sizes.values()), max(r.size for r in got)
    # Each edge of a shard moves by half a document or half a small group at most.
    most = max(largest, sharding.WHOLE_SHARE * total / shards)
    assert all(abs(sizes[s] - total / shards) <= most + 1 for s in range(shards))


def hot(n=3000):
    rows = [(i, "the same text " * 3) for i in range(n // 3)] + [(n + i, None) for i in range(n // 3)]
    return rows + [(2 * n + i, f"text {i} " * (i % 40)) for i in range(n // 3)] + [(5, "the same text " * 3)] * 3


@pytest.mark.parametrize("ranges", [None, 1, 40])
def test_hot_groups_are_subdivided(spark, ranges):
    rows = hot()
    check_shards(rows, shard(docs(spark, rows).withColumnRenamed("source", "shard"), ranges=ranges).collect())


def test_ranges_do_not_change_the_shards(spark):
    frame = docs(spark, [(i, f"text {i} " * (i % 40)) for i in range(500)])
    one, many = (sorted(map(tuple, shard(frame, ranges=n).select("doc_id", "shard", "slot").collect())) for n in (1, 97))
    assert one == many


def test_small_groups_stay_whole(spark):
    rows = [(i, f"text number {i // 4}") for i in range(8000)]
    where = defaultdict(set)
    for r in shard(docs(spark, rows)).collect():
        where[r.doc_id // 4].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_no_range_is_overfull(spark):
    frame = docs(spark, hot(6000)).selectExpr("doc_id", "text", "octet_length(coalesce(text, '')) + 1L AS size")
    rows = frame.selectExpr("size", "xxhash64(coalesce(text, '')) AS hash", "monotonically_increasing_id() AS row").cache()
    total, n = rows.agg({"size": "sum"}).first()[0], rows.count()
    placed, sums = sharding.subdivided(rows, 64, total, n)
    for r in sums.collect():
        assert (r.range_rows / n + r.range_size / total) / 2 <= sharding.OVERFULL / 64
    keys = sorted(placed.select("hash", "range", "head").collect())
    assert len(keys) == n and all(a.range <= b.range for a, b in zip(keys, keys[1:]) if a.hash != b.hash)
    assert all(r.head is None or r.head <= r.range for r in keys)


def test_ranges_of_given_splitters(spark):
    """Splitters anywhere among the hashes, against a count one by one."""
    marks = {-(1 << 63): 1, -5: 3, 0: 1, 1: 2, 7 << 40: 1, (1 << 63) - 1: 2}
    values = sorted({h + d for h in marks for d in (-1, 0, 1) if -(1 << 63) <= h + d < 1 << 63})
    rows = spark.createDataFrame([(h, i) for h in values for i in range(20)], "hash long, row long")
    got = defaultdict(set)
    for r in sharding.placed_in(rows, marks).collect():
        got[r.hash].add((r.range, r.head))
    at, firsts = 0, {}
    for h in values:
        if (pieces := marks.get(h, 0)) > 1:
            firsts[h] = at + 1
            assert {x for x, _ in got[h]} == set(range(at + 1, at + 1 + pieces)) and {x for _, x in got[h]} == {at + 1}
            at += pieces + 1
        else:
            at += pieces
            assert got[h] == {(at, None)}


def test_a_skewed_sample_is_made_up_for(spark, monkeypatch):
    """With hardly any splitters at first the overfull ranges are found by count and subdivided."""
    rows = hot(3000)
    first, draw = [], sharding.drawn

    def few(*args):
        first.append(draw(*args))
        return first[-1] if len(first) > 1 else {}

    monkeypatch.setattr(sharding, "drawn", few)
    check_shards(rows, shard(docs(spark, rows), ranges=40).collect())
    assert len(first) > 1 and len(first[1]) > 5


def test_groups_stay_whole_in_any_number_of_ranges(spark):
    rows = [(i, f"text number {i // 9}") for i in range(9000)]
    where = defaultdict(set)
    for r in shard(docs(spark, rows), ranges=4000).collect():
        where[r.doc_id // 9].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_few_or_no_rows(spark):
    assert shard(docs(spark, [])).count() == 0
    assert [tuple(r) for r in shard(docs(spark, [(None, None)])).collect()] == [(None, 1, 0, "bytes", 8, 0, None)]


def test_registered_sharding(spark):
    rows = [tuple(r) for r in texts(spark).select("doc_id", "text").collect()]
    check_shards(rows, op9_sharding(spark, SMALL).collect())


def slow_anchors(text, k=syncmers.K, s=syncmers.S):
    """Places of closed syncmers, k-mer by k-mer."""
    def order(x):
        return int(syncmers.gram_hashes(syncmers._codes(x), s)[0])

    out = []
    for i in range(len(text) - k + 1):
        inner = [order(text[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def test_anchors_are_closed_syncmers(monkeypatch):
    text = "Größe und Länge, a text with 語 in it. " * 3 + "and something else at the end of it"
    places = np.concatenate([at for _, at in syncmers.anchors(text)]).tolist()
    assert places == slow_anchors(text)
    monkeypatch.setattr(syncmers, "CHUNK", 17)
    assert np.concatenate([at for _, at in syncmers.anchors(text)]).tolist() == places


def test_likeness():
    a = " ".join(f"word{i}" for i in range(400))
    b = " ".join(f"other{i}" for i in range(400))
    assert likeness(fingerprint(a), fingerprint(a)) == 1
    assert likeness(fingerprint(a), fingerprint(b)) == 0
    assert likeness(fingerprint(a), fingerprint(a + " and one more sentence at the end of it")) > 0.8
    assert 0.1 < likeness(fingerprint(a), fingerprint(a[: len(a) // 2] + b[: len(b) // 2])) < 0.6
    assert likeness(fingerprint(""), fingerprint("")) == 1 and likeness(fingerprint(""), fingerprint(a)) == 0
    assert likeness(fingerprint("ab"), fingerprint("ab")) == 1 and likeness(fingerprint("ab"), fingerprint("ba")) == 0


def test_short_texts_have_an_anchor():
    rng = random.Random(5)
    words = "".join(rng.choice("abcdefghijklm nopqrstuvw") for _ in range(4000))
    for n in range(1, 60):
        own = [fingerprint(words[at : at + n]) for at in range(0, 3000, 61)]
        assert all(len(hashes) for hashes, _ in own)
    for n in range(24, 40):
        parts = [words[at : at + n] for at in range(0, 3000, 61)]
        for a, b in zip(parts, parts[1:]):
            assert likeness(fingerprint(a), fingerprint(b)) < 1 or a == b
            assert likeness(fingerprint(a), fingerprint(a[: n - n // 2] + b[: n // 2])) < 1
            assert likeness(fingerprint(a), fingerprint("")) == 0


def slow_neighbours(rows):
    tie = lambda t: int(np.array(xxhash.xxh64_intdigest(t.encode(), 42), np.uint64).view(np.int64))
    rows = sorted(((d is not None, d or 0, t or "") for d, t in rows), key=lambda r: (*r[:2], tie(r[2])))
    out = []
    for i, (has, d, text) in enumerate(rows):
        following, n = rows[(i + 1) % len(rows)][2], len(text)
        edited = text[: n - n // 2] + following[: n // 2]
        own, mark, its = fingerprint(text), fingerprint(edited), fingerprint(following)
        out.append((has, d, n, hashlib.sha256(edited.encode()).hexdigest(), syncmers.as_bytes(own).hex(), syncmers.as_bytes(mark).hex(), likeness(own, mark), likeness(own, its)))
    return out


ROWS = [(3, "é" * 7), (1, None), (None, "nobody's text"), (2, ""), (8, "語" * 101), (8, "語" * 101), (9, "long " * 60_000), (7, "x")]
ROWS += [(100 + i, f"text {i} with some words of its own {i * i} " * (1 + i % 5)) for i in range(60)]


@pytest.mark.parametrize("rows", [ROWS, [(4, "alone in the table")], []], ids=["many", "one", "none"])
def test_neighbours(spark, rows):
    got = neighbours(docs(spark, rows).withColumnRenamed("source", "part").withColumnRenamed("lang", "following")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, *tuple(r)[1:]) for r in got) == sorted(slow_neighbours(rows))


def test_fingerprint_arrays(spark):
    got = {r.doc_id: (r.hashes, r.places) for r in fingerprints(docs(spark, ROWS[:4])).collect()}
    for d, t in ROWS[:4]:
        own = fingerprint(t or "")
        assert got[d] == (own[0].astype(int).tolist(), own[1].tolist())


def test_registered_fingerprints(spark):
    rows = [tuple(r) for r in texts(spark).select("doc_id", "text").collect()]
    got = [(True, *tuple(r)) for r in op5_document_fingerprints(spark, SMALL).orderBy("doc_id").collect()]
    assert got == slow_neighbours(rows)
    of = defaultdict(set)
    for (_, text), row in zip(sorted(rows), got):
        of[text].add(row[4])
    assert all(len(x) == 1 for x in of.values())
    assert np.mean([r[6] for r in got if r[2] > 500]) > np.mean([r[7] for r in got if r[2] > 500]) + 0.2
