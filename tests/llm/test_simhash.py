import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from tests.llm.cases import SMALL, docs, texts
from tokenledger.llm import simhash
from tokenledger.llm.components import components
from tokenledger.llm.simhash import chain_masks, key_mask, linked, longer_masks, near_duplicates, near_links, op4_simhash_near_dedup


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(marks, most=2):
    """marks: (doc_id, fingerprint) -> smallest doc_id reachable, by index."""
    root = list(range(len(marks)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i][1] ^ marks[j][1]).bit_count() <= most:
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(marks):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [least[find(i)] for i in range(len(marks))]


ROWS = [(7, None), (3, ""), (9, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "ÀÉ one x"), (6, "ÀÉ one x"), (8, "a b c d " * 4000)]


def test_awkward_texts(spark):
    frame = docs(spark, ROWS).withColumnRenamed("source", "component_id").withColumnRenamed("lang", "fingerprint")
    got = near_duplicates(frame).collect()
    assert len(got) == len(ROWS)
    marks = [(d, slow_fingerprint(t)) for d, t in ROWS]
    want = sorted((d, f"{m:016x}", c) for (d, m), c in zip(marks, slow_components(marks)))
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert near_duplicates(docs(spark, [])).count() == 0
    only = near_duplicates(docs(spark, [(None, "x y z"), (None, "x y z")])).collect()
    assert [r.component_id for r in only] == [None, None]


def test_registered_query(spark):
    rows = texts(spark).select("doc_id", "text").orderBy("doc_id").collect()
    marks = [(r.doc_id, slow_fingerprint(r.text)) for r in rows]
    want = [(d, f"{m:016x}", c) for (d, m), c in zip(marks, slow_components(marks))]
    got = op4_simhash_near_dedup(spark, SMALL).orderBy("doc_id").collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == want


def clouds(seed, n):
    """Fingerprints in clusters of few differing bits."""
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        own = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 30])):
            for _ in range(rng.choice([0, 1, 2, 3])):
                own ^= 1 << rng.randrange(64)
            out.add(own)
    return sorted(out)


@pytest.mark.parametrize("group", [4, 2048])
@pytest.mark.parametrize("boxes", [3, 7])
def test_links_connect_all_near_pairs(spark, boxes, group):
    marks = clouds(boxes, 300)
    signed = np.array(marks, np.uint64).view(np.int64).tolist()
    links = near_links(spark.createDataFrame([Row(fingerprint=x) for x in signed]), 2, boxes, group)
    roots = {r.node: r.root for r in components(links).collect()}
    got = [roots.get(x, x) for x in signed]
    want = slow_components(list(zip(signed, marks)))
    assert len(set(got)) == len(set(want))
    assert len(set(zip(got, want))) == len(set(want))


def test_every_near_pair_has_a_key():
    rng = random.Random(1)
    for boxes in (3, 5, 7, 9):
        for _ in range(500):
            a = rng.getrandbits(64)
            b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            pair = np.array([a, b], np.uint64)
            met = [s for s in range(boxes) if (a ^ b) & key_mask(boxes, s, 2) == 0]
            assert any(len(linked(pair, s, boxes, 2)) for s in met)


def test_a_key_is_never_large_after_four_cuts():
    masks = {key_mask(7, 0, 2)}
    for _ in range(4):
        masks = {x for m in masks for x in longer_masks(m, 2)}
    assert max(64 - m.bit_count() for m in masks) <= 8
    assert 1 << 8 <= simhash.GROUP
    assert chain_masks(7, 3)[-1] == (1 << 64) - 1


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}
    for _ in range(400):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert all(got.get(x, x) == r for x, r in root.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
