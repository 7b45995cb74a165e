import random

import numpy as np
import pytest

from tests.llm.cases import SMALL, docs, texts
from tokenledger.llm import decontamination
from tokenledger.llm.decontamination import aligned, clean, find_items, folded, folded_text, indexed, op8_benchmark_decontamination, places, region_width


def slow_edits(item, text):
    """Least edit distance of the item to any stretch of the text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[-1] + 1))
        before = row
    return min(before)


def slow(rows, bench, rate=0.1):
    out = {}
    for doc_id, text in rows:
        for item_id, item in bench:
            own = folded_text(item or "")
            if text is None or len(own) < 8:
                continue
            m = len(own)
            most = min(int(m * rate + 1e-9), (m - 8) // 8)
            cost = slow_edits(own, folded(np.frombuffer(text.encode(), np.uint8), np.zeros(1, int))[0].tobytes())
            if cost <= most:
                out[doc_id, item_id] = cost
    return out


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("abcdefgh")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, rng.choice("abcdefgh"))
    return "".join(text)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, prose(rng.randint(5, 25))) for i in range(6)] + [(90, "tiny"), (91, None), (92, ""), (93, "eight ch")]
    rows = [(0, None), (1, ""), (2, "tiny"), (3, "EIGHT -- ch"), (4, prose(3))]
    for i in range(40):
        item = rng.choice(bench[:6])[1]
        n = rng.randint(0, int(0.14 * len(item)))
        own = edited(rng, item, n)
        own = own.upper() if rng.random() < 0.3 else own.replace(" ", "  \n")
        rows.append((10 + i, f"{prose(rng.randint(0, 30))} {own}. {prose(rng.randint(0, 30))}"))
    rows += [(60, bench[0][1] + " and " + bench[1][1] + " and " + bench[0][1]), (61, bench[2][1]), (61, bench[2][1])]
    return rows, bench


@pytest.mark.parametrize("seed", range(4))
def test_same_as_alignment_of_everything(spark, seed):
    rows, bench = planted(seed)
    frame = docs(spark, rows).withColumnRenamed("source", "item_id").withColumnRenamed("lang", "start")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = find_items(frame, items).collect()
    want = slow(rows, bench)
    assert {(r.doc_id, r.item_id): r.edits for r in got} == want
    assert sum(r.doc_id == 61 for r in got) == 2 * len({k for k in want if k[0] == 61})
    by = dict(bench)
    raw = dict(rows)
    for r in got:
        stretch = raw[r.doc_id].encode()[r.start : r.end]
        assert slow_edits(folded_text(by[r.item_id]), folded(np.frombuffer(stretch, np.uint8), np.zeros(1, int))[0].tobytes()) == r.edits
    kept = clean(frame, items)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in {k[0] for k in want})
    assert kept.columns == frame.columns
    in_blocks = find_items(frame, items, block_bytes=300).collect()
    assert sorted(map(tuple, in_blocks)) == sorted(map(tuple, got))


def test_long_texts_are_searched_in_parts(monkeypatch):
    rows, bench = planted(7)
    text = " ".join(t for _, t in rows if t)
    raw = np.frombuffer(text.encode(), np.uint8)
    items = indexed(bench)
    whole = decontamination.search_all(raw, np.array([0, len(raw)]), items)
    monkeypatch.setattr(decontamination, "TEXT_BYTES", 500)
    assert {x[1]: x[4] for x in decontamination.search_all(raw, np.array([0, len(raw)]), items)} == {x[1]: x[4] for x in whole}


def test_empty_tables(spark):
    items = spark.createDataFrame([(1, "some words of a benchmark")], "item_id long, text string")
    assert find_items(docs(spark, []), items).count() == 0
    assert find_items(docs(spark, [(1, "x")]), items.limit(0)).count() == 0
    assert clean(docs(spark, [(1, "x"), (2, None)]), items.limit(0)).count() == 2


def test_places():
    keep = np.random.default_rng(1).random(200_000) < 0.3
    at = np.flatnonzero(keep)
    assert places(keep, [0, 5, len(at) - 1]) == [at[0], at[5], at[-1]]


def test_alignment_of_many_at_once():
    items = indexed([(0, "abcdefgh ijkl"), (1, "short one")])
    width = region_width(items)
    regions = np.zeros((2, 13 + width), np.uint8)
    regions[0, 3:16] = np.frombuffer(b"abcdXfgh ijkl", np.uint8)
    regions[1, 7:15] = np.frombuffer(b"shrt one", np.uint8)
    cost, start, end = aligned(regions, np.array([0, 1]), items, placed=True)
    assert (cost.tolist(), start.tolist(), end.tolist()) == ([1, 1], [3, 7], [16, 15])


def test_registered_query(spark):
    """Documents that hold an item word for word are found, and what is found keeps to the bound."""
    rows = [(r.doc_id, r.text) for r in texts(spark).select("doc_id", "text").collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r.edits for r in op8_benchmark_decontamination(spark, SMALL).collect()}
    plain = {(d, i) for d, t in rows for i, b in bench if folded_text(b) in folded_text(t or "")}
    assert plain and plain <= set(got)
    assert {k for k, edits in got.items() if edits == 0} == plain
    by, raw = dict(bench), dict(rows)
    sample = sorted(got)[:5]
    assert slow([(d, raw[d]) for d, _ in sample], [(i, by[i]) for _, i in sample]).items() >= {k: got[k] for k in sample}.items()
