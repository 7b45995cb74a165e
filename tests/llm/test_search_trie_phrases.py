"""Exact search, prefix trie and collocations against slow versions and their SQL."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import differences, duck
from tests.llm.cases import SMALL, docs
from tokenledger.llm import collocations, lookup, prefix_trie, top_products
from tokenledger.llm.countmin import LEAST_CELLS, sketch, width_for
from tokenledger.llm.running import running


@pytest.mark.parametrize(
    "module,query,sql",
    [
        (top_products, "op11_exact_top_k_search", "OP11_SQL"),
        (prefix_trie, "op12_conversation_prefix_trie", "OP12_SQL"),
        (collocations, "op13_collocation_mining", "OP13_SQL"),
    ],
)
def test_registered_queries(spark, module, query, sql):
    assert differences(getattr(module, query)(spark, SMALL), duck(SMALL), getattr(module, sql)) == []


# -- search ------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, score string, rank string"


def slow_search(rows, k):
    valid = []
    for i, v in rows:
        if v is not None and all(x is not None and np.isfinite(x) and np.isfinite(1024 * x) for x in v):
            valid.append((i, [int(np.floor(1024 * x)) for x in v]))
    out = []
    for n, (i, q) in enumerate(valid):
        if i is None or i % 100:
            continue
        found = [(-max(-(1 << 63), min((1 << 63) - 1, sum(a * b for a, b in zip(q, v)))), j is None, j) for m, (j, v) in enumerate(valid) if m != n]
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found[:k])]
    return sorted(out, key=str)


def test_search_of_awkward_vectors(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.25, 1.0)) for _ in range(4)]) for i in range(150)]
    rows += [(100, None), (300, [None, 1.0]), (400, [float("nan"), 1.0]), (500, [float("inf"), 0.0]), (600, [1.5e308] * 2)]
    rows += [(None, [1.0, 1.0, 1.0, 1.0]), (200, []), (300, [0.3, 0.3]), (300, [0.3, 0.3]), (0, rows[0][1]), (100, [-1.0] * 4)]
    rows += [(700 + i, [1.0] * 4) for i in range(200)]  # ties
    rows += [(900, [3e9, 1.0, 0.0, 0.0]), (1000, [1e17, -1e17, 5.0, 5.0]), (1001, [-1e17, 2e17, 1.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(5)
    for k in (1, 10):
        got = sorted(map(tuple, top_products.top_products(frame, k=k).collect()), key=str)
        assert got == slow_search(rows, k)
    assert top_products.top_products(frame.where("false")).count() == 0
    few = frame.where("vec_id IN (0, 1, 2)")
    assert top_products.top_products(few).count() == 6  # two rows have id 0, each has three others


def test_merging_level_by_level(spark, monkeypatch):
    monkeypatch.setattr(top_products, "FAN_IN", 2)
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(400)]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS).repartition(16)
    assert sorted(map(tuple, top_products.top_products(frame, k=3).collect()), key=str) == slow_search(rows, 3)


def test_blocks_of_a_tile():
    rng = np.random.default_rng(1)
    for scale in (4, 1 << 30, 1 << 45):
        scores = rng.integers(-scale, scale, (7, 90)) * (1 if scale > 4 else 1)
        for k in (1, 5, 90, 200):
            row, column = top_products.best(scores, k)
            for q in range(7):
                want = sorted(range(90), key=lambda c: (-int(scores[q, c]), c))[:k]
                assert sorted(column[row == q].tolist()) == sorted(want)


# -- trie --------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, n string"


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {}
    for c in own:
        own[c].sort()
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = [x[2:] for x in own.get(c - c % 5, [])[:h]] + [x[2:] for x in own[c][h:]]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        bytes_ = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * bytes_
    for node, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(node))))
        parent = min(members[node[:-1]]) if node else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(node), parent, len(m), len(children[node]), leaves[node], saved[node], sha))
    return sorted(out, key=str)


def trie_of(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).repartition(7)
    return sorted(map(tuple, prefix_trie.prefix_trie(frame).collect()), key=str)


def test_trie_of_awkward_conversations(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 3)
    monkeypatch.setattr(prefix_trie, "PIECE", 40)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(("user", None)), rng.choice(("a", "b", None, "é語"))) for c in range(120) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", f"turn {t}") for c in (1000, 1003, 1007, 2001) for t in range(60)]  # long shared ways
    rows += [(c, 0, "user", "the same conversation") for c in range(3000, 3200)]
    rows += [(None, 0, "user", "nobody's"), (5000, None, None, None), (5001, 3, "user", "x"), (5001, None, "user", "first")]
    rows += [(6000, 1, "user", "twice"), (6000, 1, "user", "twice"), (6004, 7, "assistant", "")]
    assert trie_of(spark, rows) == slow_trie(rows)


def test_tries_of_little(spark):
    assert trie_of(spark, []) == [] and trie_of(spark, [(None, 1, "a", "b")]) == []
    one = [(7, 0, "user", "alone")]
    assert trie_of(spark, one) == slow_trie(one)


def test_running_sums_over_a_hot_group(spark):
    """A group that lies in many partitions is summed as if it lay in one."""
    rng = random.Random(2)
    rows = [(rng.choice((5, 5, 5, 1, 9)), i, rng.getrandbits(40)) for i in range(3000)] + [(9, 10_000 + i, i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "k long, o long, v long")
    got = running(frame.repartition(6), "k", ["o"], {"p": ("v", 12345), "s": ("v", 1)}).collect()
    assert len(got) == len(rows)
    want, so_far = {}, {}
    for k, o, v in sorted(rows):
        n, p, s = so_far.get(k, (0, 0, 0))
        so_far[k] = (n + 1, (p + v * pow(12345, n, 1 << 64)) % (1 << 64), s + v)
        want[k, o] = so_far[k]
    assert {(r.k, r.o): (r.n, r.p % (1 << 64), r.s) for r in got} == want


def test_a_sketch_never_denies_a_frequent_hash(spark, monkeypatch):
    rows = spark.range(0, 50_000).select((F.col("id") % 20_000).alias("h"))
    find = lambda batch: [batch.column(0).to_numpy().astype(np.uint64)]
    for depth in (1, 2):
        counted = sketch(rows.repartition(9), find, 3, LEAST_CELLS, depth)
        answer = counted.may_reach(np.arange(40_000, dtype=np.uint64))
        assert answer[:10_000].all()
        assert answer[20_000:].mean() < 0.3
    assert [width_for(n) for n in (0, 1 << 20, 1 << 60)] == [1 << 16, 1 << 18, 1 << 28]


# -- collocations ------------------------------------------------------------------------


def test_collocations_of_awkward_texts(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HEAVY", 4)
    rng = random.Random(7)
    words = ["Alpha", "beta", "gámma", "ÀB", "d", " ", "eps-ilon", "x'y", "\x00", "語"]
    rows = [(i, "".join(rng.choice(words) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "\x0c", "!?")) for _ in range(rng.randint(0, 60))), rng.choice(("en", "de", None, "und"))) for i in range(300)]
    rows += [(1, None, "en"), (None, "", "fr"), (1, "...,,,", "en"), (7, "one two three four five " * 40, "fr"), (7, "one two three four five " * 40, "fr")]
    rows += [(8, "hot " * 3000, "xx"), (9, "rare words only here", "yy")]
    frame = docs(spark, rows).withColumnRenamed("source", "w1").withColumnRenamed("n_chars", "phrase")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [(t, lang) for _, t, lang in rows])
    assert differences(collocations.collocations(frame), con, collocations.OP13_SQL) == []
    sql = collocations.OP13_SQL.replace(">= 30", ">= 5").replace("<= 2000", "<= 3")
    assert differences(collocations.collocations(frame, least=5, top=3), con, sql) == []
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_window_counts(spark):
    rows = [(1, "a b c d e. a b"), (2, "A B, c")]
    got = {tuple(r)[:5]: r.n for r in collocations.windows(docs(spark, rows), least=1).groupBy("lang", *collocations.WORDS).agg(F.sum("n").alias("n")).collect()}
    want = Counter()
    for piece in (["a", "b", "c", "d", "e"], ["a", "b"], ["a", "b"], ["c"]):
        for i in range(len(piece)):
            want[("und", *(piece[i : i + 4] + [""] * 4)[:4])] += 1
    assert got == want
