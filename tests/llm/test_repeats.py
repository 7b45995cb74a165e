import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.cases import SMALL, docs, texts
from tokenledger.llm import lookup, repeats
from tokenledger.llm.repeats import kept, op1_suffix_array_dedup, repeated_windows, stretches, whole_characters, with_repeats, without_repeats, word_windows


def slow(rows, length):
    """For each text its removed places, straight from the definition."""
    raw = [(t or "").encode() for t in rows]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def removed(df):
    """(doc_id, bytes, places removed) of what with_repeats returns."""
    out = []
    for batch in df.toArrow().to_batches():
        for doc_id, (raw, start, end) in zip(batch.column("doc_id").to_pylist(), repeats.cut(batch)):
            gone = np.zeros(len(raw), bool)
            for a, b in zip(start, end):
                gone[a:b] = True
            out.append((doc_id is not None, doc_id or 0, raw.tobytes(), gone.tolist()))
    return sorted(out)


def expected(rows, length):
    gone = slow([t for _, t in rows], length)
    return sorted((d is not None, d or 0, (t or "").encode(), g.tolist()) for (d, t), g in zip(rows, gone))


def mosaic(seed, n=60):
    """Texts put together from a few passages, cut and changed here and there; some copies, some periodic."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 6)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    out = []
    for _ in range(n):
        own = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            a = rng.randint(0, len(p) // 2)
            own.append(p[a : a + rng.randint(10, 300)] if rng.random() < 0.7 else p)
            own.append(word())
        out.append(" ".join(own))
    return out + ["ab" * 100, "xab" * 40 + "ab" * 60, "", out[0], out[1]]


@pytest.mark.parametrize("length", [24, 50, 90])
@pytest.mark.parametrize("chunk,kinds", [(70, 1000), (1 << 17, 1000), (1 << 17, 2)])
def test_same_as_definition(spark, monkeypatch, length, chunk, kinds):
    monkeypatch.setattr(repeats, "CHUNK", chunk)
    rows = list(enumerate(mosaic(length)))
    # Chunks are set in this process only, so with small ones the runs are checked here.
    if chunk == 70:
        for text in mosaic(length)[:20]:
            raw = np.frombuffer(text.encode(), np.uint8)
            found = list(repeats.runs(raw, length))
            covered = [w for first, last, *_ in found for a, b in zip(first, last) for w in range(a, b + 1)]
            assert covered == list(range(max(0, len(raw) - length + 1)))
        return
    assert removed(with_repeats(docs(spark, rows), length, kinds)) == expected(rows, length)


def test_awkward_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "short"), (None, "x" * 120), (None, "y" * 30), (5, "the same row " * 9)]
    rows += [(5, "the same row " * 9), (5, "another text with that id, long enough to hold a window"), (6, long), (7, "z" + long[1000:])]
    frame = docs(spark, rows).withColumnRenamed("source", "anchor").withColumnRenamed("lang", "start")
    assert removed(with_repeats(frame, 50)) == expected(rows, 50)
    assert with_repeats(docs(spark, []), 50).count() == 0


def test_text_keys(spark):
    frame = docs(spark, [(1, "q" * 99), (2, "other words in a text")]).selectExpr("string(doc_id) AS doc_id", "text")
    assert {r.doc_id: r["__spans"] is not None for r in with_repeats(frame, 20).collect()} == {"1": True, "2": False}


def test_digits_find_what_a_counter_finds():
    rng = random.Random(4)
    base = bytes(rng.choice(b"ab") for _ in range(300))
    kinds = [base[a : a + rng.randint(45, 90)] for a in (rng.randint(0, 200) for _ in range(30))]
    seen = Counter(k[i : i + 45] for k in kinds for i in range(len(k) - 44))
    want = [[i for i in range(len(k) - 44) if seen[k[i : i + 45]] > 1] for k in kinds]
    assert [w.tolist() for w in repeated_windows(kinds, 45)] == want


def test_stretches():
    start, end = stretches(np.array([5, 1, 2, 9, 20]), np.array([9, 3, 4, 10, 22]))
    assert list(zip(start.tolist(), end.tolist())) == [(1, 4), (5, 10), (20, 22)]


def test_code_points_stay_whole():
    raw = np.frombuffer("aé語b".encode(), np.uint8)
    start, end = whole_characters(raw, np.array([2]), np.array([5]))
    assert kept(raw, start, end).decode() == "aé語b"
    start, end = whole_characters(raw, np.array([1]), np.array([5]))
    assert kept(raw, start, end).decode() == "a語b"


def test_texts_without_repeats(spark):
    shared = "a passage of some words that stands in two texts: é語é語 "
    rows = [(1, "first " + shared + "end"), (2, "second " + shared), (3, None), (4, "nothing in it"), (5, ""), (6, shared), (7, shared)]
    got = {r.doc_id: (r.text, r.n_chars) for r in without_repeats(docs(spark, rows), 40).collect()}
    assert got[3] == (None, None) and got[4] == ("nothing in it", 13) and got[5] == ("", 0)
    assert got[6][0] == "" and got[6][1] == 0
    assert got[2][0] == "second" and got[1][0] == "firstend"
    assert without_repeats(docs(spark, rows), 40).columns == docs(spark, rows).columns


def test_registered_query(spark):
    rows = [(r.doc_id, r.text) for r in texts(spark).select("doc_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in op1_suffix_array_dedup(spark, SMALL).collect()}
    for (doc_id, text), gone in zip(rows, slow([t for _, t in rows], 400)):
        raw = text.encode()
        n_spans = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum())
        sha = hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
        assert got[doc_id][:4] == (len(raw), int(gone.sum()), n_spans, sha)
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore")
        assert left in got[doc_id][4] or len(got[doc_id][4]) <= len(left) + 4 * n_spans
    assert any(x[1] for x in got.values())


def test_word_windows():
    text = "-- ab 'c d' é, (e) ... ffffff g"
    start, end = word_windows(np.frombuffer(text.encode(), np.uint8), 3, 10)
    assert [text.encode()[a:b].decode() for a, b in zip(start, end)] == ["ab 'c d", "c d' é", "d' é, (e"]
    assert [len(x) for x in word_windows(np.frombuffer(b"", np.uint8), 3, 9)] == [0, 0]


def test_a_window_in_a_long_repeat_counts_for_one_outside(spark):
    short = " ".join("abcdefgh")
    long = f"these words go on {short} and on to the end of it"
    rows = [(1, f"X {long} 1"), (2, f"Y {long} 2"), (3, f"zyx {short} xyz"), (4, "q q q q q q q q q q")]
    got = {r.doc_id: r.text for r in without_repeats(docs(spark, rows), 40, words=8).collect()}
    assert got == {1: "X1", 2: "Y2", 3: "zyx  xyz", 4: rows[3][1]}


@pytest.mark.parametrize("doc_id", [None, 7])
def test_many_equal_rows_beside_another_text_give_one_run_each(spark, monkeypatch, doc_id):
    """Equal rows are one kind of run, whose bytes are fetched once, however many rows there are."""
    groups = []
    real = repeats._sorted_groups
    monkeypatch.setattr(repeats, "_sorted_groups", lambda g, n: (groups.extend(len(r.runs) for r in g.collect()), real(g, n))[1])
    monkeypatch.setattr(lookup, "HEAVY", 2)  # so that the hot anchor is a heavy key
    passage = "".join(random.Random(1).choices("abcdefghijk", k=90))
    rows = [(doc_id, f"one {passage} end")] * 10_000 + [(8, f"two {passage} other")]
    got = with_repeats(docs(spark, rows), 50)
    spans = {tuple(map(tuple, r["__spans"] or [])) for r in got.where("doc_id = 8").collect()}
    assert got.count() == 10_001 and got.where("__spans IS NULL").isEmpty()
    assert len(spans) == 1 and groups and max(groups) <= 4


@pytest.mark.parametrize("passages", [None, 7])
def test_a_line_said_over_and_over_is_one_row_of_its_text(spark, monkeypatch, passages):
    """However often texts say it, one row each goes through the joins. One text says a passage again between other words."""
    monkeypatch.setattr(lookup, "HEAVY", 2)
    real, joined = repeats.lookup, []
    monkeypatch.setattr(repeats, "lookup", lambda rows, *a, **b: (joined.append(rows.count()), real(rows, *a, **b))[1])
    line, apart = "one line of words ", sentences(7, 12)
    rows_of = {}
    for times in (5, 50):
        joined.clear()
        rows = [(i, f"{i} {line * times}{i}") for i in range(6)]
        rows += [(6, "".join(f"{apart} {i:04} " for i in range(5))), (7, f"{sentences(8, 20)} {line * 3}{apart}"), (8, line * times), (8, line * times)]
        got = removed(with_repeats(docs(spark, rows), 50, passages=passages))
        if not passages:
            assert got == expected(rows, 50)
        else:
            assert all(not e or g for x, y in zip(got, expected(rows, 50)) for g, e in zip(x[3], y[3]))
        rows_of[times] = list(joined)
    assert len(rows_of[5]) == 2 and all(many <= few + 5 for few, many in zip(rows_of[5], rows_of[50])), rows_of


def test_one_of_equals():
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 400):
        owner = np.sort(rng.integers(0, 5, n))
        first = np.arange(n) * 3
        kind, anchor = rng.integers(0, 6, n), rng.integers(0, 2, n)
        last = first + kind
        one, times, at, start, end = repeats.one_of_equals(owner, first, last, anchor, kind, 4)
        groups = {}
        for i, key in enumerate(zip(owner.tolist(), kind.tolist(), anchor.tolist())):
            groups.setdefault(key, []).append(i)
        assert np.all(np.diff(one) > 0) and times.sum() == n
        covered = {(owner[i], p) for i, a, b in zip(at.tolist(), start.tolist(), end.tolist()) for p in range(a, b)}
        several = [i for i, t in zip(one.tolist(), times.tolist()) if t > 1]
        want = {(owner[i], p) for g in groups.values() for i in g if g[0] in several for p in range(first[i], last[i] + 4)}
        assert covered == want


def sentences(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(n))


@pytest.mark.parametrize("kinds", [1000, 1])
def test_passages_of_words_in_fewer_bytes(spark, kinds):
    """Against all windows of words, counted; `cuts` tells them from the stretches found by bytes."""
    rng = random.Random(9)
    shared = [sentences(i, 30) for i in range(6)]
    rows = []
    for i in range(40):
        parts = [sentences(100 + i, rng.randint(0, 30))]
        for p in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, 15)
            parts += [" ".join(p.split()[a : a + rng.randint(5, 30)]), sentences(1000 + i, rng.randint(0, 9))]
        rows.append((i, " ".join(parts)))
    rows += [(40, rows[0][1]), (41, None), (42, "na " * 40)]
    raws = [np.frombuffer((t or "").encode(), np.uint8) for _, t in rows]
    found = [list(zip(*(x.tolist() for x in word_windows(r, 12, 110)))) for r in raws]
    seen = Counter(r[a:b].tobytes() for r, own in zip(raws, found) for a, b in own)
    by_bytes = {d: g for _, d, _, g in expected(rows, 110)}
    got = {}
    for batch in with_repeats(docs(spark, rows), 110, kinds, passages=12).toArrow().to_batches():
        for doc_id, (raw, *both) in zip(batch.column("doc_id").to_pylist(), repeats.cuts(batch)):
            masks = [np.zeros(len(raw), bool) for _ in both]
            for mask, (start, end) in zip(masks, both):
                for a, b in zip(start, end):
                    mask[a:b] = True
            got[doc_id] = [m.tolist() for m in masks]
    only_words = 0
    for (doc_id, _), raw, own in zip(rows, raws, found):
        every = np.array(by_bytes[doc_id], bool)
        for a, b in own:
            if seen[raw[a:b].tobytes()] > 1:
                every[a:b] = True
        assert got[doc_id] == [by_bytes[doc_id], every.tolist()]
        only_words += every.sum() > sum(by_bytes[doc_id])
    assert only_words > 5


def test_op1_shows_passages_of_over_fifty_words_under_400_bytes(spark, tmp_path):
    passage = " ".join(w[:5] for w in sentences(1, 55).split())
    rows = [(1, f"{sentences(2, 80)} {passage} {sentences(3, 40)}"), (2, f"{sentences(4, 9)} {passage} {sentences(5, 90)}"), (3, sentences(6, 200))]
    assert len(passage.encode()) < 400
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 0, 0]  # by contract
    assert [got[i].text for i in (1, 2, 3)] == [t.replace(passage, "") for _, t in rows]
    assert [got[i].n_cut for i in (1, 2, 3)] == [len(passage.encode())] * 2 + [0]
