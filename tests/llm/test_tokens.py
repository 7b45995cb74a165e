import random
import zlib
from bisect import insort
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import SMALL, docs, texts
from tokenledger.llm import word_tokens
from tokenledger.llm.packing import Capacities, op6_best_fit_packing, pack, pieces, plan, sequences
from tokenledger.llm.token_files import mapped, op7_token_files, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", "áb ́x H̱o H̱x", "<|endoftext|>hi <|startoftext|>", "<|STARTOFTEXT|>X", "it's don't I'LL",
    "ΣΑΣ. ΟΔΟΣ, İstanbul", "x y z​q\x1c1\x85b", "a.b,c!!?? 12ab 3.5.", "ﬁ Å Å한 ㎏",
    "日本語。テスト ,., ...", "w.'s 's,", "a×b÷c Ñañ É.é", "\n\n", "end", "x" * 3000, "é" * 900, "no" + " " * 400,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def encoded(words, rows):
    raw = [x.encode() for x in rows]
    bounds = np.cumsum([0] + [len(x) for x in raw])
    ids, at = words.encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    return [ids[a:b].tolist() for a, b in zip(at, at[1:])]


@pytest.mark.parametrize("block", [40, 1 << 20])
@pytest.mark.parametrize("table", [60, 1 << 20])
def test_ids_are_those_of_the_library(library, monkeypatch, spark, block, table):
    monkeypatch.setattr(word_tokens, "BLOCK_BYTES", block)
    words = word_tokens.WordTokens(PATH, table)
    rows = ODD + [r.text for r in texts(spark).select("text").limit(25).collect()]
    assert encoded(words, rows) == [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        word_tokens.WordTokens(public_tokenizers.path("byte_bpe_50k.json"))


def best_fit_decreasing(lengths, size):
    """Item by item, with a sorted list of (room, bin)."""
    rooms, out = [], []
    for n in sorted(lengths, reverse=True):
        at = next((i for i, (room, _) in enumerate(rooms) if room >= n), None)
        room, own = rooms.pop(at) if at is not None else (size, len(out))
        if at is None:
            out.append([])
        out[own].append(n)
        if room - n:
            insort(rooms, (room - n, own))
    return out


def from_plan(runs, counts):
    bins = {}
    for length, n in counts.items():
        own = np.flatnonzero(runs["length"] == length)
        for rank in range(n):
            run = own[np.searchsorted(runs["rank"][own], rank, "right") - 1]
            ahead, each = rank - runs["rank"][run], runs["each"][run]
            offset = runs["offset"][run] + ahead % each * length
            bins.setdefault(int(runs["sequence"][run] + ahead // each), []).append((int(offset), length))
    return bins


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 200))]
    bins = from_plan(plan(Counter(lengths), size), Counter(lengths))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    slow = best_fit_decreasing(lengths, size)
    # which of several equally full bins takes a piece is free; how full the bins get is not
    assert sorted(sum(n for _, n in own) for own in bins.values()) == sorted(map(sum, slow))


def test_tightest_room():
    tree = Capacities(10)
    for room in (3, 7, 10):
        tree.add(room, 1)
    assert [tree.tightest(n) for n in (1, 3, 4, 8)] == [3, 3, 7, 10]
    tree.add(10, -1)
    assert tree.tightest(8) is None


ROWS = [(5, "alpha beta"), (1, None), (2, ""), (5, "alpha beta"), (None, "gamma, delta"), (9, "long text " * 50)] + [
    (20 + i, "word " * (i % 7)) for i in range(30)
]


def test_packing(spark, library):
    got = pack(docs(spark, ROWS).withColumn("length", F.col("n_chars")), PATH, size=16, with_ids=True).collect()
    want = Counter()
    for doc_id, text in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 16):
            own = ids[k : k + 16]
            want[doc_id, k // 16, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), tuple(own)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1])
        assert sum(n for _, n in own) <= 16
    assert len(by) == len(best_fit_decreasing([r.length for r in got], 16))


def test_sequences_and_pieces(spark):
    packed = pack(docs(spark, ROWS), PATH, size=16, with_ids=True)
    whole = sequences(packed).collect()
    assert sum(len(r.ids) for r in whole) == packed.agg({"length": "sum"}).first()[0]
    assert pieces(docs(spark, ROWS), PATH, size=16).columns == ["doc_id", "piece", "start", "length", "ids_crc32"]


def test_packing_of_nothing(spark):
    assert pack(docs(spark, []), PATH).count() == 0


def test_token_files(spark, tmp_path, library):
    folder = f"file://{tmp_path}/files"
    write_token_files(docs(spark, ROWS), folder, PATH)
    got = read_token_files(spark, folder, with_ids=True).orderBy("start").collect()
    at = 0
    assert [r.doc_id for r in got] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d or 0))
    texts_of = {}
    for doc_id, text in ROWS:
        texts_of.setdefault(doc_id, library.encode(text or "", add_special_tokens=False).ids + [2])
    for r in got:
        ids = texts_of[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    write_token_files(docs(spark, []), str(tmp_path / "none"), PATH)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_files_are_mapped(spark, tmp_path):
    write_token_files(docs(spark, [(1, "one two")]), str(tmp_path / "one"), PATH)
    import pyarrow.fs

    found = mapped(pyarrow.fs.LocalFileSystem(), str(next((tmp_path / "one").glob("*.bin"))), np.dtype("<u2"))
    assert isinstance(found, np.memmap) and found[-1] == 2


def test_registered_queries(spark, library):
    rows = texts(spark).select("doc_id", "text").orderBy("doc_id").collect()
    ids = [library.encode(r.text or "", add_special_tokens=False).ids for r in rows]
    got = op7_token_files(spark, SMALL).orderBy("doc_id").collect()
    assert [r.n_tokens for r in got] == [len(x) + 1 for x in ids]
    assert [r.start for r in got] == list(np.cumsum([0] + [len(x) + 1 for x in ids])[:-1])
    assert [r.ids_crc32 for r in got] == [zlib.crc32(np.array(x + [2], "<u4").tobytes()) for x in ids]
    packed = op6_best_fit_packing(spark, SMALL).collect()
    assert sum(r.length for r in packed) == sum(len(x) + 1 for x in ids)
    lengths = [r.length for r in packed]
    assert len({r.sequence_id for r in packed}) == len(best_fit_decreasing(lengths, 4096))
