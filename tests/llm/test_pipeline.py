import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import SMALL, docs, texts
from tests.llm.test_decontamination import slow as slow_items
from tests.llm.test_repeats import slow as slow_repeats
from tests.llm.test_simhash import slow_components, slow_fingerprint
from tests.llm.test_tokens import PATH, best_fit_decreasing
from tokenledger.llm.common import written
from tokenledger.llm.repeats import kept, stretches, whole_characters

STAGES = dict(corpus_pipeline.STAGES)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, str(r)))


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage returns, on the smallest tables."""
    out, own = [texts(spark)], texts(spark)
    for name, stage in corpus_pipeline.STAGES:
        own = written(stage(spark, own, SMALL), "step")
        out.append(own)
    return out


def test_columns_stay(steps):
    assert all(step.columns == steps[0].columns for step in steps[1:-1])


def test_clean_documents_pass_language_id(steps):
    assert rows(steps[1]) == rows(steps[0])


def test_one_of_each_group_stays(steps):
    before = rows(steps[1])
    marks = [(r[0], slow_fingerprint(r[1])) for r in before]
    assert rows(steps[2]) == [r for r, c in zip(before, slow_components(marks)) if r[0] == c]
    assert len(rows(steps[2])) < len(before)


def test_repeats_are_cut(steps):
    before = rows(steps[2])
    want = []
    for r, gone in zip(before, slow_repeats([r[1] for r in before], corpus_pipeline.REPEATED_BYTES)):
        raw = np.frombuffer(r[1].encode(), np.uint8)
        at = np.flatnonzero(gone)
        text = kept(raw, *whole_characters(raw, *stretches(at, at + 1))).decode()
        want.append((r[0], text, *r[2:4], len(text) if gone.any() else r[4]))
    assert rows(steps[3]) == want


def test_leaks_are_dropped(spark, steps):
    bench = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    left, gone = rows(steps[4]), [r for r in rows(steps[3]) if r not in rows(steps[4])]
    assert gone and len(left) + len(gone) == len(rows(steps[3]))
    found = slow_items([r[:2] for r in gone if len(r[1]) < 3000], bench)
    assert {d for d, _ in found} == {r[0] for r in gone if len(r[1]) < 3000}


def test_packing_takes_all(spark, steps):
    library = Tokenizer.from_file(PATH)
    packed, left = steps[5].collect(), rows(steps[4])
    sizes = {r[0]: len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in left}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == sizes
    assert len({r.sequence_id for r in packed}) == len(best_fit_decreasing([r.length for r in packed], 4096))


def test_run_gives_the_last_step(spark, steps):
    assert rows(corpus_pipeline.run(spark, SMALL).drop("sequence_id", "offset")) == rows(steps[5].drop("sequence_id", "offset"))


ODD = [(1, None), (2, ""), (8, "the and of it " * 30, "en"), (8, "the and of it " * 30, "en"), (None, "der und die das " * 30, "de"), (7, "123 456")]


@pytest.mark.parametrize("given", [ODD, []], ids=["odd", "none"])
def test_odd_rows_pass(spark, given):
    own = docs(spark, given)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        own = written(stage(spark, own, SMALL), "odd")
        assert own.columns == docs(spark, []).columns
    assert sorted(str(r.doc_id) for r in own.collect()) == (["8", "None"] if given else [])
    assert STAGES["best-fit packing"](spark, own, SMALL).count() == len({r.doc_id for r in own.collect()})


def test_rows_with_other_columns(spark):
    frame = docs(spark, ODD).selectExpr("*", "2 AS length", "3 AS fingerprint", "4 AS component_id", "5 AS spans")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, SMALL).columns == frame.columns


FIRST, SECOND = "one two three four five six " * 20, "red green blue white black grey " * 20
NEAR = FIRST.upper()
UNLIKE = [" ".join(f"{w}{i}" for w in "abcdefgh") for i in range(6)]


@pytest.mark.parametrize(
    "given, want",
    [
        ([(None, t) for t in UNLIKE], [(None, t) for t in UNLIKE]),
        ([(5, FIRST), (5, SECOND)], [(5, FIRST), (5, SECOND)]),
        ([(5, FIRST), (5, SECOND), (3, NEAR)], [(3, NEAR), (5, SECOND)]),
        ([(None, FIRST), (9, NEAR)], [(9, NEAR)]),
        ([(None, FIRST)] * 3 + [(4, SECOND)] * 2, [(None, FIRST), (4, SECOND)]),
    ],
    ids=["null", "repeated", "repeated-near", "null-last", "equal"],
)
def test_each_group_keeps_one_row(spark, given, want):
    got = STAGES["SimHash near-dedup"](spark, docs(spark, given), SMALL).select("doc_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_repeated_short_words_are_cut(spark):
    """A passage counts from 51 words on, also in fewer than REPEATED_BYTES bytes; fifty such words stay."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(1, 4)))
    more, fifty = " ".join(word() for _ in range(51)), " ".join(word() for _ in range(50))
    assert len(more) < corpus_pipeline.REPEATED_BYTES
    given = [(1, f"Xyz {more} zyx"), (2, f"Uvw \"{more}.\" wvu"), (3, f"Rst {fifty} tsr"), (4, f"Opq {fifty} qpo")]
    got = {r.doc_id: (r.text, r.n_chars) for r in STAGES["suffix-array dedup"](spark, docs(spark, given), SMALL).collect()}
    want = {1: "Xyz  zyx", 2: 'Uvw "." wvu', 3: given[2][1], 4: given[3][1]}
    assert got == {k: (t, len(t)) for k, t in want.items()}
