import zlib

import numpy as np
import pytest

from tests.llm.cases import SMALL, docs, texts
from tokenledger.llm import importance, language_id
from tokenledger.llm.importance import fit as fit_ratios
from tokenledger.llm.importance import grams, op10_quality_classifier, resample, weigh
from tokenledger.llm.repeats import Hashes, mixed
from tokenledger.llm.language_id import count_vectors, fit, held_out, op2_language_id, predict

MIDDLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def languages(spark):
    return {r.doc_id: r for r in op2_language_id(spark, MIDDLE).collect()}


def test_held_out_accuracy(spark, languages):
    rows = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang").collect()
    assert len(languages) == len(rows)
    assert all(languages[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    unseen = [r for r in rows if languages[r.doc_id].held_out]
    assert np.mean([languages[r.doc_id].lang_pred == r.lang for r in unseen]) > 0.99
    assert all(0 <= r.score <= 1 for r in languages.values())
    assert not any(r.rejected for r in languages.values())


AWKWARD = [(1, None), (2, ""), (3, "123 %%% ..."), (4, "the"), (5, "語語語 語"), (None, "the and of the"), (6, "x" * 40)]


def test_awkward_texts(spark):
    training = [(100 + i, "the thing and the other of them " * 3, "en") for i in range(20)]
    training += [(200 + i, "der die das und nicht mit einer ", "de") for i in range(20)] + [(300, "no language", None), (301, None, "xx")]
    model = fit(docs(spark, training))
    assert sorted(set(model.languages)) == ["de", "en"]
    frame = docs(spark, AWKWARD + [(6, "x" * 40)]).withColumnRenamed("source", "score")
    got = {r.doc_id: r for r in predict(frame, model, ["doc_id"]).collect()}
    assert {d: got[d].lang_pred for d in (1, 2, 3, 4, None)} == {1: "und", 2: "und", 3: "und", 4: "en", None: "en"}
    assert all(got[d].rejected and got[d].score == 0 for d in (1, 2, 3))
    assert got[5].rejected and got[5].lang_pred in ("de", "en")
    assert not got[None].rejected
    kept = predict(frame, model, frame.columns, ("a", "b", "c"))
    assert kept.columns == [*frame.columns, "a", "b", "c"] and kept.count() == len(AWKWARD) + 1
    assert predict(docs(spark, []), model, ["doc_id"]).count() == 0
    nothing = fit(docs(spark, []))
    assert {r.lang_pred for r in predict(frame, nothing, ["doc_id"]).collect()} == {"und"}
    assert docs(spark, [(None, "x")]).select(held_out().alias("h")).first().h is False


def test_long_foreign_texts_are_rejected(spark):
    dutch = "De kat zat op de mat en keek naar buiten terwijl het regende. Wij gaan morgen met de trein naar Amsterdam om onze "
    dutch += "vrienden te bezoeken en samen te eten in een klein restaurant aan de gracht, want daar is het altijd gezellig. "
    swedish = "Katten satt på mattan och tittade ut medan det regnade. I morgon åker vi tåg till Stockholm för att besöka våra "
    swedish += "vänner och äta tillsammans på en liten restaurang vid vattnet, där det alltid finns god mat och trevliga människor. "
    rng = np.random.default_rng(3)
    letters = lambda signs, n: "".join(rng.choice(list(signs), n))
    random = [letters("abcdefghijklmnopqrstuvwxyz    ", n) for n in (300, 2000, 20_000)]
    coded = [letters("0123456789abcdef", 20_000), letters("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 5000)]
    foreign = [dutch, dutch * 5, swedish, swedish * 5, *random, *coded]
    short = ["A.", "The thing.", "De la", "Und die der", "Que los"]
    learned = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    # A very short text in the sample sets no bound for long ones.
    model = fit(learned.unionByName(docs(spark, [(10**9 + i, "A.", k) for i in range(3) for k in ("en", "de", "fr", "es")])))
    frame = docs(spark, list(enumerate(foreign + short)))
    got = [r.rejected for r in predict(frame, model, ["doc_id"]).orderBy("doc_id").collect()]
    assert got == [True] * len(foreign) + [False] * len(short)
    assert not predict(learned, model, ["doc_id"]).where("rejected").count()


def test_long_texts_count_whole(monkeypatch):
    text = ("Wörter und mehr " * 300).encode()
    data, bounds = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    whole = count_vectors(data, bounds)
    monkeypatch.setattr(language_id, "BLOCK_BYTES", 1000)
    parts = count_vectors(data, bounds)
    assert abs(whole.sum() - parts.sum()) <= 4 * len(text) // 1000


def bag(text, buckets=1 << 14):
    """Buckets of a text's grams, run by run."""
    kinds = [[0, 1, 2][importance.KIND[b]] for b in (text or "").encode()]
    raw, out, own = (text or "").lower().encode(), [], b""
    for i, b in enumerate(raw):
        if own and kinds[i] != kinds[i - 1]:
            out.append(own) if kinds[i - 1] else None
            own = b""
        own += bytes([b])
    out.append(own) if own and kinds[-1] else None
    one = [Hashes(np.frombuffer(x, np.uint8)).all(len(x)) for x in out]
    two = [mixed(a * np.uint64(3) + b) for a, b in zip(one, one[1:])]
    return np.array([int(h[0]) >> 64 - buckets.bit_length() + 1 for h in one + two], np.int64)


def slow_ratios(rows, good, buckets=1 << 14):
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for doc_id, text in rows:
        found = bag(text, buckets)
        raw += np.bincount(found, minlength=buckets)
        if doc_id in good:
            target += np.bincount(found, minlength=buckets)
    p = [np.log((c + 1) / (c.sum() + buckets)) for c in (raw, target)]
    return p[1] - p[0]


ROWS = [(i, f"good words here {i}") for i in range(20)] + [(50 + i, f"BAD*** words### {i}") for i in range(20)]
ROWS += [(90, None), (91, ""), (None, "nobody's words"), (7, "good words here 7"), (92, "w, " * 100_000)]


def test_weights_are_sums_of_log_ratios(spark):
    good = spark.createDataFrame([(i,) for i in range(20)] + [(3,), (None,), (4000,)], "doc_id long")
    frame = docs(spark, ROWS).withColumnRenamed("source", "good").withColumnRenamed("lang", "rank")
    ratios = fit_ratios(frame, good)
    assert np.allclose(ratios, slow_ratios(ROWS, set(range(20))))
    got = weigh(frame, ratios).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t for d, t in ROWS if d == r.doc_id)
        found = bag(text)
        assert r.n_grams == len(found) and np.isclose(r.log_weight, ratios[found].sum())


def test_the_greatest_are_selected(spark):
    good = spark.createDataFrame([(i,) for i in range(20)], "doc_id long")
    got = resample(docs(spark, ROWS), good, 0.5).collect()
    order = sorted(got, key=lambda r: r["rank"])
    assert [r["rank"] for r in order] == list(range(1, len(ROWS) + 1))
    assert all(a.noisy_weight >= b.noisy_weight for a, b in zip(order, order[1:]))
    assert sum(r.selected for r in got) == len(ROWS) // 2
    assert resample(docs(spark, []), good, 0.5).count() == 0


def test_gumbel_draws_follow_the_weights(spark):
    """Of two kinds of equal numbers with weights 3 to 1, the first drawn is of the first kind three times in four."""
    rows = docs(spark, [(i, "a" if i % 2 else "b") for i in range(4000)])
    ratios = np.zeros(1 << 14)
    ratios[bag("a")] = np.log(3)
    marks = np.array([r.noisy_weight for r in weigh(rows, ratios).orderBy("doc_id").collect()])
    first = (marks[1::2] > marks[0::2]).mean()
    assert abs(first - 0.75) < 0.03


def test_long_texts_lose_nothing_where_they_are_cut(monkeypatch):
    text = "some words, more words! " * 50 + "x" * 300 + " end"
    raw = np.frombuffer(text.encode(), np.uint8)
    for size in (1 << 18, 100, 7):
        monkeypatch.setattr(importance, "BLOCK_BYTES", size)
        found = np.concatenate([f for f, _ in grams(raw, np.array([0, len(raw)]))])
        assert sorted(found) == sorted(bag(text))


def test_weights_tell_good_from_bad(spark):
    got = {r.doc_id: r for r in op10_quality_classifier(spark, MIDDLE).collect()}
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()
    good = [got[r.doc_id].log_weight for r in labels if r.quality == 1]
    bad = [got[r.doc_id].log_weight for r in labels if r.quality == 0]
    assert np.mean([b < g for b in bad for g in good]) > 0.97
    kept = [got[r.doc_id].selected for r in labels if r.quality == 1]
    assert np.mean(kept) > 0.93
    assert texts(spark).count() == op10_quality_classifier(spark, SMALL).count()


def test_rows_of_one_id_are_drawn_independently(spark):
    rows = [(None, f"text {i}") for i in range(40)] + [(7, f"text {i}") for i in range(40)] + [(7, None), (None, None)]
    got = weigh(docs(spark, rows), np.zeros(16)).collect()
    noise = [r.noisy_weight - r.log_weight for r in got]
    assert len(got) == len(rows) and len(set(noise)) == len(rows)
    again = weigh(docs(spark, rows), np.zeros(16)).collect()
    assert sorted(noise) == sorted(r.noisy_weight - r.log_weight for r in again)
