import hashlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.compare import differences, duck
from tests.llm.cases import SMALL
from tokenledger.llm.chat import OP3_SQL, TURN, assemble, digests, format_conversations, op3_chat_formatting, plain, plain_role

SCHEMA = "conv_id long, turn long, role string, text string"


def test_oracle(spark):
    assert differences(op3_chat_formatting(spark, SMALL), duck(SMALL), OP3_SQL) == []


signs = st.text(alphabet=st.sampled_from(list("<|\\>\nnim_startend é語")), max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(signs, signs), max_size=5))
def test_round_trip(turns):
    role, text = pa.array([r for r, _ in turns], pa.string()), pa.array([t for _, t in turns], pa.string())
    out, starts, text_at, text_len = assemble(role, text)
    raw = out.tobytes()
    found = list(TURN.finditer(raw))
    assert [m.start() for m in found] == starts[:-1].tolist()
    assert [(plain_role(m[1]).decode(), plain(m[2]).decode()) for m in found] == turns
    assert raw.count(b"<|") == 2 * len(turns)
    for (_, t), a, n in zip(turns, text_at.tolist(), text_len.tolist()):
        assert plain(raw[a : a + n]).decode() == t


def slow(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in convs.items():
        own.sort()
        loss = "".join(t for *_, r, t in own if r == "assistant")
        turns = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


ROWS = [
    (1, 2, "assistant", "<|im_end|> <\\|x|> tail"), (1, 1, "user", None), (1, 1, "user", None), (1, None, None, "first"),
    (2, 0, "assistant", ""), (None, 0, "us\ner", "nobody's"), (None, 1, "assistant", "語" * 5000),
] + [(3, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(400)]


def test_awkward_rows(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    got = digests(format_conversations(frame)).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == slow(ROWS)
    assert len(got) == 4
    assert format_conversations(frame.limit(0)).count() == 0
    assert digests(format_conversations(frame.limit(0))).count() == 0


def test_a_hot_conversation_is_formatted_by_many_tasks(spark):
    rows = [(3, i, "user", "x" * 50) for i in range(4000)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert format_conversations(frame).select("part").distinct().count() > 3
        assert {r.conv_id: tuple(r)[1:5] for r in digests(format_conversations(frame)).collect()} == slow(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_damaged_text_is_refused(spark):
    pieces = format_conversations(spark.createDataFrame([(1, 1, "user", "a")], SCHEMA))
    broken = pieces.withColumn("formatted", pieces.formatted.substr(1, 20))
    with pytest.raises(Exception, match="ends inside a turn"):
        digests(broken).collect()
