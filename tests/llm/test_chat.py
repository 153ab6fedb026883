import hashlib
import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meadowlark.llm import chat, queries

ODD = ["", "\\### Assistant: </turn> ok", "<turn>user<text>x</turn>", "\\0\\1\\<", "\n", "é\U0001f600", "a\\", "<"]


def _formatted(spark, records):
    rows = [(k, json.dumps(r) if not isinstance(r, str | None) else r) for k, r in enumerate(records)]
    return chat.format_records(spark.createDataFrame(rows, "conv_id long, record string"))


def _back(df):
    return {r["conv_id"]: [tuple(t) for t in r["t"]] if r["t"] is not None else None for r in df.select("conv_id", chat.parse_turns(F.col("formatted")).alias("t")).collect()}


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "completion": "b"}, {"question": "a", "answer": "b"}, {"instruction": "s", "input": "a", "output": "b"}, {"messages": []},
        {"other": 1}, "no json", None, {"prompt": None, "response": "b"},
    ]
    pair = [("user", "a"), ("assistant", "b")]
    assert _back(_formatted(spark, records)) == {0: pair, 1: pair, 2: pair, 3: pair, 4: [("system", "s"), *pair], 5: [], 6: None, 7: None, 8: None, 9: [("user", ""), ("assistant", "b")]}


def test_further_fields_and_missing_ones(spark):
    two = [{"role": "user", "content": "a", "name": "x"}, {"role": "assistant", "content": "b"}]
    records = [
        {"id": 7, "source": "web", "messages": two}, {"messages": [*two[:1], {"role": "assistant"}]}, {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "!"]}]},
        {"system": "", "prompt": "a", "response": "b"}, {"system": "s", "prompt": "a", "completion": "b", "meta": {"k": [1]}}, {"messages": [{"content": "a"}]}, {"messages": two, "prompt": "p", "completion": "c"},
        {"messages": ["a"]}, [1], {"text": "only"},
    ]
    made = _formatted(spark, records)
    u, b = ("user", "a"), ("assistant", "b")
    expected = {0: [u, b], 1: [u, ("assistant", "")], 2: [("user", "a!")], 3: [u, b], 4: [("system", "s"), u, b], 5: [("", "a")], 6: [u, b]}
    assert _back(made) == {**expected, 7: None, 8: None, 9: None}
    left = {r["conv_id"]: (r["reason"], json.loads(r["unread"])) for r in made.where("reason IS NOT NULL").collect()}
    assert left == {7: ("unknown layout", records[7]), 8: ("no object", [1]), 9: ("unknown layout", records[9])}


def test_the_query_meets_several_layouts(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    varied = chat.conversation_records(rows, varied=True)
    fields = {tuple(sorted(json.loads(r["record"]))) for r in varied.collect()}
    assert {("messages",), ("conversations",), ("id", "messages", "source")} <= fields
    assert _back(chat.format_records(varied)) == _back(chat.format_records(chat.conversation_records(rows)))


def test_fingerprints():
    one = chat.fingerprint(chat.field_paths({"b": 1, "a": [{"x": 1}, {"x": 2, "y": None}]}))
    assert one == chat.fingerprint([".a[].y", ".b", ".a[].x"]) != chat.fingerprint([".a[].x", ".b"])
    assert len(chat.BY_FINGERPRINT) == len(chat.LAYOUTS)


def test_control_strings_round_trip(spark):
    records = [{"messages": [{"role": role, "content": text} for role in ("user", "assistant", *ODD)]} for text in ODD]
    assert _back(_formatted(spark, records)) == {k: [(role, text) for role in ("user", "assistant", *ODD)] for k, text in enumerate(ODD)}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text(st.sampled_from("<\\01/turnex> é\n"), max_size=12)), max_size=5))
def test_any_turns_round_trip(spark, turns):
    df = _formatted(spark, [{"messages": [{"role": r, "content": t} for r, t in turns]}])
    assert _back(df) == {0: turns}
    loss = chat.digests(df).first()
    said = "".join(t for r, t in turns if r == "assistant")
    assert (loss["loss_chars"], loss["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {r["conv_id"]: r for r in queries.op10_chat_formatting(spark, d).collect()}
    turns = {queries.PROBE_ID: [("user", queries.PROBE_TEXT), ("assistant", queries.PROBE_TEXT)]}
    for r in spark.read.parquet(f"{d}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    assert set(rows) == set(turns)
    for i, pairs in turns.items():
        said = "".join(t for r, t in pairs if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for r, t in pairs)
        assert rows[i]["n_turns"] == len(pairs) and rows[i]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert rows[i]["loss_chars"] == len(said) and rows[i]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, 0, None, None, "x"), (1, 0, "user", "b", "x"), (1, 0, "user", "b", "x"), (None, 1, "assistant", "c", "x"), (2, None, "user", "d", "x")], "conv_id long, turn long, role string, text string, record string")
    made = chat.format_records(chat.conversation_records(rows))
    assert _back(made) == {1: [("", ""), ("user", "b"), ("user", "b")], None: [("assistant", "c")], 2: [("user", "d")]}
    assert chat.format_records(chat.conversation_records(rows.where("false"))).collect() == []
