import datetime as dt
import json
import random

import pytest
from helpers import T0
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gatelens import schemas
from gatelens.operators import chunks as C


def stream(events, end=b"data: [DONE]\n\n"):
    lines = [e if isinstance(e, bytes) else b"data: " + json.dumps(e, ensure_ascii=False).encode() + b"\n\n" for e in events]
    return b"".join(lines) + end


def recorded(spark, streams, sizes=(7,), provider_type="openai"):
    """Chunks of byte streams {request_id: bytes}, cut into pieces of the given sizes in turn."""
    rows = []
    for rid, data in streams.items():
        at, n = 0, 0
        while at < len(data):
            size = sizes[n % len(sizes)]
            rows.append((rid, provider_type, n, T0 + dt.timedelta(milliseconds=10 * n), bytearray(data[at : at + size])))
            at, n = at + size, n + 1
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schemas.CHUNKS)


def openai(spark, events, **cut):
    merged = C.merge_openai(C.sse_events(recorded(spark, {"r": stream(events)}, **cut)))
    row = merged.withColumn("usage", F.to_json("usage")).first()
    return row.asDict(recursive=True)


def delta(idx=0, finish=..., **fields):
    choice = {"index": idx, "delta": fields}
    if finish is not ...:
        choice["finish_reason"] = finish
    return {"id": "c1", "created": 5, "model": "gpt-4", "choices": [choice]}


def test_content_over_events(spark):
    doc = openai(spark, [delta(role="assistant", content="Hello"), delta(content=" wörld"), delta(content="!"), delta(finish="stop")])
    assert (doc["id"], doc["object"], doc["model"], doc["created"]) == ("c1", "chat.completion", "gpt-4", 5)
    choice = doc["choices"][0]
    assert choice["message"]["content"] == "Hello wörld!" and choice["message"]["role"] == "assistant"
    assert choice["finish_reason"] == "stop" and choice["message"]["tool_calls"] == []
    assert choice["message"]["reasoning_content"] is None


def test_reasoning(spark):
    doc = openai(spark, [delta(reasoning_content="So"), delta(reasoning_content=None), delta(reasoning_content=" far")])
    assert doc["choices"][0]["message"]["reasoning_content"] == "So far"
    doc = openai(spark, [delta(reasoning_content=None, content="x")])
    assert doc["choices"][0]["message"]["reasoning_content"] is None


def test_tool_calls(spark):
    def call(i, arguments, **more):
        return delta(tool_calls=[{"index": i, "function": {"arguments": arguments} | more.pop("fn", {})} | more])

    doc = openai(
        spark,
        [
            call(0, "", id="a", type="function", fn={"name": "weigh"}),
            call(0, '{"crate":'),
            call(2, "2+", id="b", type="function", fn={"name": "calc"}),
            call(0, '17}'),
            call(2, "2"),
            delta(finish="tool_calls"),
        ],
    )
    calls = doc["choices"][0]["message"]["tool_calls"]
    assert calls[0] == {"id": "a", "type": "function", "function": {"name": "weigh", "arguments": '{"crate":17}'}}
    assert calls[1] == {"id": None, "type": None, "function": None}  # the gap
    assert calls[2]["function"] == {"name": "calc", "arguments": "2+2"}
    inputs = C.tool_inputs(C.merge_openai(C.sse_events(recorded(spark, {"r": stream([call(0, '{"a":1}', id="i")])}))))
    assert inputs.selectExpr("id", "variant_get(input, '$.a', 'int') a").first() == ("i", 1)


def test_several_calls_and_choices_in_one_event(spark):
    event = {
        "id": "c1",
        "choices": [
            {"index": 1, "delta": {"content": "B", "tool_calls": [{"index": 0, "function": {"arguments": "x"}}, {"index": 0, "function": {"arguments": "y"}}]}},
            {"index": 0, "delta": {"content": "A"}},
            {"index": 0, "delta": {"content": "a"}},
        ],
    }
    doc = openai(spark, [event, event])
    assert [c["message"]["content"] for c in doc["choices"]] == ["AaAa", "BB"]
    assert doc["choices"][1]["message"]["tool_calls"][0]["function"]["arguments"] == "xyxy"


def test_choices_out_of_order_and_padded(spark):
    doc = openai(spark, [delta(2, content="third"), delta(0, content="first")])
    assert [c["index"] for c in doc["choices"]] == [0, 1, 2]
    assert [c["message"]["content"] for c in doc["choices"]] == ["first", "", "third"]


def test_usage_empty_delta_and_nulls(spark):
    use = {"prompt_tokens": 10, "completion_tokens": 5, "total_tokens": 15, "prompt_tokens_details": {"cached_tokens": 2}}
    doc = openai(
        spark,
        [delta(), delta(content=None), {"id": "c1", "choices": [], "usage": use}, {"id": "c1", "choices": [], "usage": None}],
    )
    assert json.loads(doc["usage"]) == use
    assert doc["choices"][0]["message"]["content"] == ""
    doc = openai(spark, [{"id": "only"}])
    assert doc["choices"] == [] and doc["usage"] is None


def test_finish_reason_null_after_value(spark):
    assert openai(spark, [delta(finish="stop"), delta(finish=None)])["choices"][0]["finish_reason"] is None


def test_lines_that_are_no_events(spark):
    noise = [b": ping\n", b"data:\n", b"data: \n", b"data: not json\n", b"event: x\r\n", b"data:[DONE]\n"]
    doc = openai(spark, [*noise, delta(content="ok"), b'data:{"id":"c1","choices":[{"delta":{"content":"!"}}]}\r\n'])
    assert doc["choices"][0]["message"]["content"] == "ok!"


def test_text_after_a_value_is_no_event(spark):
    good = json.dumps(delta(content="ok")).encode()
    bad = [good + b" x", good + b"}", good + good, good + b"," + good, good + b"] x", b"", b" "]
    lines = b"".join(b"data: " + line + b"\n" for line in [*bad, good])
    events = C.sse_events(recorded(spark, {"r": lines})).collect()
    assert len(events) == 1


def test_carriage_returns_and_copies(spark):
    parts = [json.dumps(delta(content=c)).encode() for c in "abc"]
    lines = b"data: " + parts[0] + b"\rdata: " + parts[1] + b"\r\ndata: " + parts[2] + b"\n"
    rows = recorded(spark, {"r": lines}, sizes=(3, 11))
    merged = C.merge_openai(C.sse_events(rows.union(rows.filter("seq % 2 = 0")))).first()
    assert merged.choices[0].message.content == "abc"


def test_no_end_marker_and_no_final_line_break(spark):
    data = stream([delta(content="a"), delta(content="b")], end=b"").rstrip(b"\n")
    merged = C.merge_openai(C.sse_events(recorded(spark, {"r": data})))
    assert merged.first().choices[0].message.content == "ab"


def test_long_response_over_many_slices_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(C, "EVENTS_PER_PIECE", 16)
    words = [f"w{n}é " for n in range(300)]
    chunks = recorded(spark, {"r": stream([delta(content=w) for w in words])}, sizes=(5, 1, 11, 64))
    lines = C.sse_events(chunks, chunks_per_slice=8)
    assert lines.count() == 300
    assert C.merge_openai(lines).first().choices[0].message.content == "".join(words)
    parts = C.response_parts(lines).orderBy("piece").collect()
    assert len(parts) > 10 and "".join(r.content for r in parts) == "".join(words)


@settings(max_examples=8, deadline=None)
@given(
    st.dictionaries(st.sampled_from("abc"), st.lists(st.text(max_size=20), min_size=1, max_size=12), min_size=1),
    st.lists(st.integers(1, 90), min_size=1, max_size=4),
    st.integers(1, 6),
)
def test_any_cut_gives_the_same_text(spark, texts, sizes, per_slice):
    streams = {rid: stream([delta(content=t) for t in parts]) for rid, parts in texts.items()}
    merged = C.merge_openai(C.sse_events(recorded(spark, streams, sizes), chunks_per_slice=per_slice))
    got = {r.request_id: r.choices[0].message.content for r in merged.collect()}
    expected = {rid: "".join(parts) for rid, parts in texts.items()}
    assert got == expected


# ---- content blocks -------------------------------------------------------------------------------------------------


def start(mid="m1", **use):
    return {"type": "message_start", "message": {"id": mid, "model": "claude", "usage": use}}


def block(i, **fields):
    return {"type": "content_block_start", "index": i, "content_block": fields}


def add(i, **fields):
    return {"type": "content_block_delta", "index": i, "delta": fields}


def ending(reason="end_turn", **use):
    return {"type": "message_delta", "delta": {"stop_reason": reason}, "usage": use}


def anthropic(spark, events, **cut):
    chunks = recorded(spark, {"r": stream(events, b"")}, provider_type="anthropic", **cut)
    return C.merge_anthropic(C.sse_events(chunks)).first().asDict(recursive=True)


def test_message(spark):
    doc = anthropic(
        spark,
        [
            start(input_tokens=10, cache_read_input_tokens=3, output_tokens=1),
            block(0, type="text", text=""),
            {"type": "ping"},
            add(0, type="text_delta", text="Hello"),
            add(0, type="text_delta", text=" wörld!"),
            {"type": "content_block_stop", "index": 0},
            ending(output_tokens=7),
            {"type": "message_stop"},
        ],
    )
    assert (doc["id"], doc["type"], doc["role"], doc["model"], doc["stop_reason"]) == ("m1", "message", "assistant", "claude", "end_turn")
    assert len(doc["content"]) == 1 and doc["content"][0]["text"] == "Hello wörld!"
    assert doc["usage"] == {
        "input_tokens": 10, "output_tokens": 7, "cache_creation_input_tokens": None, "cache_read_input_tokens": 3,
    }


def test_message_start_only(spark):
    doc = anthropic(spark, [start()])
    assert doc["content"] == [] and doc["stop_reason"] is None


def test_blocks_out_of_order_with_gap(spark):
    doc = anthropic(spark, [start(), block(2, type="text", text="c"), block(0, type="text", text=""), add(0, text="a"), add(2, text="d")])
    assert [b and b["text"] for b in doc["content"]] == ["a", None, "cd"]


def test_thinking_and_signature(spark):
    doc = anthropic(
        spark,
        [start(), block(0, type="thinking", thinking="", signature=""), add(0, thinking="hm"), add(0, thinking="m"), add(0, signature="s1"), add(0, signature="s2")],
    )
    assert (doc["content"][0]["thinking"], doc["content"][0]["signature"], doc["content"][0]["text"]) == ("hmm", "s1s2", None)


@pytest.mark.parametrize(
    ("parts", "expected"),
    [(['{"crate":17,"un', 'it":"kg","', 'net":true}'], {"crate": 17, "unit": "kg", "net": True}), (["{bad"], {}), ([], {"given": 1})],
)
def test_tool_input(spark, parts, expected):
    events = [start(), block(0, type="tool_use", id="t1", name="find", input={"given": 1})]
    doc = anthropic(spark, events + [add(0, type="input_json_delta", partial_json=p) for p in parts])
    assert json.loads(doc["content"][0]["input"]) == expected
    assert doc["content"][0]["name"] == "find"


def test_deltas_without_or_before_their_start(spark, monkeypatch):
    for per_piece in (1, 2, 3, 4096):
        monkeypatch.setattr(C, "EVENTS_PER_PIECE", per_piece)
        doc = anthropic(
            spark,
            [start(), add(0, text="early"), add(7, text="never"), add(0, text="early"), block(0, type="text", text=""), add(0, text="a"), add(0, text="b"), add(0, text="c")],
        )
        assert [b["text"] for b in doc["content"]] == ["abc"]


@pytest.mark.parametrize("per_piece", [1, 2, 4096])
def test_a_block_that_starts_again(spark, monkeypatch, per_piece):
    monkeypatch.setattr(C, "EVENTS_PER_PIECE", per_piece)

    def start(**block):
        return {"type": "content_block_start", "index": 0, "content_block": block}

    def more(**fields):
        return {"type": "content_block_delta", "index": 0, "delta": fields}

    events = [
        more(text="lost"), start(type="text", text="", id="i"), more(text="old", thinking="kept "),
        start(type="other", text="n"), more(text="ew", thinking="on"),
    ]
    rows = recorded(spark, {"r": stream(events, b"")}, provider_type="anthropic")
    block = C.merge_anthropic(C.sse_events(rows)).first().content[0]
    assert (block.type, block.id, block.text, block.thinking) == ("other", "i", "new", "kept on")


def test_two_tools(spark):
    chunks = recorded(
        spark,
        {
            "r": stream(
                [start(), block(0, type="tool_use", id="a", name="x"), block(1, type="tool_use", id="b", name="y"),
                 add(1, partial_json='{"n":2}'), add(0, partial_json='{"n":1}')],
                b"",
            )
        },
        provider_type="anthropic",
    )
    got = C.tool_inputs(C.merge_anthropic(C.sse_events(chunks))).selectExpr("position", "id", "variant_get(input, '$.n', 'int') n")
    assert sorted(tuple(r) for r in got.collect()) == [(0, "a", 1), (1, "b", 2)]


def test_stats_from_chunks(spark):
    use = {"prompt_tokens": 10, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 2}}
    one = recorded(spark, {"o": stream([delta(content="x"), {"usage": use}])}, sizes=(50,))
    two = recorded(spark, {"a": stream([start(input_tokens=10, cache_creation_input_tokens=3, cache_read_input_tokens=5), ending(output_tokens=8)], b"")}, sizes=(4000,), provider_type="anthropic")
    begun = spark.createDataFrame(
        [("o", "p", T0 - dt.timedelta(milliseconds=40)), ("a", "q", T0 - dt.timedelta(microseconds=12345))],
        "request_id string, provider_name string, start_ts timestamp",
    )
    got = {r.request_id: r for r in C.stats_from_chunks(one.unionByName(two), begun).collect()}
    assert (got["o"].input_tokens, got["o"].output_tokens, got["o"].cached_tokens) == (10, 5, 2)
    assert (got["a"].input_tokens, got["a"].output_tokens, got["a"].cached_tokens) == (18, 8, 5)
    assert got["o"].time_to_first_token_ms == 40.0 and got["o"].latency_ms > 40.0
    assert got["a"].latency_ms == round(12.345, 2) and got["a"].provider_name == "q" and got["a"].is_streaming


@pytest.mark.parametrize("piece", [1, 4096])
def test_every_key_of_blocks_and_usage_is_kept(spark, monkeypatch, piece):
    monkeypatch.setattr(C, "EVENTS_PER_PIECE", piece)
    doc = anthropic(
        spark,
        [
            start(input_tokens=10, service_tier="standard", speed=None),
            block(0, type="redacted_thinking", data="x\"y"),
            block(2, type="web_search_tool_result", tool_use_id="srv", content=[{"url": "u"}]),
            block(2, type="web_search_tool_result", content=[], **{'odd "key"': 1.5}),
            ending(output_tokens=7, server_tool_use={"web_search_requests": 1}),
            ending(output_tokens=8, server_tool_use={"web_search_requests": 2}),
        ],
    )
    found = [b and json.loads(b.toJson()) for b in doc["start_blocks"]]
    assert found == [
        {"type": "redacted_thinking", "data": "x\"y"},
        None,
        {"type": "web_search_tool_result", "tool_use_id": "srv", "content": [], 'odd "key"': 1.5},
    ]
    assert json.loads(doc["whole_usage"].toJson()) == {
        "input_tokens": 10, "service_tier": "standard", "speed": None, "output_tokens": 8,
        "server_tool_use": {"web_search_requests": 2},
    }
