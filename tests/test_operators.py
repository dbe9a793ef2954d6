"""Rules that the registered queries don't reach."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from weir.functions import agents, json_paths, messages, trajectory, wire
from weir.operators import exchanges, listing, metrics, predicates, proxy, turns
from weir.sources import packets
from weir.store import Store, merged_metadata, retained


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_validation():
    assert predicates.check_range(0, 10) == (0, 10_000_000)
    for bad in ((-1, 5), (5, 1), (0, predicates.LATEST_SECOND + 1)):
        with pytest.raises(ValueError):
            predicates.check_range(*bad)
    with pytest.raises(ValueError):
        predicates.check_buckets(0, 10**9, "10s")
    with pytest.raises(ValueError):
        predicates.check_buckets(0, 10, "2m")
    with pytest.raises(ValueError):
        metrics.field("nonsense")
    assert predicates.csv_list(" a, ,b ") == ["a", "b"]
    assert listing.decode_cursor(listing.encode_cursor([1, "a"])) == [1, "a"]
    with pytest.raises(ValueError):
        listing.decode_cursor("zz")


def test_each_rollup_row_is_in_one_tier(spark):
    rows = spark.createDataFrame([("a", "m", "s"), ("a", "m", "*"), ("*", "*", "s"), ("*", "*", "*"), ("a", "*", "*")], "wire_api string, model string, server_ip string")
    assert [r.t for r in rows.select(predicates.tier_name().alias("t")).collect()] == ["wms", "wm", "s", "all", "other"]
    count = lambda **k: rows.where(predicates.tier(**k)).count()
    assert count() == count(wire_apis=["a"]) == count(server_ips=["s"]) == count(group_by="model") == count(wire_apis=["a"], server_ips=["s"]) == 1


def test_weighted_percentiles(spark):
    rows = spark.createDataFrame([(10.0, 1), (20.0, 3), (None, 5)], "ttft_p95 double, ttft_count long")
    assert rows.agg(metrics.field("ttft_p95")).first()[0] == 17.5
    assert rows.where("ttft_count > 9").agg(metrics.field("ttft_p95")).first()[0] is None


def test_preview_counts_characters(spark):
    for n, want in ((500, 500), (501, 501)):
        assert len(one(spark, turns.preview(F.lit("é" * n)))) == want
    assert one(spark, turns.preview(F.lit("é" * 501))).endswith("…")
    assert one(spark, turns.preview(F.lit(None).cast("string"))) is None


def test_turn_without_user_is_dropped_and_tail_is_incomplete(spark):
    schema = "source_id string, session_id string, id string, request_us long, end_us long, is_terminal boolean, is_user_start boolean, is_auxiliary boolean, model string, subagent string, tool_surface string, input_tokens long, output_tokens long, user_input string, assistant_text string, finish_reason string"
    row = lambda s, k, term, user, aux=False: ("src", s, k, int(k[1:]), int(k[1:]) + 1, term, user, aux, "m", None, None, 1, 1, "u", "a", "stop")
    calls = spark.createDataFrame([row("a", "c1", False, True), row("a", "c2", True, False), row("a", "c3", False, True), row("b", "c4", True, False), row("a", "c5", False, False, True)], schema)
    got = {r.turn_id: (r.status, r.span_ids) for r in turns.assemble(calls).collect()}
    assert got == {"src:a:0": ("complete", ["c1", "c2"]), "src:a:1": ("incomplete", ["c3"])}


def test_turns_under_way_overlap_the_range(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("b", 5, 30), ("c", 30, 40), ("d", 31, 40)], "turn_id string, start_us long, end_us long")
    assert {r.turn_id for r in turns.under_way(rows, 10, 30).collect()} == {"a", "b", "c"}


def test_pairing_overwrites_and_ignores(spark):
    rows = [(1, 10, 0, 1, "a"), (1, 20, 0, 2, "b"), (1, 30, 1, 3, "r"), (1, 40, 1, 4, "r"), (2, 5, 1, 9, "r")]
    got = {(r.request, r.response) for r in exchanges.pair(spark.createDataFrame(rows, "flow long, ts_us long, kind int, seq long, label string")).collect()}
    assert got == {(1, None), (2, 3)}


def test_mirror_and_proxy_roles(spark):
    rows = [
        ("t1", "x", 0, 100, "v1"), ("t2", "x", 400, 90, "v2"),  # both ends close: a mirror
        ("p1", "y", 0, 900_000, "v1"), ("p2", "y", 90_000, 800_000, "v2"), ("p3", "y", 400, 900_100, "v3"), ("p4", "y", 90_000, 800_000, "v1"), ("p5", "y", 95_000, 990_000, "v2"), ("p6", "y", 500_000, 800_000, "v2"),
        ("q1", "z", 0, 900, "v1"), ("q2", "z", 10, 800, "v1"),  # one view only: no group
    ]
    got = {r.turn_id: (r.role, r.peers) for r in proxy.groups(spark.createDataFrame(rows, "turn_id string, content string, start_us long, end_us long, view string"), ["content"]).collect()}
    # p4 has the leader's view, p5 ends after it, p6 starts too late
    assert got == {"t1": ("mirror_primary", ["t2"]), "t2": ("mirror_secondary", ["t1"]), "p1": ("proxy_in", ["p2", "p3"]), "p2": ("proxy_out", ["p1", "p3"]), "p3": ("mirror_secondary", ["p1", "p2"])}


def test_sse_framing(spark):
    stream = ": hi\n\nevent: a\ndata: 1\ndata: 2\n\ndata:x\r\n\r\ndata: [DONE]\n\n"
    got = one(spark, wire.sse_events(F.lit(stream)))
    assert [(e["event"], e["data"]) for e in got] == [("a", "1\n2"), (None, "x"), (None, "[DONE]")]


def test_anthropic_stream(spark):
    events = ['{"type": "message_start", "message": {"id": "m1", "model": "c", "usage": {"input_tokens": 7}}}', '{"type": "content_block_delta", "delta": {"text": "Hel"}}', '{"type": "content_block_delta", "delta": {"text": "lo"}}', '{"type": "message_delta", "delta": {"stop_reason": "end_turn"}, "usage": {"output_tokens": 5, "input_tokens": 0}}']
    got = one(spark, wire.fold_anthropic(wire.sse_events(F.lit("".join(f"data: {e}\n\n" for e in events)))))
    assert tuple(got) == ("m1", "c", "Hello", "end_turn", 7, 5)


def test_responses_and_gemini_streams(spark):
    own = ['{"type": "response.created", "response": {"id": "r1", "model": "m"}}', '{"type": "response.output_item.done", "item": {"type": "message", "content": [{"text": "Hi"}]}}', '{"type": "response.completed", "response": {"id": "r1", "model": "m2", "status": "completed", "usage": {"input_tokens": 3, "output_tokens": 4}}}']
    stream = lambda es: wire.sse_events(F.lit("".join(f"data: {e}\n\n" for e in es)))
    assert tuple(one(spark, wire.fold_responses(stream(own)))) == ("r1", "m2", "Hi", "completed", 3, 4)
    assert tuple(one(spark, wire.fold_responses(stream(own[:1])))) == ("r1", "m", "", None, None, None)
    own = ['{"responseId": "g1", "modelVersion": "g", "candidates": [{"content": {"parts": [{"text": "a"}]}}], "usageMetadata": {"promptTokenCount": 1}}', '{"candidates": [{"content": {"parts": [{"functionCall": {"name": "f"}}]}, "finishReason": "STOP"}], "usageMetadata": {"promptTokenCount": 2, "candidatesTokenCount": 5}}']
    assert tuple(one(spark, wire.fold_gemini(stream(own)))) == ("g1", "g", "a", "TOOL_USE", 2, 5)


def test_fnv1a_and_tool_ids(spark):
    def plain(data):
        h = 0xCBF29CE484222325
        for b in data:
            h = (h ^ b) * 0x100000001B3 % 2**64
        return f"{h:016x}"

    for text in ("", "a", "hello\nhi", "é😀" * 20):
        assert one(spark, agents.fnv1a(F.lit(text))) == plain(text.encode())
    assert [one(spark, agents.canonical_tool_id(F.lit(x))) for x in ("callab", "call_ab", "xcall")] == ["call_ab", "call_ab", "xcall"]
    assert one(spark, agents.without_reminders(F.lit("a<system-reminder>x</system-reminder> b <system-reminder>open"))) == "a b"


def test_fold_of_calls(spark):
    rows = [("t", "x", "c1", 0, 50, "k1"), ("t", "x", "c2", 10, 90, "k2"), ("t", "x", "c3", 900_000, 900_010, "k1")]
    got = {r.call_id for r in agents.fold_calls(spark.createDataFrame(rows, "turn_id string, content string, call_id string, start_us long, end_us long, connection string")).collect()}
    assert got == {"c2", "c3"}


def test_bodies(spark):
    got = one(spark, wire.capped(F.lit("é" * 100), 100, 21))
    assert got["dropped"] + got["body"].count("é") * 2 == 200
    assert one(spark, json_paths.render(F.lit(b"\xff\xfe"))) == "[binary, 2 bytes]" and one(spark, json_paths.render(F.lit(b"ok"))) == "ok"
    assert one(spark, json_paths.strings(F.lit("nonsense"))) == [] and one(spark, json_paths.strings(F.lit('["a"]'))) == ["a"]
    assert one(spark, trajectory.arguments(F.lit('{"a": 1'))) == "{}" and one(spark, trajectory.arguments(F.lit('{"a": 1}'))) == '{"a": 1}'


def test_trajectories_rebuild_blocks_and_the_answer(spark):
    request = {
        "system": [{"type": "text", "text": "sys"}], "tools": [{"name": "f"}],
        "messages": [
            {"role": "user", "content": "go"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "f", "input": {"a": 1}}]},
            {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "t1", "content": [{"type": "text", "text": "42"}]}, {"type": "text", "text": "and?"}]},
        ],
    }
    chat = {"messages": [{"role": "user", "content": "go"}]}
    answer = {"choices": [{"message": {"role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "g", "arguments": "nonsense"}}]}}]}
    rows = [("a", "anthropic", json.dumps(request), json.dumps({"content": [{"type": "text", "text": "done"}]})), ("c", "openai-chat", json.dumps(chat), json.dumps(answer)), ("g", "gemini-aistudio", "{}", "{}"), ("n", "anthropic", "{}", None)]
    got = {r.turn_id: json.loads(r.line) for r in trajectory.export(spark.createDataFrame(rows, "turn_id string, wire_api string, request_body string, response_body string")).collect()}
    assert set(got) == {"a", "c"}
    short = lambda m: (m["role"], m.get("content"), m.get("reasoning"), m.get("tool_call_id"), [(c["id"], c["name"], c["arguments"]) for c in m["tool_calls"]])
    assert [short(m) for m in got["a"]["messages"]] == [
        ("system", "sys", None, None, []), ("user", "go", None, None, []), ("assistant", "ok", "hm", None, [("t1", "f", '{"a":1}')]),
        ("tool", "42", None, "t1", []), ("user", "and?", None, None, []), ("assistant", "done", None, None, []),
    ]
    assert [short(m) for m in got["c"]["messages"]] == [("user", "go", None, None, []), ("assistant", None, None, None, [("c1", "g", "{}")])] and got["a"]["tools"] == ['{"name":"f"}']


def test_metadata_patches(spark):
    traces = spark.createDataFrame([("a", {"x": "1", "y": "2"}), ("b", None), ("c", None)], "turn_id string, metadata map<string,string>")
    patches = spark.createDataFrame([("a", {"y": "3"}), ("b", {"z": "4"}), ("q", {"z": "5"})], "turn_id string, patch map<string,string>")
    assert {r.turn_id: r.metadata for r in merged_metadata(traces, patches).collect()} == {"a": {"x": "1", "y": "3"}, "b": {"z": "4"}, "c": None}
    rows = spark.range(3).select((F.col("id") * 86_400_000_000).alias("t"))
    assert retained(rows, "t", 2 * 86_400_000_000, 1).count() == 2 and retained(rows, "t", 0, 0).count() == 3


def test_store_answers_from_its_tables(spark, tmp_path):
    from weir.sources import bridge

    spans = bridge.spans(spark, "/root/testdata/sf0.001")
    store = Store(spark, str(tmp_path))
    store.ingest(spans)
    assert not store.backfill_metrics()
    total = spans.count()
    assert store.summary(0, predicates.LATEST_SECOND).first()["call_count"] == total
    assert store.timeseries(["call_count"], "1h", 0, predicates.LATEST_SECOND // 400, grid=False).count() == 0
    assert store.spans_page(0, predicates.LATEST_SECOND, size=10).count() == 10
    assert store.span("5").count() == 1 and store.services(0, predicates.LATEST_SECOND).count() > 0
    active = store.timeseries(["active_calls_max", "call_count"], "1h", 0, 10_000 * 3600)
    assert active.columns == ["ts", "active_calls_max", "call_count"]
    first = spans.agg(F.min("request_us")).first()[0] // 1_000_000
    rows = store.timeseries(["active_calls_max"], "1h", first - 3600, first + 36_000).collect()
    assert rows and all(r.active_calls_max >= 1 for r in rows)
    plan = store.read("llm_metrics").where("granularity = '1h'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(granularity" in plan


def _packet(seq, payload, flags=16, back=False):
    ends = (bytes([10, 0, 0, 1]), bytes([10, 0, 0, 2]))
    src, dst = ends[::-1] if back else ends
    tcp = struct.pack(">HHIIBBHHH", *((80, 4000) if back else (4000, 80)), seq, 0, 5 << 4, flags, 0, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + src + dst
    return b"\0" * 12 + b"\x08\x00" + ip + tcp


def test_pcap_to_streams(spark, tmp_path):
    folder = tmp_path / "probe"
    folder.mkdir()
    sent = [_packet(99, b"", 2), _packet(100, b"GET "), _packet(108, b"HTTP"), _packet(100, b"GET /abc"[:4]), _packet(104, b"/abc"), _packet(500, b"200", back=True)]
    body = b"".join(struct.pack("<IIII", 1, k, len(p), len(p)) + p for k, p in enumerate(sent))
    (folder / "a.pcap").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + body + b"\0\0")
    own = packets.read_pcap(spark, str(folder))
    assert own.count() == 6 and own.first().source_id == "probe"
    got = {r.sport: bytes(r.data) for r in packets.streams(packets.segments(own)).collect()}
    assert got == {4000: b"GET /abcHTTP", 80: b"200"}
    assert packets.between(own, ("10.0.0.2", 80), ("10.0.0.1", 4000)).count() == 6


def test_user_and_answer_texts(spark):
    def asked(api, body):
        return one(spark, messages.user_text(F.lit(api), F.lit(body)))

    assert asked("anthropic", '{"messages": [{"role": "user", "content": [{"type": "tool_result", "content": "x"}]}]}') is None
    assert asked("anthropic", '{"messages": [{"role": "user", "content": [{"type": "text", "text": "<system-reminder>r</system-reminder>"}, {"type": "text", "text": "go"}]}, {"role": "system", "content": "s"}]}') == "go"
    assert asked("openai-chat", '{"messages": [{"role": "user", "content": "a"}, {"role": "tool", "content": "b"}]}') is None
    assert asked("openai-responses", '{"input": " hello "}') == "hello"
    assert asked("openai-responses", '{"input": [{"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}]}') == "q"
    assert asked("openai-responses", '{"input": [{"type": "function_call_output", "output": "x"}]}') is None
    assert asked("gemini-aistudio", '{"contents": [{"role": "user", "parts": [{"text": "a"}, {"text": "b"}]}]}') == "a\nb"
    said = lambda api, body: one(spark, messages.answer_text(F.lit(api), F.lit(body)))
    assert said("anthropic", '{"content": [{"type": "thinking"}, {"type": "text", "text": "yes"}]}') == "yes"
    assert said("openai-chat", '{"choices": [{"message": {"content": "ok"}}]}') == "ok"
    assert said("openai-responses", '{"output": [{"type": "reasoning"}, {"type": "message", "content": [{"type": "output_text", "text": "ok"}]}]}') == "ok"
    assert said("gemini-aistudio", '{"candidates": [{"content": {"parts": [{"text": "o"}, {"text": "k"}]}}]}') == "ok"
