"""Token estimates against the published tokenizer and by hand."""

import json
import random

import pytest

from weir.functions import tokens


def test_counts_equal_the_published_tokenizer():
    library, published = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    own = tokens.load(published.path("byte_bpe_50k.tiktoken"))
    other = library.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "word", "'ll", "12", "é", "中", "😀", "_", "!!", "====", "aaaa", "ab"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)] + ["a" * 20_000, "ab" * 9_000, "", "Grüße an alle, die da sind."]
    assert [own.count(t) for t in texts] == [len(other.encode_ordinary(t)) for t in texts]


def test_what_is_counted_of_each_api():
    ranks = tokens.Ranks({bytes([k]): k for k in range(256)})
    size = lambda *xs: sum(len((x if isinstance(x, str) else tokens._json(x)).encode()) for x in xs)
    use, result, tool = {"type": "tool_use", "id": "t", "name": "f", "input": {}}, {"type": "tool_result", "content": "é"}, {"name": "f"}
    request = {"system": [{"type": "text", "text": "sys"}], "messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}, use, {"type": "image", "source": "x"}]}, {"role": "user", "content": [result]}], "tools": [tool], "tool_choice": {"type": "auto"}}
    answer = {"content": [{"type": "thinking", "thinking": "why"}, {"type": "text", "text": "<think>why</think>so"}, use]}
    assert tokens.counts(ranks, "anthropic", json.dumps(request), json.dumps(answer)) == (size("sys", "user", "hi", "assistant", "hm", "ok", use, "user", result, tool, {"type": "auto"}), size("why", "\n", "so", "\n", use))
    call = {"id": "c", "type": "function", "function": {"name": "f", "arguments": "{}"}}
    request = {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image_url"}]}, {"role": "assistant", "content": None, "tool_calls": [call]}]}
    answer = {"choices": [{"message": {"reasoning": "r", "reasoning_content": "r", "content": "<think>r</think>x", "tool_calls": [call]}}]}
    assert tokens.counts(ranks, "openai-chat", json.dumps(request), json.dumps(answer)) == (size("user", "a", "assistant", call), size("r", "\n", "x", "\n", call))
    item = {"type": "function_call", "name": "f", "arguments": "{}"}
    request = {"instructions": "be", "input": [{"role": "user", "content": [{"type": "input_text", "text": "q"}]}, item, {"type": "function_call_output", "output": "o"}]}
    answer = {"output": [{"type": "reasoning", "summary": [{"text": "s"}]}, {"type": "message", "content": [{"type": "output_text", "text": "m"}]}, item]}
    assert tokens.counts(ranks, "openai-responses", json.dumps(request), json.dumps(answer)) == (size("be", "user", "q", item, "o"), size("s", "\n", "m", "\n", item))
    assert all(tokens.counts(ranks, a, x, x) == (0, 0) for a in tokens._ASKED for x in (None, "", "nonsense", "[1]", "{}", '{"messages": 5, "input": "x", "output": [3], "content": {}}'))


def test_backfill_fills_what_is_missing_and_no_more(spark):
    q, r = json.dumps({"messages": [{"role": "user", "content": "hi"}]}), json.dumps({"choices": [{"message": {"content": "yes"}}]})
    rows = [("a", "openai-chat", 200, 0, None, q, r), ("b", "openai-chat", 200, 5, 0, q, r), ("c", "openai-chat", 500, None, None, q, r), ("d", "gemini-aistudio", 200, None, None, q, r), ("e", "openai-chat", 204, None, None, q, r), ("f", "openai-chat", 200, None, None, q, None)]
    spans = spark.createDataFrame(rows, "id string, wire_api string, status_code int, input_tokens long, output_tokens long, request_body string, response_body string")
    told = lambda df: {x.id: (x.input_tokens, x.output_tokens) for x in df.collect()}
    once = tokens.backfill(spans, None)
    want = {"a": (6, 3), "b": (5, 0), "c": (None, None), "d": (None, None), "e": (6, 3), "f": (None, None)}
    assert told(once) == want == told(tokens.backfill(once, None)) and once.columns == spans.columns
    assert told(tokens.backfill(spans, None, limit=1)) == want | {"e": (None, None)} and told(tokens.backfill(spans, None, dry_run=True)) == {"a": (6, 3), "e": (6, 3)}


def test_spans_with_estimates_by_a_vocabulary(spark, tmp_path):
    import base64

    from weir.operators import calls

    ranks = tmp_path / "ranks"
    ranks.write_bytes(b"".join(base64.b64encode(bytes([k])) + b" %d\n" % k for k in range(256)))
    pairs = [("content-type", "application/json")]
    body = json.dumps({"model": "m", "messages": [{"role": "user", "content": "hi"}]})
    answers = ['{"choices": [{"message": {"content": "yes"}}]}', '{"choices": [{"message": {"content": "yes"}}], "usage": {"prompt_tokens": 9, "completion_tokens": 0}}']
    stream = 'data: {"id": "x", "choices": [{"delta": {"content": "fo"}}]}\n\ndata: {"choices": [{"delta": {"content": "ur"}}]}\n\ndata: [DONE]\n\n'
    rows = [("s", "1", k, "2", 80, "POST", "/v1/chat/completions", [*pairs, ("authorization", "Bearer sk-1")], body, 200, pairs, a, k == 2, 10, 20, 30) for k, a in enumerate([*answers, stream])]
    names = "source_id string, client_ip string, client_port int, server_ip string, server_port int, method string, uri string, request_headers array<struct<name:string,value:string>>, request_body string, status_code int, response_headers array<struct<name:string,value:string>>, response_body string, is_sse boolean, request_us long, response_us long, complete_us long"
    got = {r.client_port: (r.input_tokens, r.output_tokens) for r in calls.to_spans(spark.createDataFrame(rows, names), str(ranks)).collect()}
    assert got == {0: (6, 3), 1: (9, 0), 2: (6, 4)}
    whole = calls.to_spans(spark.createDataFrame(rows, names)).where("client_port = 2").first()
    assert json.loads(whole.response_body)["choices"][0]["message"]["content"] == "four" and whole.assistant_text == "four"
