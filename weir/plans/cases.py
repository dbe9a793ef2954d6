"""Requests and answers of all kinds, dealt to the events, with what each must be found to be.

The expectations are written down by hand, case by case, so the SQL of these queries shares no rule with the functions it checks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import messages, wire
from ..operators import calls, services
from ..sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

JSON, KEY, VERSION, BEARER = {"Content-Type": "application/json; charset=utf-8"}, {"X-Api-Key": "sk-ant-1"}, {"Anthropic-Version": "2023-06-01"}, {"Authorization": "Bearer sk-1"}
A, C, R, G = "anthropic", "openai-chat", "openai-responses", "gemini-aistudio"


def _chat(*roles: str, **more: object) -> dict:
    return {"model": "MODEL", "messages": [{"role": r, "content": "hi"} for r in roles], **more}


#: method, path, headers, body; the wire API.
REQUESTS: list[tuple[str, str, dict, object, str | None]] = [
    ("POST", "/v1/messages?beta=true", JSON | VERSION, _chat("user"), A),
    ("GET", "/v1/messages", JSON | VERSION, _chat("user"), None),
    ("POST", "/v1/messages/count_tokens", JSON | VERSION, _chat("user", system="s"), None),
    ("POST", "/v1/messages/count_tokens", JSON | KEY, _chat("user", system="s"), C),
    ("POST", "/v1/messages", KEY, _chat("user"), A),
    ("POST", "/v1/code/worker/events", JSON | VERSION, {"events": [1]}, None),
    ("POST", "/tenant/x", JSON | VERSION, _chat("user", "assistant"), A),
    ("POST", "/tenant/x", JSON | VERSION, _chat("system", "user"), None),
    ("POST", "/tenant/x", JSON, _chat("user", stop_sequences=None), A),
    ("POST", "/tenant/x", JSON, _chat("system", "user"), C),
    ("POST", "/tenant/x", JSON, _chat("user"), C),
    ("POST", "/tenant/x", JSON, {"model": 5, "messages": [{"role": "user", "content": "hi"}]}, None),
    ("POST", "/v1/responses", JSON | BEARER, {"model": "MODEL", "input": "hi"}, R),
    ("POST", "/v1/responses", JSON | {"Authorization": "Bearer sk-ant-2"}, {"model": "MODEL", "input": "hi"}, None),
    ("POST", "/proxy", JSON, {"model": "MODEL", "input": []}, R),
    ("POST", "/v1beta/models/MODEL:streamGenerateContent?alt=sse", {}, {"contents": [{"role": "user", "parts": [{"text": "hi"}]}]}, G),
    ("POST", "/v1internal:generateContent", JSON, {"request": {}, "contents": [{"role": "user"}]}, None),
    ("POST", "/gate", JSON, {"contents": [{"role": "user"}]}, G),
    ("POST", "/v1/chat/completions", BEARER | {"Content-Type": "text/plain"}, _chat("user"), C),
    ("POST", "/v1/chat/completions", {"Content-Type": "text/plain"}, _chat("user"), None),
    ("POST", "/v1/embeddings", JSON | BEARER, {"model": "MODEL", "messages": []}, None),
    ("POST", "/gate", JSON, "not json", None),
]

#: wire API, finish reason, response body; whether the turn ends.
ANSWERS: list[tuple[str, str | None, object, bool]] = [
    (A, "end_turn", {}, True), (A, "tool_use", {}, False), (A, "pause_turn", {}, False), (A, "model_context_window_exceeded", {}, True), (A, "refusal", {}, True), (A, None, {}, False),
    (C, "stop", {}, True), (C, "tool_calls", {}, False), (C, "function_call", {}, False), (C, "content_filter", {}, True),
    (R, "completed", {"output": [{"type": "reasoning"}, {"type": "message"}]}, True), (R, "completed", {"output": [{"type": "message"}, {"type": "function_call"}]}, False),
    (R, "completed", {"output": [{"type": "web_search_call"}]}, False), (R, "failed", {}, False),
    (G, "STOP", {}, True), (G, "TOOL_USE", {}, False), (G, "MALFORMED_FUNCTION_CALL", {}, True), (G, "FINISH_REASON_UNSPECIFIED", {}, False),
]


def _of(role: str, content: object) -> dict:
    return {"messages": [{"role": "user", "content": "first"}, {"role": role, "content": content}]}


_IMAGE, _RESULT = {"type": "image", "source": {}}, {"type": "tool_result", "tool_use_id": "t"}
_REMINDER = {"type": "text", "text": "<system-reminder>be brief</system-reminder> "}
#: wire API, agent, request body; whether a user starts a turn (null: the request does not tell).
STARTS: list[tuple[str, str, object, bool | None]] = [
    (A, "generic", _of("user", "hi"), True), (A, "generic", _of("user", "  "), False), (A, "generic", _of("assistant", "hi"), False),
    (A, "generic", _of("user", [_IMAGE]), True), (A, "generic", _of("user", [_RESULT]), False), (A, "generic", _of("user", [_RESULT, {"type": "text", "text": "go on"}]), True),
    (A, "generic", {"messages": [*_of("user", "hi")["messages"], {"role": "system", "content": "notice"}]}, True),
    (A, "claude-cli", _of("user", [_REMINDER]), False), (A, "generic", _of("user", [_REMINDER]), True), (A, "claude-cli", _of("user", [_REMINDER, _IMAGE]), True), (A, "claude-cli", {"messages": []}, None),
    (C, "opencode", _of("user", "hi"), True), (C, "opencode", _of("tool", "42"), False), (C, "generic", _of("user", [{"type": "text", "text": "hi"}]), True), (C, "generic", _of("user", [{"type": "image_url"}]), False),
    (R, "generic", {"input": "hi"}, True), (R, "generic", {"input": " "}, False), (R, "generic", {"input": [{"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}]}]}, True),
    (R, "generic", {"input": [{"type": "message", "role": "user", "content": [{"type": "input_image"}]}]}, False), (R, "codex-cli", {"input": [{"type": "message", "role": "user", "content": [{"type": "input_image"}]}]}, True),
    (R, "codex-cli", {"input": [{"type": "function_call_output", "call_id": "c"}]}, False), (R, "codex-cli", {"input": [{"type": "custom", "role": "user"}]}, None), (R, "generic", {"input": [{"type": "function_call_output", "call_id": "c"}]}, False),
    (G, "generic", {"contents": [{"role": "user", "parts": [{"text": "hi"}]}]}, True), (G, "generic", {"contents": [{"role": "user", "parts": [{"functionResponse": {"name": "f"}}]}]}, False),
    (G, "generic", {"contents": [{"role": "user", "parts": [{"inlineData": {"data": "x"}}]}]}, True), (G, "generic", {"contents": [{"role": "model", "parts": [{"text": "hi"}]}]}, False),
]


def _used(*names: str, text: str = "do it", tools: object = None, **more: object) -> dict:
    body = {"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": [{"type": "tool_use", "id": f"toolu_{k}", "name": n} for k, n in enumerate(names)]}], **more}
    return body if tools is None else body | {"tools": [{"name": t} for t in tools]}


def _called(*names: str, tools: tuple[str, ...] = (), system: str = "") -> dict:
    said = [{"role": "system", "content": system}] if system else []
    made = [{"id": f"call_{k}", "type": "function", "function": {"name": n, "arguments": "{}"}} for k, n in enumerate(names)]
    return {"messages": [*said, {"role": "user", "content": "do it"}, *([{"role": "assistant", "content": None, "tool_calls": made}] if made else [])], "tools": [{"type": "function", "function": {"name": t}} for t in tools]}


_CLAUDE, _SESSION = {"User-Agent": "claude-cli/2.0"}, {"X-Claude-Code-Session-Id": "s1"}
_CODEX = {"Originator": "codex_cli_rs", "X-Codex-Turn-Metadata": '{"session_id": "cs"}'}
#: wire API, headers, request body; agent, session, tools called, names, surface, topology, whether the call is beside a conversation.
AGENTS: list[tuple[str, dict, object, tuple[str | None, str | None, int, str, str | None, str | None, bool]]] = [
    (A, _CLAUDE | _SESSION, _used("Read", "bash", tools=("Read", "Agent")), ("claude-cli", "s1", 2, "Read,bash", "mixed", "single_agent", False)),
    (A, _CLAUDE | _SESSION, _used("Read", "Bash", "Read", tools=("Read", "Agent")), ("claude-cli", "s1", 3, "Read,Bash", "function_call", "single_agent", False)),
    (A, _CLAUDE | _SESSION, _used("Task", tools=("Agent",)), ("claude-cli", "s1", 1, "Task", "function_call", "orchestrator", False)),
    (A, _CLAUDE | _SESSION, _used("mcp__x__y", tools=("Read",)), ("claude-cli", "s1", 1, "mcp__x__y", "mcp", "sub_agent", False)),
    (A, _CLAUDE | _SESSION, {"messages": [{"role": "user", "content": "title?"}], "tools": []}, ("claude-cli", "s1", 0, "", None, None, True)),
    (A, _CLAUDE | _SESSION, {"messages": [{"role": "user", "content": "check"}], "system": [{"type": "text", "text": "You are a security monitor for autonomous AI coding agents."}]}, ("claude-cli", "s1", 0, "", None, None, True)),
    (A, _CLAUDE | _SESSION, {"messages": [{"role": "user", "content": "hi"}], "system": "You are Claude Code, with an MCP server."}, ("claude-cli", "s1", 0, "", None, "single_agent", False)),
    (A, _CLAUDE, _used("Read"), ("claude-cli", "toolu_0", 1, "Read", "function_call", "single_agent", False)),
    (A, _CLAUDE, {"messages": [{"role": "user", "content": "hi"}]}, (None, None, 0, "", None, None, False)),
    (A, {}, _used("shell", system="It has an MCP tool."), ("generic", "toolu_0", 1, "shell", "mixed", "single_agent", False)),
    (R, _CODEX, {"input": [{"type": "message", "role": "user", "content": "go"}, {"type": "function_call", "name": "shell", "call_id": "c1"}]}, ("codex-cli", "cs", 1, "shell", "cli", "single_agent", False)),
    (R, _CODEX | {"X-OpenAI-Subagent": "review"}, {"input": [{"type": "message", "role": "user", "content": "go"}]}, ("codex-cli", "cs", 0, "", None, "sub_agent", False)),
    (R, {"Originator": "codex_cli_rs"}, {"input": [{"type": "message", "role": "user", "content": "go"}]}, (None, None, 0, "", None, None, False)),
    (C, {"User-Agent": "opencode/0.1", "X-Session-Affinity": "o1"}, _called("read", tools=("read", "bash")), ("opencode", "o1", 1, "read,bash", "mixed", "single_agent", False)),
    (C, {"User-Agent": "opencode/0.1", "X-Session-Affinity": "o2"}, _called("read", tools=("read",), system="It has an MCP server."), ("opencode", "o2", 1, "read", "mixed", "single_agent", False)),
    (C, {"User-Agent": "opencode/0.1"}, _called("read", tools=("read",)), ("generic", "call_0", 1, "read", "function_call", "single_agent", False)),
    (C, {}, _called("subagents", tools=("sessions_list", "subagents")), ("openclaw", "call_0", 1, "sessions_list,subagents", "function_call", "single_agent", False)),
    (C, {}, _called("cronjob", tools=("cronjob", "skill_view"), system="You are an agent with an mcp server"), ("hermes", "call_0", 1, "cronjob,skill_view", "function_call", "single_agent", False)),
    (C, {}, _called(tools=("read",)), (None, None, 0, "", None, None, False)),
    (A, {}, {"system": "You are a context summarization assistant. Be brief", "messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": [{"type": "tool_use", "id": "toolu9", "name": "x"}]}]}, ("openclaw", "toolu_9", 1, "x", "function_call", "single_agent", True)),
]

#: path, request headers, response headers, model, finish reason, request body, response body; the application of an endpoint with such calls.
APPS: list[tuple[str, dict, dict, str, str, str, str, str | None]] = [
    ("/api/Chat", {}, {}, "m", "stop", "{}", "{}", "ollama"), ("/tokenize", {}, {}, "m", "stop", "{}", "{}", "llamacpp"), ("/generate", {}, {}, "m", "stop", "{}", "{}", "sglang"), ("/v1/score/x", {}, {}, "m", "stop", "{}", "{}", "vllm"),
    ("/v1/chat/completions", {}, {"x-litellm-model-id": "1"}, "m", "stop", "{}", "{}", "litellm"), ("/v1/chat/completions", {"Host": "eu.api.openai.com"}, {}, "m", "stop", "{}", "{}", "openai"),
    ("/v1/messages", {"host": "API.anthropic.com"}, {"server": "uvicorn"}, "m", "stop", "{}", "{}", "anthropic"), ("/x", {"Host": "generativelanguage.googleapis.com"}, {}, "m", "stop", "{}", "{}", "gemini"),
    ("/v1/chat/completions", {"Host": "x"}, {"Server": "uvicorn"}, "m", "Matched_Stop", "{}", "{}", "sglang"), ("/v1/chat/completions", {}, {}, "m", "stop", "{}", '{"system_fingerprint": "fp_1"}', "vllm"),
    ("/v1/chat/completions", {}, {}, "m", "stop", '{"id": "chatcmpl-tool-1"}', "{}", "vllm"), ("/v1/chat/completions", {}, {"Server": "Ollama/1"}, "m", "stop", "{}", "{}", "ollama"), ("/v1/chat/completions", {}, {"Server": "LiteLLM"}, "m", "stop", "{}", "{}", "litellm"),
    ("/v1/chat/completions", {}, {"Server": "uvicorn"}, "zai/GLM-5", "stop", "{}", "{}", "sglang"), ("/v1/chat/completions", {}, {"Server": "hypercorn-h11"}, "qwen", "stop", "{}", "{}", "vllm"), ("/v1/chat/completions", {}, {"Server": "nginx"}, "glm", "stop", "{}", "{}", None),
]

_PAIRS = "array<struct<name:string,value:string>>"


def _pairs(headers: dict) -> list[tuple[str, str]]:
    return list(headers.items())


def _text(body: object) -> str:
    return body if isinstance(body, str) else json.dumps(body)


def _dealt(spark: SparkSession, sf_dir: str, rows: list[tuple], schema: str) -> DataFrame:
    """Each event with its case; the cases are a few dozen rows, so they are broadcast."""
    cases = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"k int, {schema}")
    events = bridge.read(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(rows)).cast("int").alias("k"))
    return events.join(F.broadcast(cases), "k").drop("k")


def _literal(x: object) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + str(x).replace("'", "''") + "'"


def _expected(names: str, rows: list[tuple]) -> str:
    values = ", ".join("(" + ", ".join(map(_literal, (k, *r))) + ")" for k, r in enumerate(rows))
    return f"(VALUES {values}) AS c(k, {names}) JOIN events ON event_id % {len(rows)} = k"


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@query(f"SELECT event_id, wire_api, CASE WHEN named THEN concat('m', CAST(event_id % 5 AS VARCHAR)) ELSE 'unknown' END AS model, streamed AS is_stream FROM {_expected('wire_api, named, streamed', [(r[4], 'MODEL' in r[1] + _text(r[3]), 'stream' in r[1]) for r in REQUESTS])} WHERE wire_api IS NOT NULL")
def wire_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, [(m, p, _pairs(h), _text(b)) for m, p, h, b, _ in REQUESTS], f"method string, path string, headers {_PAIRS}, body string")
    model = F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string"))
    rows = rows.withColumns({c: F.replace(c, F.lit("MODEL"), model) for c in ("path", "body")})
    own = rows.withColumn("wire_api", wire.detect(*map(F.col, ("method", "path", "headers", "body")))).where("wire_api is not null")
    return own.select("event_id", "wire_api", wire.request_fields(*map(F.col, ("wire_api", "path", "body"))).alias("r")).select("event_id", "wire_api", "r.*")


@query(f"SELECT event_id, ends FROM {_expected('ends', [(r[3],) for r in ANSWERS])}")
def turn_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, [(a, f, _text(b)) for a, f, b, _ in ANSWERS], "wire_api string, finish_reason string, body string")
    return rows.select("event_id", wire.is_turn_terminal(*map(F.col, ("wire_api", "finish_reason", "body"))).alias("ends"))


@query(f"SELECT event_id, starts FROM {_expected('starts', [(r[3],) for r in STARTS])}")
def turn_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, [(a, g, _text(b)) for a, g, b, _ in STARTS], "wire_api string, agent string, body string")
    return rows.select("event_id", messages.is_user_turn_start(*map(F.col, ("wire_api", "body", "agent"))).alias("starts"))


@query(f"SELECT event_id, c.* EXCLUDE (k) FROM {_expected('agent_kind, session_id, tool_call_count, tool_names, tool_surface, agent_topology, is_auxiliary', [r[3] for r in AGENTS])}")
def agent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, [(a, _pairs(h), _text(b), "{}") for a, h, b, _ in AGENTS], f"wire_api string, request_headers {_PAIRS}, request_body string, response_body string")
    return calls.attributed(rows).select("event_id", "agent_kind", "session_id", "tool_call_count", F.array_join("tool_names", ",").alias("tool_names"), "tool_surface", "agent_topology", "is_auxiliary")


@query(f"SELECT '10.0.0.9' AS server_ip, CAST(k AS INT) AS server_port, app, count(*) AS call_count FROM {_expected('app', [(r[7],) for r in APPS])} GROUP BY ALL")
def service_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir, [(k, p, _pairs(q), _pairs(r), m, f, b, x) for k, (p, q, r, m, f, b, x, _) in enumerate(APPS)], f"server_port int, request_path string, request_headers {_PAIRS}, response_headers {_PAIRS}, model string, finish_reason string, request_body string, response_body string")
    spans = rows.select("*", F.lit("10.0.0.9").alias("server_ip"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("request_us"))
    lists = spans.groupBy("server_ip", "server_port").agg(services.first_of(F.col("model"), 32).alias("models"), services.first_of(F.col("request_path"), 16).alias("paths"), F.count("*").alias("call_count"))
    return services.classify(lists, services.samples(spans, 1 << 60, 1 << 61)).select("server_ip", "server_port", "app", "call_count")
