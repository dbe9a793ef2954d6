"""Wire formats of model APIs: detection, requests, responses and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_paths import header, is_list, is_there, kind, number, text

#: JSON paths of the published APIs, by field; the first that is there counts.
RESPONSE_PATHS = {
    "anthropic": {"id": ["$.id"], "model": ["$.model"], "finish_reason": ["$.stop_reason"], "input_tokens": ["$.usage.input_tokens"], "output_tokens": ["$.usage.output_tokens"], "total_tokens": [], "cache_read_input_tokens": ["$.usage.cache_read_input_tokens"], "cache_creation_input_tokens": ["$.usage.cache_creation_input_tokens"]},
    "openai-chat": {"id": ["$.id"], "model": ["$.model"], "finish_reason": ["$.choices[0].finish_reason"], "input_tokens": ["$.usage.prompt_tokens", "$.usage.input_tokens"], "output_tokens": ["$.usage.completion_tokens", "$.usage.output_tokens"], "total_tokens": ["$.usage.total_tokens"], "cache_read_input_tokens": ["$.usage.prompt_tokens_details.cached_tokens", "$.usage.cache_read_input_tokens"], "cache_creation_input_tokens": []},
    "openai-responses": {"id": ["$.id"], "model": ["$.model"], "finish_reason": ["$.status"], "input_tokens": ["$.usage.input_tokens"], "output_tokens": ["$.usage.output_tokens"], "total_tokens": ["$.usage.total_tokens"], "cache_read_input_tokens": ["$.usage.input_tokens_details.cached_tokens"], "cache_creation_input_tokens": []},
    "gemini-aistudio": {"id": ["$.responseId"], "model": ["$.modelVersion", "$.model"], "finish_reason": ["$.candidates[0].finishReason"], "input_tokens": ["$.usageMetadata.promptTokenCount"], "output_tokens": ["$.usageMetadata.candidatesTokenCount"], "total_tokens": ["$.usageMetadata.totalTokenCount"], "cache_read_input_tokens": ["$.usageMetadata.cachedContentTokenCount"], "cache_creation_input_tokens": []},
}
#: Finish reasons that end an answer, and those of them that ask for tools.
TERMINAL = {
    "anthropic": ("end_turn", "stop_sequence", "max_tokens", "tool_use", "refusal", "model_context_window_exceeded"),
    "openai-chat": ("stop", "length", "tool_calls", "function_call", "content_filter"),
    "openai-responses": ("completed", "incomplete", "failed", "cancelled"),
    "gemini-aistudio": ("STOP", "MAX_TOKENS", "SAFETY", "RECITATION", "LANGUAGE", "BLOCKLIST", "PROHIBITED_CONTENT", "SPII", "MALFORMED_FUNCTION_CALL", "IMAGE_SAFETY", "OTHER", "TOOL_USE"),
}
TOOL_USE = {"anthropic": ("tool_use",), "openai-chat": ("tool_calls", "function_call"), "openai-responses": (), "gemini-aistudio": ("TOOL_USE",)}


def _by_api(wire_api: Column, make) -> Column:
    out = None
    for name in RESPONSE_PATHS:
        value = make(name)
        out = F.when(wire_api == name, value) if out is None else out.when(wire_api == name, value)
    return out


def _vendor(headers: Column) -> dict[str, Column]:
    """What credentials and version headers say about who is asked."""
    auth = F.coalesce(header(headers, "authorization"), F.lit(""))
    version = header(headers, "anthropic-version").isNotNull()
    return {
        "version": version,
        "key": F.coalesce(header(headers, "x-api-key"), F.lit("")).startswith("sk-ant-") | auth.startswith("Bearer sk-ant-"),
        "other": ~(version | auth.startswith("Bearer sk-ant-")),
        "bearer": auth.startswith("Bearer "),
    }


def routes(path: Column, headers: Column) -> dict[str, Column]:
    """By wire API: true if the route is one of its own, false if it cannot be, null if the body must tell. All are posted."""
    bare, who = F.substring_index(path, "?", 1), _vendor(headers)
    unknown = F.lit(None).cast("boolean")
    return {
        "anthropic": F.when(bare.endswith("/v1/messages/count_tokens") | bare.endswith("/v1/messages/batches"), False).when(bare.endswith("/v1/messages") & (who["version"] | who["key"]), True).otherwise(unknown),
        "openai-responses": F.when(~who["other"], False).when(bare.endswith("/v1/responses") & who["bearer"], True).otherwise(unknown),
        "gemini-aistudio": F.when(bare.contains("/v1beta/models/") & (bare.endswith(":generateContent") | bare.endswith(":streamGenerateContent")), True).otherwise(unknown),
        "openai-chat": F.when(~who["other"], False).when(bare.endswith("/v1/chat/completions") & who["bearer"], True).otherwise(unknown),
    }


def shapes(headers: Column, body: Column) -> dict[str, Column]:
    """By wire API: whether a JSON body looks like one of its requests."""
    who = _vendor(headers)
    has = lambda name: is_there(body, f"$.{name}")
    named = F.coalesce(kind(body, "$.model") == "STRING", F.lit(False))
    filled = lambda name: is_list(body, f"$.{name}") & is_there(body, f"$.{name}[0]")
    roles = F.transform(F.from_json(F.get_json_object(body, "$.messages"), "array<struct<role:string>>"), lambda m: m["role"])
    strict = F.coalesce(F.forall(roles, lambda r: F.coalesce(r.isin("user", "assistant"), F.lit(False))), F.lit(False))
    return {
        "anthropic": named & is_list(body, "$.messages") & strict & ~has("input") & (who["version"] | who["key"] | has("system") | has("stop_sequences")),
        "openai-responses": named & has("input") & ~has("messages"),
        "gemini-aistudio": filled("contents") & ~has("messages") & ~has("input") & ~has("request"),
        "openai-chat": named & ~has("input") & filled("messages"),
    }


def detect(method: Column, path: Column, headers: Column, body: Column) -> Column:
    """The wire API of a posted request, null if none fits.

    All routes are asked before any body: a route of an API's own settles it. Else, for JSON, the first API whose route is open and
    whose shape the body has; a vendor's header alone is not enough, as its telemetry carries that, too.
    """
    by_route, by_shape = routes(path, headers), shapes(headers, body)
    json = F.lower(F.trim(F.substring_index(F.coalesce(header(headers, "content-type"), F.lit("")), ";", 1))) == "application/json"
    settled = F.coalesce(*(F.when(by_route[api], api) for api in RESPONSE_PATHS))
    guessed = F.coalesce(*(F.when(by_route[api].isNull() & by_shape[api], api) for api in RESPONSE_PATHS))
    return F.when(method == "POST", F.coalesce(settled, F.when(json, guessed)))


def request_fields(wire_api: Column, path: Column, body: Column) -> Column:
    """model and is_stream of a request."""
    gemini = wire_api == "gemini-aistudio"
    model = F.when(gemini, F.nullif(F.regexp_extract(path, r"/([^/:]+):", 1), F.lit(""))).otherwise(F.get_json_object(body, "$.model"))
    stream = F.when(gemini, path.contains(":streamGenerateContent")).otherwise(F.coalesce(F.get_json_object(body, "$.stream") == "true", F.lit(False)))
    return F.struct(F.coalesce(model, F.lit("unknown")).alias("model"), stream.alias("is_stream"))


def response_fields(wire_api: Column, body: Column) -> Column:
    """id, model, finish_reason and token counts of a whole response."""

    def one(field: str, read) -> Column:
        return _by_api(wire_api, lambda api: read(body, *RESPONSE_PATHS[api][field]) if RESPONSE_PATHS[api][field] else F.lit(None)).alias(field)

    calls = F.get_json_object(body, "$.candidates[0].content.parts[*].functionCall").isNotNull()
    finish = _by_api(wire_api, lambda api: text(body, *RESPONSE_PATHS[api]["finish_reason"]))
    finish = F.when((wire_api == "gemini-aistudio") & (finish == "STOP") & calls, "TOOL_USE").otherwise(finish)
    tokens = [one(f, number) for f in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")]
    i, o = (_by_api(wire_api, lambda api, f=f: number(body, *RESPONSE_PATHS[api][f])) for f in ("input_tokens", "output_tokens"))
    total = F.coalesce(_by_api(wire_api, lambda api: number(body, *RESPONSE_PATHS[api]["total_tokens"]) if RESPONSE_PATHS[api]["total_tokens"] else F.lit(None).cast("long")), i + o)
    return F.struct(one("id", text), one("model", text), finish.alias("finish_reason"), *(t.cast("long").alias(n) for t, n in zip(tokens, ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"))), total.alias("total_tokens"))


def ends_with_message(body: Column) -> Column:
    """A responses body whose output has a message and asks for no call."""
    kinds = F.transform(F.from_json(F.get_json_object(body, "$.output"), "array<struct<type:string>>"), lambda x: F.coalesce(x["type"], F.lit("")))
    return F.coalesce(F.exists(kinds, lambda k: k == "message") & ~F.exists(kinds, lambda k: k.endswith("_call")), F.lit(False))


def is_turn_terminal(wire_api: Column, finish_reason: Column, body: Column | None = None) -> Column:
    """The answer ends a turn. With ``body``, a responses answer is judged by its output, as its status says nothing of calls."""
    ends = _by_api(wire_api, lambda api: finish_reason.isin(*TERMINAL[api]))
    tools = _by_api(wire_api, lambda api: finish_reason.isin(*TOOL_USE[api]) if TOOL_USE[api] else F.lit(False))
    by_reason = F.coalesce(ends & ~tools, F.lit(False))
    return by_reason if body is None else F.when(wire_api == "openai-responses", ends_with_message(body)).otherwise(by_reason)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used: as plain expressions it would be copied into each use."""
    return F.get(F.transform(F.array(value), use), 0)


def sse_events(stream: Column) -> Column:
    """event and data of each server-sent event, in order: blank lines end events, data lines are joined by line feeds, comments don't count."""
    blocks = F.split(F.replace(stream, F.lit("\r\n"), F.lit("\n")), "\n\n")

    def values(lines: Column, name: str) -> Column:
        own = F.filter(lines, lambda x: x.startswith(f"{name}:"))
        return F.transform(own, lambda x: F.when(x.startswith(f"{name}: "), F.substring(x, len(name) + 3, 1 << 30)).otherwise(F.substring(x, len(name) + 2, 1 << 30)))

    events = F.transform(blocks, lambda b: bound(F.split(b, "\n"), lambda lines: F.struct(F.get(values(lines, "event"), 0).alias("event"), values(lines, "data").alias("data"))))
    return F.transform(F.filter(events, lambda e: F.size(e["data"]) > 0), lambda e: F.struct(e["event"].alias("event"), F.array_join(e["data"], "\n").alias("data")))


def sse_summary(events: Column) -> Column:
    """How many events there are, and their bytes of data."""
    return F.struct(F.size(events).cast("long").alias("event_count"), F.aggregate(events, F.lit(0).cast("long"), lambda a, e: a + F.octet_length(e["data"])).alias("data_bytes"))


def fold_chat(events: Column) -> Column:
    """id, model, content, finish_reason and usage of a chat stream: the first id, model and usage, the last finish reason, all content joined."""

    def value(event: Column, path: str) -> Column:
        # a text is parsed only if it holds the last name of the path, or an escape that may spell it
        return F.when(event["data"].contains(path.rpartition(".")[2]) | event["data"].contains("\\"), F.get_json_object(event["data"], path))

    def first(path: str) -> Column:
        return F.aggregate(events, F.lit(None).cast("string"), lambda found, e: F.coalesce(found, value(e, path)))

    def values(path: str) -> Column:
        return F.filter(F.transform(events, lambda e: value(e, path)), lambda x: x.isNotNull())

    return F.struct(
        first("$.id").alias("id"), first("$.model").alias("model"), F.array_join(values("$.choices[0].delta.content"), "").alias("content"),
        F.try_element_at(values("$.choices[0].finish_reason"), F.lit(-1)).alias("finish_reason"),
        first("$.usage.prompt_tokens").try_cast("long").alias("input_tokens"), first("$.usage.completion_tokens").try_cast("long").alias("output_tokens"),
    )


def fold_anthropic(events: Column) -> Column:
    """The same of a messages stream: id, model and input tokens from its start, the last stop reason and output tokens, text deltas joined."""
    def of(kind: str, path: str) -> Column:
        own = F.filter(events, lambda e: F.get_json_object(e["data"], "$.type") == kind)
        return F.filter(F.transform(own, lambda e: F.get_json_object(e["data"], path)), lambda x: x.isNotNull())

    later = F.filter(of("message_delta", "$.usage.input_tokens"), lambda x: x.try_cast("long") > 0)
    return F.struct(
        F.get(of("message_start", "$.message.id"), 0).alias("id"), F.get(of("message_start", "$.message.model"), 0).alias("model"), F.array_join(of("content_block_delta", "$.delta.text"), "").alias("content"),
        F.try_element_at(of("message_delta", "$.delta.stop_reason"), F.lit(-1)).alias("finish_reason"),
        F.coalesce(F.try_element_at(later, F.lit(-1)), F.get(of("message_start", "$.message.usage.input_tokens"), 0)).try_cast("long").alias("input_tokens"),
        F.try_element_at(of("message_delta", "$.usage.output_tokens"), F.lit(-1)).try_cast("long").alias("output_tokens"),
    )


def fold_responses(events: Column) -> Column:
    """The same of a responses stream: what its completed event holds, else id and model from its created one; texts of finished output items joined."""

    def of(kind: str) -> Column:
        return F.get(F.transform(F.filter(events, lambda e: F.get_json_object(e["data"], "$.type") == kind), lambda e: e["data"]), 0)

    done, made = of("response.completed"), of("response.created")
    items = F.filter(events, lambda e: F.get_json_object(e["data"], "$.type") == "response.output_item.done")
    said = F.filter(F.transform(items, lambda e: F.get_json_object(e["data"], "$.item.content[0].text")), lambda x: x.isNotNull())
    return F.struct(
        F.coalesce(F.get_json_object(done, "$.response.id"), F.get_json_object(made, "$.response.id")).alias("id"), F.coalesce(F.get_json_object(done, "$.response.model"), F.get_json_object(made, "$.response.model")).alias("model"),
        F.array_join(said, "").alias("content"), F.get_json_object(done, "$.response.status").alias("finish_reason"),
        F.get_json_object(done, "$.response.usage.input_tokens").try_cast("long").alias("input_tokens"), F.get_json_object(done, "$.response.usage.output_tokens").try_cast("long").alias("output_tokens"),
    )


def fold_gemini(events: Column) -> Column:
    """The same of a generate stream: the first id and model, all texts joined, the last finish reason and counts; a call makes STOP a TOOL_USE."""

    def values(path: str) -> Column:
        return F.filter(F.transform(events, lambda e: F.get_json_object(e["data"], path)), lambda x: x.isNotNull())

    def last(path: str) -> Column:
        return F.try_element_at(values(path), F.lit(-1))

    finish = last("$.candidates[0].finishReason")
    return F.struct(
        F.get(values("$.responseId"), 0).alias("id"), F.get(values("$.modelVersion"), 0).alias("model"), F.array_join(values("$.candidates[0].content.parts[0].text"), "").alias("content"),
        F.when((finish == "STOP") & (F.size(values("$.candidates[0].content.parts[0].functionCall")) > 0), "TOOL_USE").otherwise(finish).alias("finish_reason"),
        last("$.usageMetadata.promptTokenCount").try_cast("long").alias("input_tokens"), last("$.usageMetadata.candidatesTokenCount").try_cast("long").alias("output_tokens"),
    )


def tokens_estimated(body: Column, input_tokens: Column, output_tokens: Column) -> Column:
    """Counts are there though the body names no usage."""
    named = F.coalesce(*(F.get_json_object(body, p).try_cast("long") for p in ("$.usage.input_tokens", "$.usage.prompt_tokens", "$.usage.output_tokens", "$.usage.completion_tokens")), F.lit(0)) > 0
    return ((F.coalesce(input_tokens, F.lit(0)) > 0) | (F.coalesce(output_tokens, F.lit(0)) > 0)) & ~named


def estimated(wire_api: Column, status: Column, request: Column, answer: Column, input_tokens: Column, output_tokens: Column, bytes_per_token: int = 4) -> Column:
    """input and output: the counts named, or, of a good answer that names none (but for gemini), visible bytes by ``bytes_per_token``, thoughts left out."""
    visible = F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?(</think>|$)", "")
    none = status.between(200, 299) & (F.coalesce(input_tokens, F.lit(0)) == 0) & (F.coalesce(output_tokens, F.lit(0)) == 0) & answer.isNotNull() & (wire_api != "gemini-aistudio")
    size = lambda x: F.ceil(F.octet_length(x) / bytes_per_token).cast("long")
    return F.struct(F.when(none, size(F.coalesce(request, F.lit("")))).otherwise(input_tokens).alias("input"), F.when(none, size(visible)).otherwise(output_tokens).alias("output"))


def backfill_tokens(spans: DataFrame, bytes_per_token: int = 4) -> DataFrame:
    """Estimates the counts of answered spans that have none: visible bytes by ``bytes_per_token``, thoughts left out. Doing it again changes nothing."""
    visible = F.regexp_replace(F.coalesce("response_body", F.lit("")), r"(?s)<think>.*?(</think>|$)", "")
    missing = (F.coalesce("input_tokens", F.lit(0)) == 0) & (F.coalesce("output_tokens", F.lit(0)) == 0) & (F.octet_length(F.coalesce("response_body", F.lit(""))) > 0) & F.col("status_code").between(200, 299)
    size = lambda x: F.ceil(F.octet_length(x) / bytes_per_token).cast("long")
    return spans.withColumns({"input_tokens": F.when(missing, size(F.coalesce("request_body", F.lit("")))).otherwise(F.col("input_tokens")), "output_tokens": F.when(missing, size(visible)).otherwise(F.col("output_tokens"))})


def capped(body: Column, most: int = 256 * 1024, tail: int = 64 * 1024) -> Column:
    """body, cut in its middle if it has more than ``most`` bytes, and the bytes dropped; cuts don't split characters."""
    raw = body.cast("binary")
    head = F.make_valid_utf8(F.substring(raw, 1, most - tail).cast("string"))
    end = F.make_valid_utf8(F.substring(raw, -tail, tail).cast("string"))
    head, end = F.regexp_replace(head, "�+$", ""), F.regexp_replace(end, "^�+", "")
    size = F.octet_length(body)
    dropped = size - F.octet_length(head) - F.octet_length(end)
    cut = F.concat(head, F.format_string("\n[%d bytes left out]\n", dropped), end)
    return F.struct(F.when(size > most, cut).otherwise(body).alias("body"), F.when(size > most, dropped).otherwise(0).cast("long").alias("dropped"))
