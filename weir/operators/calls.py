"""Calls of models (spans) from HTTP exchanges, and calls of agents from spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import agents, folds, messages, tokens, wire

_FIELDS = ("id", "model", "finish_reason", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "total_tokens", "text")


def _answered(api: Column, body: Column, stream: Column) -> Column:
    """What a response says: fields of a whole body, or those of its events (``stream``) put together."""
    events = wire.sse_events(stream)
    whole = wire.response_fields(api, body)

    cache = folds.cache_tokens(api, events)

    def folded(fold: Column) -> Column:
        own = {"cache_read_input_tokens": cache["read"], "cache_creation_input_tokens": cache["created"], "id": fold["id"], "model": fold["model"], "finish_reason": fold["finish_reason"], "input_tokens": fold["input_tokens"], "output_tokens": fold["output_tokens"], "text": F.nullif(fold["content"], F.lit(""))}
        return F.struct(*(own.get(n, F.lit(None).cast("string" if n == "text" else "long")).alias(n) for n in _FIELDS))

    plain = F.struct(*((messages.answer_text(api, body) if n == "text" else whole[n]).alias(n) for n in _FIELDS))
    streamed = F.when(api == "anthropic", folded(wire.fold_anthropic(events))).when(api == "openai-chat", folded(wire.fold_chat(events))).when(api == "openai-responses", folded(wire.fold_responses(events))).otherwise(folded(wire.fold_gemini(events)))
    return F.when(stream.isNotNull(), streamed).otherwise(plain)


def once(value: Column) -> Column:
    """``value``, computed where it stands. A condition above would else be carried below with all expressions that it is made of copied into it,
    those of bodies many times over; an expression that Catalyst holds for random stops that. Conditions on exchanges go before ``to_spans``."""
    return F.when(F.rand(0) >= 0, value)


def _later(first: str, then: str) -> Column:
    """Milliseconds between two times; null unless the second is later."""
    return F.when(F.col(then) > F.col(first), (F.col(then) - F.col(first)) / 1000.0)


def attributed(calls: DataFrame) -> DataFrame:
    """Calls (wire_api, request_headers, request_body, response_body) with agent_kind, session_id, subagent, is_auxiliary, is_agent_request, tool_surface, agent_topology, tool_call_count and tool_names."""
    api, headers, body, answer = map(F.col, ("wire_api", "request_headers", "request_body", "response_body"))
    own = calls.withColumns({"_anchor": once(agents.tool_anchor(api, body, answer)), "_user": messages.first_user_text(api, body), "_answer": messages.answer_text(api, answer)})
    own = own.withColumn("agent_kind", once(agents.profile(api, headers, body, F.col("_anchor"), F.col("_user"))))
    kind = F.col("agent_kind")
    own = own.withColumns({"_found": once(agents.primitives(kind, headers, body)), "subagent": agents.subagent(kind, headers, body), "is_auxiliary": agents.is_auxiliary(kind, body), "session_id": agents.session_id(kind, headers, F.col("_anchor"), F.col("_user"), F.col("_answer"))})
    found, mark = F.col("_found"), F.col("subagent")
    new = {"is_agent_request": agents.is_agent_request(found, mark), "tool_surface": agents.tool_surface(found), "agent_topology": agents.topology(found, mark)}
    return own.withColumns(new | {"tool_call_count": F.when(kind.isNotNull(), found["tool_call_count"]).otherwise(0), "tool_names": found["tool_names"]}).drop("_anchor", "_user", "_answer", "_found")


def to_spans(exchanges: DataFrame, ranks: str | None = None) -> DataFrame:
    """A span for each exchange that is a call of a model.

    ``exchanges``: source_id, client_ip, client_port, server_ip, server_port, method, uri, request_headers, request_body, status_code,
    response_headers, response_body (the stream of events if ``is_sse``, which becomes the answer that it adds up to), request_us, response_us (first byte), complete_us. The response's model
    counts before the request's; a total is the sum of its parts if it is not named; times that do not grow give no latency; bodies are
    capped; ids follow from the connection, time and path, so that a job done again makes the same ones. Columns of attribution, and what turns need
    (is_terminal, is_user_start, user_input, assistant_text), are read from the whole bodies. Counts that a good answer does not name are estimated: by
    the vocabulary at the path ``ranks`` (``functions.tokens``), or by bytes without one.
    """
    own = exchanges.withColumn("wire_api", once(wire.detect(*map(F.col, ("method", "uri", "request_headers", "request_body"))))).where("wire_api is not null")
    # what is read from whole bodies is read from streams put together, too
    own = own.withColumn("_stream", F.when(F.col("is_sse"), F.col("response_body")))
    own = own.withColumn("response_body", F.coalesce(folds.body(F.col("wire_api"), F.col("_stream")), F.col("response_body")))
    api, body, answer = F.col("wire_api"), F.col("request_body"), F.col("response_body")
    own = own.withColumns({"_q": wire.request_fields(api, F.col("uri"), body), "_r": once(_answered(api, answer, F.col("_stream")))})
    own = attributed(own)
    kind = F.col("agent_kind")
    estimated = wire.estimated(api, F.col("status_code"), body, F.coalesce("_r.text", answer), F.col("_r.input_tokens"), F.col("_r.output_tokens"))
    if ranks is not None:
        named = F.struct(F.col("_r.input_tokens").alias("input"), F.col("_r.output_tokens").alias("output"))
        bare = F.col("status_code").between(200, 299) & (F.coalesce(named["input"], F.lit(0)) == 0) & (F.coalesce(named["output"], F.lit(0)) == 0)
        # calls that name counts have no API here, so their bodies are not walked
        own = own.withColumn("_e", tokens.estimates(F.when(bare, api), body, answer, ranks))
        estimated = F.struct(F.coalesce("_e.input", named["input"]).alias("input"), F.coalesce("_e.output", named["output"]).alias("output"))
    own = own.withColumn("_t", once(estimated))
    cut_q, cut_r = wire.capped(body), wire.capped(answer)
    ends = wire.is_turn_terminal(api, F.col("_r.finish_reason"), answer)
    return own.select(
        F.sha2(F.concat_ws("|", "source_id", "client_ip", "client_port", "server_ip", "server_port", "request_us", "uri"), 256).alias("id"),
        "source_id", "client_ip", "client_port", "server_ip", "server_port", "request_us", "response_us", "complete_us", "wire_api",
        F.coalesce("_r.model", "_q.model").alias("model"), F.col("_q.is_stream").alias("is_stream"), F.col("uri").alias("request_path"), "status_code", F.col("_r.finish_reason").alias("finish_reason"), F.col("_r.id").alias("response_id"),
        F.col("_t.input").alias("input_tokens"), F.col("_t.output").alias("output_tokens"), F.coalesce("_r.total_tokens", F.col("_t.input") + F.col("_t.output")).alias("total_tokens"),
        F.col("_r.cache_read_input_tokens").alias("cache_read_input_tokens"), F.col("_r.cache_creation_input_tokens").alias("cache_creation_input_tokens"),
        _later("request_us", "response_us").alias("ttft_ms"), _later("request_us", "complete_us").alias("e2e_latency_ms"),
        cut_q["body"].alias("request_body"), cut_r["body"].alias("response_body"), (cut_q["dropped"] + cut_r["dropped"]).alias("body_bytes_dropped"), "request_headers", "response_headers",
        "agent_kind", "session_id", "subagent", "is_auxiliary", "is_agent_request", "tool_surface", "agent_topology", "tool_call_count", "tool_names",
        ends.alias("is_terminal"), messages.is_user_turn_start(api, body, kind).alias("is_user_start"), messages.user_text(api, body).alias("user_input"), F.col("_r.text").alias("assistant_text"),
    )


def of_agents(spans: DataFrame) -> DataFrame:
    """The calls that belong to a session, as ``turns.assemble`` takes them. Sub-agents' calls neither start nor end a turn."""
    main = F.col("subagent").isNull()
    own = spans.where("session_id is not null")
    return own.withColumns({
        "end_us": F.greatest("request_us", F.coalesce("complete_us", "response_us", "request_us")),
        "is_terminal": F.col("is_terminal") & main,
        "is_user_start": F.coalesce("is_user_start", F.lit(False)) & main,
    })
