"""Queries over headers, request and response bodies, made from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import agents, json_paths, messages, trajectory, wire
from ..sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _headers(**values: Column) -> Column:
    return F.array(*(F.struct(F.lit(k.replace("_", "-")).alias("name"), v.alias("value")) for k, v in values.items()))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses with bodies, from the events."""
    e = bridge.read(spark, sf_dir, "events")
    n, kind = F.col("event_id"), F.col("event_type")
    path = F.when(kind == "signup", "/v1/messages").when(kind == "view", "/v1/responses").when(kind == "click", F.concat(F.lit("/v1beta/models/g"), (n % 3).cast("string"), F.lit(":streamGenerateContent"))).when(kind == "error", "/v1/embeddings").otherwise("/proxy")
    model = F.concat(F.lit("m"), (n % 5).cast("string"))
    body = F.format_string('{"model": "%s", "stream": %s, "messages": [{"role": "user", "content": "hi %d"}], "tools": [{"name": "%s"}, {"type": "function", "function": {"name": "%s"}}]}', model, F.when(n % 2 == 0, "true").otherwise("false"), n, F.when(n % 3 == 0, "mcp__x").otherwise("Bash"), F.when(n % 7 == 0, "Task").when(n % 3 == 0, "mcp__x").otherwise("Bash"))
    usage = F.format_string('"usage": {"input_tokens": %d, "prompt_tokens": %d, "output_tokens": %d, "completion_tokens": %d}', n % 90, n % 80, n % 70, n % 60)
    response = F.when(kind == "click", F.format_string('{"responseId": "r%d", "modelVersion": "g", "candidates": [{"finishReason": "STOP", "content": {"parts": [%s]}}], "usageMetadata": {"promptTokenCount": %d, "candidatesTokenCount": %d, "totalTokenCount": %d}}', n, F.when(n % 2 == 0, '{"functionCall": {"name": "f"}}').otherwise('{"text": "x"}'), n % 50, n % 40, n % 50 + n % 40)).otherwise(
        F.concat(F.format_string('{"id": "r%d", "model": "%s", "stop_reason": "end_turn", "status": "completed", "choices": [{"finish_reason": "tool_calls"}], ', n, model), usage, F.lit("}"))
    )
    return e.select("event_id", "event_type", path.alias("path"), model.alias("model"), body.alias("body"), response.alias("response"), _headers(Content_Type=F.lit("application/json"), User_Agent=F.when(n % 4 == 0, "claude-cli/2.0").when(n % 4 == 1, "codex_cli_rs/1").when(n % 4 == 2, "opencode/0.1").otherwise("curl")).alias("headers"))


_API = "CASE event_type WHEN 'signup' THEN 'anthropic' WHEN 'view' THEN 'openai-responses' WHEN 'click' THEN 'gemini-aistudio' WHEN 'error' THEN NULL ELSE 'openai-chat' END"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _events(spark, sf_dir).where("event_type <> 'error'")
    kind = F.col("event_type")
    return own.withColumn("wire_api", F.when(kind == "signup", "anthropic").when(kind == "view", "openai-responses").when(kind == "click", "gemini-aistudio").otherwise("openai-chat"))


@query(f"""WITH x AS (SELECT *, {_API} AS wire_api FROM events WHERE event_type <> 'error'),
y AS (SELECT event_id, wire_api, concat('r', CAST(event_id AS VARCHAR)) AS id, CASE wire_api WHEN 'anthropic' THEN 'end_turn' WHEN 'openai-responses' THEN 'completed' WHEN 'openai-chat' THEN 'tool_calls' ELSE CASE WHEN event_id % 2 = 0 THEN 'TOOL_USE' ELSE 'STOP' END END AS finish_reason,
 CASE wire_api WHEN 'gemini-aistudio' THEN event_id % 50 WHEN 'openai-chat' THEN event_id % 80 ELSE event_id % 90 END AS input_tokens, CASE wire_api WHEN 'gemini-aistudio' THEN event_id % 40 WHEN 'openai-chat' THEN event_id % 60 ELSE event_id % 70 END AS output_tokens FROM x)
SELECT *, input_tokens + output_tokens AS total_tokens, (wire_api = 'anthropic' OR wire_api = 'openai-responses' OR finish_reason = 'STOP') AS is_terminal FROM y""")
def wire_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _known(spark, sf_dir)
    out = rows.select("event_id", "wire_api", wire.response_fields(F.col("wire_api"), F.col("response")).alias("r"))
    return out.select("event_id", "wire_api", "r.id", "r.finish_reason", "r.input_tokens", "r.output_tokens", "r.total_tokens", wire.is_turn_terminal(F.col("wire_api"), F.col("r.finish_reason")).alias("is_terminal"))


@query("SELECT conv_id, count(*) AS event_count, CAST(sum(strlen(coalesce(text, ''))) AS BIGINT) AS data_bytes FROM conversations GROUP BY 1")
def sse_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "conversations")
    # a text of several lines is several data lines of one event; turns of a conversation are its events, in order
    one = F.concat(F.lit(": comment\r\nevent: turn\r\ndata: "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\ndata: ")), F.lit("\r\n\r\n"))
    streams = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", one.alias("e")))), lambda x: x["e"]), "").alias("stream"))
    return streams.select("conv_id", wire.sse_summary(wire.sse_events(F.col("stream"))).alias("s")).select("conv_id", "s.event_count", "s.data_bytes")


@query("SELECT o_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ' ', '' ORDER BY l_linenumber) AS content, concat('c', CAST(o_orderkey AS VARCHAR)) AS id, 'stop' AS finish_reason, CAST(max(l_linenumber) * 7 AS BIGINT) AS output_tokens FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def sse_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = bridge.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    # the numbers alone are shuffled; each order's chunks are written where its stream is
    orders = lines.groupBy("o_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("ns"), F.max("l_linenumber").alias("n"))
    start = F.concat(F.lit('data: {"id": "c'), F.col("o_orderkey").cast("string"), F.lit('", "model": "m", "choices": [{"delta": {"content": "'))
    streams = orders.withColumn("es", F.transform("ns", lambda n: F.concat(start, n.cast("string"), F.lit(' "}}]}\n\n'))))
    last = F.format_string('data: {"choices": [{"delta": {}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 1, "completion_tokens": %d}}\n\ndata: [DONE]\n\n', F.col("n") * 7)
    stream = F.concat(F.array_join("es", ""), last)
    return streams.select("o_orderkey", wire.bound(wire.sse_events(stream), wire.fold_chat).alias("r")).select("o_orderkey", "r.content", "r.id", "r.finish_reason", "r.output_tokens")


@query("""WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 20 END AS i, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 10 END AS o, props, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS st FROM events)
SELECT event_id, CASE WHEN i = 0 AND coalesce(o, 0) = 0 AND st = 200 THEN CAST(ceil(strlen(props) / 4.0) AS BIGINT) ELSE i END AS input_tokens, CASE WHEN i = 0 AND coalesce(o, 0) = 0 AND st = 200 THEN CAST(ceil(strlen(props || 'answer') / 4.0) AS BIGINT) ELSE o END AS output_tokens FROM x""")
def token_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events")
    n = F.col("event_id")
    rows = e.select("event_id", F.when(n % 3 == 0, 0).otherwise(n % 20).cast("long").alias("input_tokens"), F.when(n % 3 != 0, n % 10).alias("output_tokens"), F.col("props").alias("request_body"), F.concat(F.col("props"), F.lit("<think>long thought</think>answer")).alias("response_body"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status_code"))
    return wire.backfill_tokens(wire.backfill_tokens(rows)).select("event_id", "input_tokens", "output_tokens")


@query("""WITH u AS (SELECT user_id AS turn_id, 'toolu_' || CAST(event_id // 3 AS VARCHAR) AS tool_id, event_id FROM events WHERE event_type IN ('view', 'click')),
r AS (SELECT user_id AS turn_id, 'toolu_' || CAST(event_id // 3 AS VARCHAR) AS tool_id, event_id FROM events WHERE event_type IN ('purchase', 'signup')),
a AS (SELECT turn_id, tool_id, min(event_id) AS origin FROM u GROUP BY 1, 2), b AS (SELECT turn_id, tool_id, min(event_id) AS resolution FROM r GROUP BY 1, 2)
SELECT coalesce(a.turn_id, b.turn_id) AS turn_id, coalesce(a.tool_id, b.tool_id) AS tool_id, origin, resolution FROM a FULL OUTER JOIN b ON a.turn_id = b.turn_id AND a.tool_id = b.tool_id""")
def tool_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events")
    own = e.select("event_type", F.col("user_id").alias("turn_id"), F.concat(F.when(F.col("event_id") % 2 == 0, "toolu_").otherwise("toolu"), F.expr("event_id div 3").cast("string")).alias("tool_id"), F.col("event_id").alias("call_id"), F.col("event_id").alias("sequence"))
    return agents.tool_index(own.where("event_type in ('view', 'click')"), own.where("event_type in ('purchase', 'signup')"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('toolu_', CAST(event_id AS VARCHAR)) ELSE concat('s', CAST(user_id AS VARCHAR)) END AS session_id FROM events""")
def session_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = bridge.read(spark, sf_dir, "events")
    by_tool = F.col("event_id") % 3 == 0
    headers = _headers(X_Session_Affinity=F.concat(F.lit("s"), F.col("user_id").cast("string")))
    out = agents.session_id(F.when(by_tool, "generic").otherwise("opencode"), headers, F.when(by_tool, F.concat(F.lit("toolu"), F.col("event_id").cast("string"))), F.lit("hello"), F.lit("hi"))
    return e.select("event_id", out.alias("session_id"))


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "conversations")
    message = F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))
    bodies = rows.groupBy("conv_id").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(message)), lambda x: x["m"]).alias("messages"))).alias("request_body"))
    return trajectory.export(bodies.select(F.col("conv_id").cast("string").alias("turn_id"), F.when(F.col("conv_id") % 3 == 0, "gemini-aistudio").otherwise("openai-chat").alias("wire_api"), "request_body"))


@query()
def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trajectories(spark, sf_dir)


@query("SELECT CAST(conv_id AS VARCHAR) AS turn_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS position, role, text AS content FROM conversations WHERE conv_id % 3 <> 0")
def trajectory_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("line", "struct<messages:array<struct<role:string,content:string>>>")["messages"]
    return _trajectories(spark, sf_dir).select("turn_id", F.posexplode(parsed).alias("position", "m")).select("turn_id", "position", "m.role", "m.content")


@query("""SELECT event_id, event_id % 2 = 1 AND (event_id % 20 > 0 OR event_id % 10 > 0) AS tokens_estimated FROM events""")
def estimated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    body = F.when(n % 2 == 0, '{"usage": {"prompt_tokens": 3}}').otherwise('{"id": 1}')
    return bridge.read(spark, sf_dir, "events").select("event_id", wire.tokens_estimated(body, n % 20, n % 10).alias("tokens_estimated"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN props ELSE NULL END AS agent FROM events")
def header_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    headers = F.when(n % 2 == 0, F.array(F.struct(F.lit("SERVER").alias("name"), F.col("props").alias("value")), F.struct(F.lit("server").alias("name"), F.lit("second").alias("value")))).otherwise(F.array(F.struct(F.lit("Host").alias("name"), F.col("props").alias("value"))))
    return bridge.read(spark, sf_dir, "events").select("event_id", json_paths.header(headers, "Server").alias("agent"))


@query("""SELECT conv_id, turn, nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '') AS asked, role = 'user' AND nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '') IS NOT NULL AS starts FROM conversations WHERE role = 'user'
UNION ALL SELECT conv_id, turn, NULL, false FROM conversations WHERE role <> 'user'""")
def user_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "conversations")
    content = F.coalesce("text", F.lit(""))
    part = F.array(F.struct(F.lit("text").alias("type"), content.alias("text")))
    plain = F.to_json(F.struct(F.array(F.struct("role", content.alias("content"))).alias("messages")))
    listed = F.to_json(F.struct(F.array(F.struct("role", part.alias("content"))).alias("messages")))
    own = rows.select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "anthropic").otherwise("openai-chat").alias("wire_api"), F.when(F.col("conv_id") % 2 == 0, plain).otherwise(listed).alias("body"))
    return own.select("conv_id", "turn", messages.user_text(F.col("wire_api"), F.col("body")).alias("asked"), F.coalesce(messages.is_user_turn_start(F.col("wire_api"), F.col("body")), F.lit(False)).alias("starts"))
