"""Queries over turns, sessions and proxies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calls, listing, predicates, proxy, turns
from ..sources import bridge, shared

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TURNS_SQL = """raw AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS lst, coalesce(length(text), 0) AS size FROM conversations),
calls AS (SELECT concat('src-', CAST(conv_id % 2 AS VARCHAR)) AS source_id, CAST(conv_id AS VARCHAR) AS session_id, concat(CAST(conv_id AS VARCHAR), '-', CAST(turn AS VARCHAR)) AS id, conv_id, turn, role, text,
  conv_id * 3600000000 + turn * 1000000 AS request_us, conv_id * 3600000000 + turn * 1000000 + size * 1000 AS end_us, role = 'assistant' AND (coalesce(nx = 'user', false) OR lst) AS terminal,
  concat('m', CAST((conv_id + turn) % 3 AS VARCHAR)) AS model, CASE WHEN turn % 4 = 3 THEN 'helper' END AS subagent, CASE WHEN turn % 2 = 1 THEN 'cli' WHEN turn % 6 = 0 THEN 'mcp' END AS tool_surface, size FROM raw),
numbered AS (SELECT *, coalesce(sum(CAST(terminal AS INT)) OVER (PARTITION BY source_id, session_id ORDER BY request_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn_no FROM calls WHERE role <> 'system'),
firsts AS (SELECT source_id, session_id, turn_no, model, min(request_us) AS r FROM numbered GROUP BY ALL),
models AS (SELECT source_id, session_id, turn_no, string_agg(model, ',' ORDER BY r) AS models_used FROM firsts GROUP BY ALL),
turns AS (SELECT n.source_id, n.session_id, n.turn_no, min(request_us) AS start_us, max(end_us) AS end_us, count(*) AS call_count, any_value(models_used) AS models_used, coalesce(max(subagent), '') AS subagents_used,
  string_agg(id, ',' ORDER BY request_us, id) AS span_ids, coalesce(array_to_string(list_sort(list_distinct(array_agg(tool_surface) FILTER (tool_surface IS NOT NULL))), ','), '') AS tool_surfaces,
  CAST(coalesce(sum(CASE WHEN role = 'user' THEN size END), 0) AS BIGINT) AS total_input_tokens, CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN size END), 0) AS BIGINT) AS total_output_tokens,
  CASE WHEN bool_or(terminal) THEN 'complete' ELSE 'incomplete' END AS status,
  arg_min(text, request_us) FILTER (role = 'user') AS u, arg_min(id, request_us) FILTER (role = 'user') AS user_call_id, arg_max(id, request_us) AS final_call_id,
  max_by(role, request_us) AS last_role, max_by(coalesce(text, chr(0)), request_us) AS last_text, max_by(terminal, request_us) AS last_terminal
  FROM numbered n JOIN models m ON n.source_id = m.source_id AND n.session_id = m.session_id AND n.turn_no = m.turn_no GROUP BY 1, 2, 3 HAVING bool_or(role = 'user')),
traces AS (SELECT concat(source_id, ':', session_id, ':', CAST(turn_no AS VARCHAR)) AS turn_id, source_id, session_id, start_us, end_us, CAST((end_us - start_us) // 1000 AS BIGINT) AS duration_ms, call_count, models_used, subagents_used, span_ids, tool_surfaces, total_input_tokens, total_output_tokens, status,
  CASE WHEN last_role = 'assistant' THEN CASE WHEN last_terminal THEN 'stop' ELSE 'tool_calls' END END AS final_finish_reason,
  CASE WHEN length(u) > 500 THEN left(u, 500) || '…' ELSE u END AS user_input_preview, user_call_id,
  CASE WHEN last_role <> 'assistant' OR last_text = chr(0) THEN NULL WHEN length(last_text) > 500 THEN left(last_text, 500) || '…' ELSE last_text END AS final_answer_preview, final_call_id FROM turns)"""


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.assemble(turns.conversation_calls(bridge.read(spark, sf_dir, "conversations")))


def flat(df: DataFrame) -> DataFrame:
    """Arrays as texts, for comparison."""
    return df.withColumns({c: F.array_join(c, ",") for c, kind in df.dtypes if kind.startswith("array")})


@query(f"WITH {TURNS_SQL} SELECT * FROM traces")
def agent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(traces(spark, sf_dir))


@query(f"WITH {TURNS_SQL} SELECT * FROM traces WHERE status = 'complete' AND (',' || models_used || ',' LIKE '%,m1,%' OR ',' || models_used || ',' LIKE '%,m2,%') ORDER BY start_us DESC, turn_id LIMIT 50")
def traces_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = [predicates.one_of("status", ["complete"]), predicates.overlaps("models_used", ["m1", "m2"])]
    return flat(listing.page(traces(spark, sf_dir), where, "start_us", ("start_us", "end_us", "duration_ms", "call_count"), "turn_id"))


@query(f"WITH {TURNS_SQL} SELECT source_id, count(*) AS turn_count, CAST(sum(call_count) AS BIGINT) AS call_count, CAST(sum(total_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(total_output_tokens) AS BIGINT) AS output_tokens, avg(duration_ms) AS avg_duration_ms, max(duration_ms) AS max_duration_ms FROM traces GROUP BY 1")
def agent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.summary_by(traces(spark, sf_dir), "source_id")


@query(f"WITH {TURNS_SQL} SELECT start_us - ((start_us - 946857600000000) % 7200000000 + 7200000000) % 7200000000 AS bucket_us, status, count(*) AS turn_count FROM traces GROUP BY 1, 2")
def agent_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.activity(traces(spark, sf_dir), "status", turns.auto_bucket(8 * 86400))


@query(f"WITH {TURNS_SQL} SELECT concat(source_id, ':', session_id, ':', CAST(turn_no AS VARCHAR)) AS turn_id, u AS user_input, CASE WHEN last_role <> 'assistant' OR last_text = chr(0) THEN NULL ELSE last_text END AS final_answer FROM turns")
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls_ = turns.conversation_calls(bridge.read(spark, sf_dir, "conversations"))
    return turns.full_texts(turns.assemble(calls_), calls_)


SESSIONS_SQL = "sessions AS (SELECT source_id, session_id, min(start_us) AS first_turn_us, max(start_us) AS last_turn_us, count(*) AS turn_count, CAST(sum(call_count) AS BIGINT) AS call_count, CAST(sum(total_input_tokens) AS BIGINT) AS input_tokens, CAST(sum(total_output_tokens) AS BIGINT) AS output_tokens, arg_min(user_input_preview, start_us) AS first_preview FROM traces GROUP BY 1, 2)"


@query(f"WITH {TURNS_SQL}, {SESSIONS_SQL} SELECT * FROM sessions WHERE last_turn_us < 180000000000 ORDER BY last_turn_us DESC, source_id DESC, session_id DESC LIMIT 51")
def sessions_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["last_turn_us", "source_id", "session_id"]
    cursor = listing.decode_cursor(listing.encode_cursor([180_000_000_000, "", ""]))
    rows = turns.sessions(traces(spark, sf_dir)).where(listing.after_cursor(keys, cursor))
    return rows.orderBy(*(F.col(k).desc() for k in keys)).limit(51)


@query(f"WITH {TURNS_SQL} SELECT turn_id, start_us, status, call_count FROM traces WHERE source_id = 'src-1' AND session_id = '7' ORDER BY start_us DESC, turn_id DESC LIMIT 51")
def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).where((F.col("source_id") == "src-1") & (F.col("session_id") == "7"))
    return rows.orderBy(F.col("start_us").desc(), F.col("turn_id").desc()).limit(51).select("turn_id", "start_us", "status", "call_count")


@query(f"WITH {TURNS_SQL} SELECT true AS in_progress, turn_id, start_us, 'in_progress' AS status FROM traces WHERE status = 'incomplete' UNION ALL SELECT false, turn_id, start_us, status FROM traces WHERE status = 'complete'")
def traces_with_in_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = traces(spark, sf_dir).select("turn_id", "start_us", "status")
    return turns.union_in_progress(rows.where("status = 'complete'"), rows.where("status = 'incomplete'").withColumn("status", F.lit("in_progress")))


#: Turns seen again: event e has copies some time after, on other views; some end with the first, some within it, some after it.
_SEEN = """seen AS (SELECT concat(CAST(event_id AS VARCHAR), '/', CAST(leg AS VARCHAR)) AS turn_id, event_id AS content, epoch_us(ts) + CASE leg WHEN 0 THEN 0 WHEN 1 THEN (event_id % 7) * 100 ELSE (event_id % 5) * 60000 END AS start_us,
 epoch_us(ts) + 1000000 + CAST(floor(value * 1000) AS BIGINT) - leg * CASE WHEN event_id % 5 = 0 THEN 100 WHEN event_id % 9 = 0 THEN -50000 ELSE 1000 END AS end_us, concat('v', CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE leg END AS VARCHAR)) AS view
 FROM events CROSS JOIN (SELECT unnest([0, 1, 2]) AS leg) WHERE leg <= event_id % 3)"""
_GROUPS = f"""{_SEEN}, g AS (SELECT *, CASE WHEN start_us - lag(start_us) OVER (PARTITION BY content ORDER BY start_us, end_us DESC, turn_id) > 100000 THEN 1 ELSE 0 END AS gap FROM seen),
k AS (SELECT *, sum(gap) OVER (PARTITION BY content ORDER BY start_us, end_us DESC, turn_id ROWS UNBOUNDED PRECEDING) AS cl FROM g),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY content, cl ORDER BY start_us, end_us DESC, turn_id) = 1),
m AS (SELECT k.*, f.turn_id AS pair_id, f.turn_id = k.turn_id AS leads, abs(k.start_us - f.start_us) <= 500 AND abs(k.end_us - f.end_us) <= 500 AS mirror, k.start_us >= f.start_us AND k.end_us <= f.end_us AS nested, k.view = f.view AS own FROM k JOIN f ON f.content = k.content AND f.cl = k.cl),
v AS (SELECT * FROM m WHERE leads OR (NOT own AND (mirror OR nested))),
a AS (SELECT pair_id, count(*) AS size, bool_or(NOT leads AND NOT mirror) AS hop FROM v GROUP BY 1 HAVING count(*) > 1),
r AS (SELECT v.turn_id, v.pair_id, a.size, v.end_us - v.start_us AS duration_us, CASE WHEN leads AND hop THEN 'proxy_in' WHEN leads THEN 'mirror_primary' WHEN mirror THEN 'mirror_secondary' ELSE 'proxy_out' END AS role FROM v JOIN a ON a.pair_id = v.pair_id)"""


def seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = bridge.read(spark, sf_dir, "events").withColumn("us", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"))
    legs = events.withColumn("leg", F.explode(F.sequence(F.lit(0), (F.col("event_id") % 3).cast("int"))))
    later = F.when(F.col("leg") == 0, 0).when(F.col("leg") == 1, F.col("event_id") % 7 * 100).otherwise(F.col("event_id") % 5 * 60000)
    return legs.select(
        F.concat_ws("/", F.col("event_id").cast("string"), F.col("leg").cast("string")).alias("turn_id"), F.col("event_id").alias("content"), (F.col("us") + later).alias("start_us"),
        (F.col("us") + 1_000_000 + F.floor(F.col("value") * 1000) - F.col("leg") * F.when(F.col("event_id") % 5 == 0, 100).when(F.col("event_id") % 9 == 0, -50_000).otherwise(1000)).alias("end_us"),
        F.concat(F.lit("v"), F.when(F.col("event_id") % 4 == 0, 0).otherwise(F.col("leg")).cast("string")).alias("view"),
    )


@query(f"WITH {_GROUPS} SELECT turn_id, pair_id, role, size, (SELECT string_agg(o.turn_id, ',' ORDER BY o.turn_id) FROM r o WHERE o.pair_id = r.pair_id AND o.turn_id <> r.turn_id) AS peers FROM r")
def proxy_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(proxy.groups(seen(spark, sf_dir), ["content"]))


@query(f"WITH {_GROUPS} SELECT turn_id FROM seen WHERE turn_id NOT IN (SELECT turn_id FROM r WHERE role IN ('proxy_out', 'mirror_secondary'))")
def visible_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seen(spark, sf_dir)
    return rows.join(proxy.groups(rows, ["content"]).select("turn_id", "role"), "turn_id", "left").where(predicates.not_hidden_hop(F.col("role"))).select("turn_id")


@query(f"WITH {_GROUPS} SELECT pair_id, max(CASE WHEN role = 'proxy_in' THEN duration_us END) / 1000.0::DOUBLE AS client_ms, max(CASE WHEN role = 'proxy_out' THEN duration_us END) / 1000.0::DOUBLE AS upstream_ms, (max(CASE WHEN role = 'proxy_in' THEN duration_us END) - max(CASE WHEN role = 'proxy_out' THEN duration_us END)) / 1000.0::DOUBLE AS overhead_ms FROM r GROUP BY 1")
def proxy_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seen(spark, sf_dir)
    return proxy.latency(proxy.groups(rows, ["content"]).join(rows.select("turn_id", (F.col("end_us") - F.col("start_us")).alias("duration_us")), "turn_id"))


@query("""WITH l AS (SELECT o_orderkey AS pair_id, o_custkey, o_orderpriority, o_orderstatus FROM orders),
h AS (SELECT pair_id, 0 AS leg, 0 AS pos, 'Host' AS name, 'a' AS value FROM l UNION ALL SELECT pair_id, 1, 0, 'host', 'a' FROM l
UNION ALL SELECT pair_id, 0, 1, 'X-Status', o_orderstatus FROM l UNION ALL SELECT pair_id, 1, 1, 'x-status', CASE WHEN pair_id % 2 = 0 THEN o_orderstatus ELSE 'other' END FROM l
UNION ALL SELECT pair_id, CAST(pair_id % 2 AS INT), 2, 'Via', o_orderpriority FROM l),
b AS (SELECT pair_id, lower(name) AS key, count(DISTINCT leg) AS seen, count(DISTINCT value) AS vals, arg_min(name, leg * 10 + pos) AS name FROM h GROUP BY 1, 2)
SELECT pair_id, name, CASE WHEN seen < 2 THEN 'per_leg' WHEN vals > 1 THEN 'modified' ELSE 'common' END AS kind FROM b""")
def header_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = bridge.read(spark, sf_dir, "orders")

    def leg(k: int) -> DataFrame:
        def header(name: str, value: Column) -> Column:
            return F.struct(F.lit(name).alias("name"), value.alias("value"))

        own = [header("Host" if k == 0 else "host", F.lit("a")), header("X-Status" if k == 0 else "x-status", F.col("o_orderstatus") if k == 0 else F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).otherwise("other"))]
        via = F.when(F.col("o_orderkey") % 2 == k, F.array(header("Via", F.col("o_orderpriority")))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
        return orders.select(F.col("o_orderkey").alias("pair_id"), F.lit(k).alias("leg"), F.concat(F.array(*own), via).alias("headers"))

    return proxy.header_diff(leg(0).union(leg(1)))


_LEGS = """legs AS (SELECT r.turn_id, r.pair_id, r.role, concat('m', CAST((content + CASE WHEN role = 'proxy_out' AND content % 2 = 0 THEN 1 ELSE 0 END) % 5 AS VARCHAR)) AS model, CAST(content AS VARCHAR) AS first_span FROM r JOIN seen ON r.turn_id = seen.turn_id)"""


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seen(spark, sf_dir)
    out = proxy.groups(rows, ["content"]).drop("peers").join(rows.select("turn_id", "content"), "turn_id")
    shift = F.when((F.col("role") == "proxy_out") & (F.col("content") % 2 == 0), 1).otherwise(0)
    return out.select("turn_id", "pair_id", "role", F.concat(F.lit("m"), ((F.col("content") + shift) % 5).cast("string")).alias("model"), F.col("content").cast("string").alias("first_span"))


@query(f"WITH {_GROUPS}, {_LEGS} SELECT pair_id, max(CASE WHEN role = 'proxy_in' THEN model END) AS client_model, max(CASE WHEN role = 'proxy_out' THEN model END) AS upstream_model FROM legs GROUP BY 1 HAVING client_model <> upstream_model")
def model_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.model_rewrites(_legs(spark, sf_dir))


@query(f"WITH {_GROUPS}, {_LEGS}, {bridge.SPANS_SQL} SELECT turn_id, pair_id, role, legs.model AS model, spans.id AS id, spans.server_ip AS server_ip, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY CASE role WHEN 'proxy_in' THEN 0 WHEN 'mirror_primary' THEN 1 WHEN 'proxy_out' THEN 2 ELSE 3 END, turn_id) AS INT) AS position FROM legs JOIN spans ON first_span = spans.id")
def proxy_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.view(_legs(spark, sf_dir), bridge.spans(spark, sf_dir).select("id", "server_ip"))


@query(f"WITH {bridge.SPANS_SQL} SELECT CAST(user_id AS VARCHAR) || '/' || CAST(event_id AS VARCHAR) AS turn_id FROM events WHERE CAST(event_id AS VARCHAR) IN (SELECT id FROM spans WHERE server_port IN (8001, 8002))")
def traces_by_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_id").cast("string")).alias("turn_id"), F.array(F.col("event_id").cast("string")).alias("span_ids"))
    return turns.with_first_span_port(rows, bridge.spans(spark, sf_dir), [8001, 8002]).select("turn_id")


def conversation_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exchange for each answer of a conversation: even conversations are of one agent, every other of these a stream of events, odd ones of another."""
    rows = bridge.read(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    own = rows.withColumns({"asked": F.lag("text").over(w), "before": F.lag("role").over(w), "after": F.lead("role").over(w), "said": F.coalesce("text", F.lit(""))}).where("role = 'assistant'")
    conv, turn, said = F.col("conv_id"), F.col("turn"), F.col("said")
    claude, ends = conv % 2 == 0, F.coalesce(F.col("after") == "user", F.lit(True))
    tokens = F.char_length(said)
    ask = F.when(F.col("before") == "user", F.col("asked"))
    content = F.when(ask.isNotNull(), F.to_json(F.struct(F.struct(F.lit("text").alias("type"), ask.alias("text")).alias("b")))).otherwise(F.lit('{"b":{"type":"tool_result","tool_use_id":"t"}}'))
    last = F.when(claude, F.concat(F.lit('{"role":"user","content":['), F.get_json_object(content, "$.b"), F.lit("]}"))).otherwise(F.when(ask.isNotNull(), F.to_json(F.struct(F.lit("user").alias("role"), ask.alias("content")))).otherwise('{"role":"tool","content":"42"}'))
    request = F.concat(F.lit('{"model":"ask","stream":'), (conv % 4 == 0).cast("string"), F.lit(',"tools":[{"name":"Agent","function":{"name":"x"}}],"messages":['), last, F.lit("]}"))
    quoted = F.get_json_object(F.to_json(F.struct(F.struct(said.alias("t")).alias("q"))), "$.q")
    whole = F.concat(F.format_string('{"id":"r%d","model":"m%d","content":[', turn, conv % 3), F.replace(quoted, F.lit('{"t":'), F.lit('{"type":"text","text":')), F.format_string('],"stop_reason":"%s","usage":{"input_tokens":%d,"output_tokens":%d}}', F.when(ends, "end_turn").otherwise("tool_use"), turn + 1, tokens))
    start = F.format_string('event: message_start\ndata: {"type":"message_start","message":{"id":"r%d","model":"m%d","usage":{"input_tokens":%d}}}\n\n', turn, conv % 3, turn + 1)
    delta = F.concat(F.lit('data: {"type":"content_block_delta","index":0,"delta":'), F.replace(quoted, F.lit('{"t":'), F.lit('{"type":"text_delta","text":')), F.lit("}\n\n"))
    stop = F.format_string('data: {"type":"message_delta","delta":{"stop_reason":"%s"},"usage":{"output_tokens":%d}}\n\n', F.when(ends, "end_turn").otherwise("tool_use"), tokens)
    chat = F.concat(F.format_string('{"id":"r%d","model":"m%d","choices":[{"finish_reason":"%s","message":', turn, conv % 3, F.when(ends, "stop").otherwise("tool_calls")), F.replace(quoted, F.lit('{"t":'), F.lit('{"content":')), F.format_string('}],"usage":{"prompt_tokens":%d,"completion_tokens":%d}}', turn + 1, tokens))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    json = pair("content-type", F.lit("application/json"))
    headers = F.when(claude, F.array(json, pair("anthropic-version", F.lit("1")), pair("user-agent", F.lit("claude-cli/1")), pair("x-claude-code-session-id", conv.cast("string")))).otherwise(F.array(json, pair("user-agent", F.lit("opencode/1")), pair("x-session-affinity", conv.cast("string"))))
    at = conv * 3_600_000_000 + turn * 1_000_000
    return own.select(
        F.concat(F.lit("src-"), (conv % 2).cast("string")).alias("source_id"), F.lit("10.1.0.1").alias("client_ip"), turn.cast("int").alias("client_port"), F.lit("10.0.0.1").alias("server_ip"), F.lit(443).alias("server_port"),
        F.lit("POST").alias("method"), F.when(claude, "/v1/messages").otherwise("/gate/chat").alias("uri"), headers.alias("request_headers"), calls.once(request).alias("request_body"), F.lit(200).alias("status_code"),
        F.array(json).alias("response_headers"), calls.once(F.when(conv % 4 == 0, F.concat(start, delta, stop)).when(claude, whole).otherwise(chat)).alias("response_body"), (conv % 4 == 0).alias("is_sse"),
        at.alias("request_us"), (at + turn % 3 * 500).alias("response_us"), (at + tokens * 10).alias("complete_us"),
    )


def _conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are stored before they are asked for, so no question is planned into the reading of bodies."""
    path = shared.folder(spark, "spans")
    calls.to_spans(conversation_exchanges(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


_ANSWERS_SQL = """q AS (SELECT *, lag(text) OVER w AS asked, lag(role) OVER w AS before, lead(role) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
x AS (SELECT conv_id, turn, conv_id * 3600000000 + turn * 1000000 AS request_us, length(coalesce(text, '')) AS n, coalesce(after = 'user', true) AS ends, CASE WHEN before = 'user' THEN asked END AS ask, nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '') AS said, text FROM q WHERE role = 'assistant'),
s AS (SELECT concat('src-', CAST(conv_id % 2 AS VARCHAR)) AS source_id, CAST(conv_id AS VARCHAR) AS session_id, request_us, CASE WHEN conv_id % 2 = 0 THEN 'anthropic' ELSE 'openai-chat' END AS wire_api, CASE WHEN conv_id % 2 = 0 THEN 'claude-cli' ELSE 'opencode' END AS agent_kind, concat('m', CAST(conv_id % 3 AS VARCHAR)) AS model, conv_id % 4 = 0 AS is_stream,
 CASE WHEN conv_id % 2 = 0 THEN CASE WHEN ends THEN 'end_turn' ELSE 'tool_use' END ELSE CASE WHEN ends THEN 'stop' ELSE 'tool_calls' END END AS finish_reason, concat('r', CAST(turn AS VARCHAR)) AS response_id, CAST(turn + 1 AS BIGINT) AS named_in, CAST(n AS BIGINT) AS output_tokens,
 CASE WHEN turn % 3 > 0 THEN turn % 3 * 0.5::DOUBLE END AS ttft_ms, CASE WHEN n > 0 THEN n / 100.0::DOUBLE END AS e2e_latency_ms, ends AS is_terminal, CASE WHEN ask IS NULL THEN false ELSE regexp_matches(ask, '\\S') END AS is_user_start, request_us + greatest(n * 10, 0) AS end_us FROM x)"""


@query(f"WITH {_ANSWERS_SQL} SELECT source_id, session_id, request_us, wire_api, agent_kind, model, is_stream, finish_reason, response_id, named_in AS input_tokens, output_tokens, named_in + output_tokens AS total_tokens, ttft_ms, e2e_latency_ms, is_terminal, is_user_start FROM s")
def spans_from_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["source_id", "session_id", "request_us", "wire_api", "agent_kind", "model", "is_stream", "finish_reason", "response_id", "input_tokens", "output_tokens", "total_tokens", "ttft_ms", "e2e_latency_ms", "is_terminal", "is_user_start"]
    return _conversation_spans(spark, sf_dir).select(*names)


@query(f"""WITH {_ANSWERS_SQL}, t AS (SELECT *, coalesce(sum(CAST(is_terminal AS INT)) OVER (PARTITION BY source_id, session_id ORDER BY request_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn_no FROM s)
SELECT concat(source_id, ':', session_id, ':', CAST(turn_no AS VARCHAR)) AS turn_id, min(request_us) AS start_us, max(end_us) AS end_us, count(*) AS call_count, any_value(model) AS models_used, CASE WHEN bool_or(is_terminal) THEN 'complete' ELSE 'incomplete' END AS status, any_value(agent_kind) AS agent_kind, any_value(wire_api) AS wire_api
FROM t GROUP BY source_id, session_id, turn_no HAVING bool_or(is_user_start)""")
def turns_from_exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = turns.assemble(calls.of_agents(_conversation_spans(spark, sf_dir)))
    return flat(out).select("turn_id", "start_us", "end_us", "call_count", "models_used", "status", "agent_kind", "wire_api")
