"""Spans, exchanges and calls of agents, projected from the given tables, in DataFrame form and as SQL for comparison.

Event times are whole microseconds since 1970 (``*_us``), so no session time zone can shift a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the wire formats.
ANTHROPIC, CHAT, RESPONSES, GEMINI = "anthropic", "openai-chat", "openai-responses", "gemini-aistudio"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPAN_COLUMNS = """
    CAST(event_id AS {string}) AS id,
    concat('src-', CAST(user_id % 2 AS {string})) AS source_id,
    concat('10.1.0.', CAST(user_id % 16 AS {string})) AS client_ip,
    CAST(40000 + event_id % 1000 AS INT) AS client_port,
    concat('10.0.0.', CAST(user_id % 4 AS {string})) AS server_ip,
    CAST(8000 + user_id % 3 AS INT) AS server_port,
    request_us,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE request_us + CAST(floor(value * 1000 + 0.5) AS BIGINT) END AS response_us,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE request_us + CAST(floor(value * 2000 + 0.5) AS BIGINT) END AS complete_us,
    CASE event_type WHEN 'signup' THEN 'anthropic' WHEN 'view' THEN 'openai-responses' WHEN 'click' THEN 'gemini-aistudio' ELSE 'openai-chat' END AS wire_api,
    concat('m', CAST(k % 5 AS {string})) AS model,
    event_id % 2 = 0 AS is_stream,
    concat('/v1/', CASE event_type WHEN 'signup' THEN 'messages' WHEN 'view' THEN 'responses' WHEN 'click' THEN 'generate' ELSE 'chat/completions' END) AS request_path,
    CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 3 = 0 THEN 429 WHEN event_id % 3 = 1 THEN 500 ELSE 404 END AS INT) AS status_code,
    CASE WHEN event_type = 'error' THEN NULL WHEN event_id % 4 = 0 THEN 'length' WHEN event_id % 9 = 0 THEN 'tool_calls' ELSE 'stop' END AS finish_reason,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 1000 END AS input_tokens,
    CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 300 END AS output_tokens,
    CASE WHEN event_id % 3 = 0 THEN event_id % 50 END AS cache_read_input_tokens,
    CASE WHEN event_id % 10 = 0 THEN event_id % 40 END AS cache_creation_input_tokens,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS ttft_ms,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE value * 2 END AS e2e_latency_ms,
    CASE event_id % 6 WHEN 0 THEN 'function_call' WHEN 1 THEN 'mcp' WHEN 2 THEN 'cli' ELSE NULL END AS tool_surface
"""

#: The same projection for DuckDB.
SPANS_SQL = f"""spans AS (SELECT {_SPAN_COLUMNS.format(string="VARCHAR")}
FROM (SELECT *, epoch_us(ts) AS request_us, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One LLM call for each event; nulls by modulus, so that every null path is met."""
    events = read(spark, sf_dir, "events").withColumns({
        "request_us": F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"),
        "k": F.get_json_object("props", "$.k").cast("long"),
    })
    return events.selectExpr(*[c.strip() for c in _split(_SPAN_COLUMNS.format(string="STRING"))])


def _split(columns: str) -> list[str]:
    """Select items, cut at the commas outside parentheses."""
    out, depth, at = [], 0, 0
    for k, c in enumerate(columns):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(columns[at:k])
            at = k + 1
    return [*out, columns[at:]]


#: A turn starts with each user row; the last assistant row before the next one ends it.
CALLS_SQL = """calls AS (
SELECT conv_id, turn, role, text,
  sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_no
FROM conversations)"""


def http_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests and responses of flows: an order is a request of its customer's flow, each of its lines a response."""
    orders = read(spark, sf_dir, "orders")
    lines = read(spark, sf_dir, "lineitem")
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {})"
    requests = orders.select(F.col("o_custkey").alias("flow"), F.expr(us.format("o_orderdate")).alias("ts_us"), F.lit(0).alias("kind"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("label"))
    responses = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("flow"), F.expr(us.format("l_shipdate")).alias("ts_us"), F.lit(1).alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_returnflag").alias("label"))
    return requests.union(responses)


HTTP_EVENTS_SQL = """http_events AS (
SELECT o_custkey AS flow, epoch_us(o_orderdate) AS ts_us, 0 AS kind, o_orderkey AS seq, o_orderpriority AS label FROM orders
UNION ALL
SELECT o_custkey, epoch_us(l_shipdate), 1, l_orderkey * 10 + l_linenumber, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
