"""Queries over spans, rollups, exchanges and services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import exchanges, listing, metrics, predicates, services
from ..sources import bridge

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, rounded: tuple[str, ...] = ()) -> Callable:
    """Registers a query with its SQL. Both round the columns ``rounded``, as engines add floating-point numbers in their own order."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir).withColumns({c: F.round(c, 9) for c in rounded}) if rounded else f(spark, sf_dir)
        ORACLE_SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(f'round({c}, 9) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
        return f

    return add


COUNTERS_SQL = """count(*) AS call_count,
  CAST(count(*) FILTER (is_stream) AS BIGINT) AS stream_count, CAST(count(*) FILTER (NOT is_stream) AS BIGINT) AS non_stream_count,
  CAST(count(*) FILTER (status_code >= 400) AS BIGINT) AS error_count, CAST(count(*) FILTER (status_code BETWEEN 400 AND 499) AS BIGINT) AS error_4xx_count,
  CAST(count(*) FILTER (status_code = 429) AS BIGINT) AS error_429_count, CAST(count(*) FILTER (status_code >= 500) AS BIGINT) AS error_5xx_count,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens_sum, count(input_tokens) AS input_tokens_count,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens_sum, count(output_tokens) AS output_tokens_count,
  CAST(coalesce(sum(cache_read_input_tokens), 0) AS BIGINT) AS cache_read_tokens_sum, count(cache_read_input_tokens) AS cache_read_tokens_count,
  CAST(coalesce(sum(cache_creation_input_tokens), 0) AS BIGINT) AS cache_creation_tokens_sum, count(cache_creation_input_tokens) AS cache_creation_tokens_count"""
_VALUES = {
    "ttft": "ttft_ms",
    "ttft_stream": "CASE WHEN is_stream THEN ttft_ms END",
    "ttft_nonstream": "CASE WHEN NOT is_stream THEN ttft_ms END",
    "e2e": "e2e_latency_ms",
    "tpot": "CASE WHEN is_stream AND complete_us - response_us > 0 AND output_tokens > 0 THEN (complete_us - response_us) / 1000.0::DOUBLE / output_tokens END",
}
DISTRIBUTIONS_SQL = ",\n  ".join(f"coalesce(sum({x}), 0.0::DOUBLE) AS {n}_sum, count({x}) AS {n}_count, " + ", ".join(f"quantile_cont({x}, {p / 100}) AS {n}_p{p}" for p in (50, 95, 99)) for n, x in _VALUES.items())


def rollup_sql(granularities: dict[str, int], distributions: str = DISTRIBUTIONS_SQL) -> str:
    """A CTE by GROUPING SETS for each granularity."""
    one = """SELECT request_us - request_us % {us} AS window_us, source_id, '{name}' AS granularity, coalesce(wire_api, '*') AS wire_api, coalesce(model, '*') AS model, coalesce(server_ip, '*') AS server_ip, tool_surface,
  {counters}, {distributions}
FROM spans GROUP BY GROUPING SETS ((1, 2, spans.wire_api, spans.model, spans.server_ip, tool_surface), (1, 2, spans.wire_api, spans.model, tool_surface), (1, 2, spans.server_ip, tool_surface), (1, 2, tool_surface))"""
    one = one.replace("coalesce(wire_api", "coalesce(spans.wire_api").replace("coalesce(model", "coalesce(spans.model").replace("coalesce(server_ip", "coalesce(spans.server_ip").replace("((1, 2,", "((window_start, source_id,").replace("(1, 2,", "(window_start, source_id,")
    parts = [one.replace("FROM spans", f"FROM (SELECT *, request_us - request_us % {s * 1_000_000} AS window_start FROM spans) AS spans").replace("request_us - request_us % {us} AS window_us", "window_start AS window_us").format(name=n, counters=COUNTERS_SQL, distributions=distributions) for n, s in granularities.items()]
    return "rollup AS (" + "\nUNION ALL\n".join(parts) + ")"


_ALL = bridge.SPANS_SQL
_10S = {"10s": 10}
_1H = {"1h": 3600}


_DOUBLES = tuple(f"{d}_{x}" for d in metrics.DISTRIBUTIONS for x in ("sum", "p50", "p95", "p99"))


@query(f"WITH {_ALL},\n{rollup_sql({'5m': 300, '1h': 3600})} SELECT * FROM rollup", _DOUBLES)
def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.rollup(bridge.spans(spark, sf_dir), {"5m": 300, "1h": 3600})


_AVG = ", ".join(f"CASE WHEN sum({d}_count) > 0 THEN sum({d}_sum) / sum({d}_count) END AS {d}_avg" for d in metrics.DISTRIBUTIONS)
_SUMS = ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in metrics.COUNTERS)


@query(f"WITH {_ALL},\n{rollup_sql(_10S)} SELECT {_SUMS}, {_AVG} FROM rollup WHERE wire_api = '*' AND model = '*' AND server_ip = '*'", tuple(f"{d}_avg" for d in metrics.DISTRIBUTIONS))
def metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.rollup(bridge.spans(spark, sf_dir), _10S)
    return metrics.summary(rows, 0, predicates.LATEST_SECOND * 1_000_000, predicates.tier())


_P95 = "CASE WHEN sum(CASE WHEN e2e_p95 IS NOT NULL THEN e2e_count END) > 0 THEN sum(e2e_p95 * CASE WHEN e2e_p95 IS NOT NULL THEN e2e_count END) / sum(CASE WHEN e2e_p95 IS NOT NULL THEN e2e_count END) END"


@query(f"WITH {_ALL},\n{rollup_sql(_1H)} SELECT window_us // 1000000 AS ts, wire_api, CAST(sum(call_count) AS BIGINT) AS call_count, CASE WHEN sum(ttft_count) > 0 THEN sum(ttft_sum) / sum(ttft_count) END AS ttft_avg, {_P95} AS e2e_p95 FROM rollup WHERE wire_api <> '*' AND model <> '*' AND server_ip = '*' GROUP BY 1, 2", ("ttft_avg", "e2e_p95"))
def metrics_timeseries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.rollup(bridge.spans(spark, sf_dir), _1H)
    return metrics.timeseries(rows, ["call_count", "ttft_avg", "e2e_p95"], "1h", 0, predicates.LATEST_SECOND * 1_000_000, predicates.tier(group_by="wire_api"), "wire_api")


@query(f"""WITH {_ALL},\n{rollup_sql(_1H)},
b AS (SELECT min(window_us) // 1000000 AS lo, max(window_us) // 1000000 + 3600 AS hi FROM rollup),
g AS (SELECT unnest(range(lo, hi, 3600)) AS ts FROM b), f AS (SELECT unnest(['call_count', 'error_count']) AS field),
s AS (SELECT window_us // 1000000 AS ts, sum(call_count) AS c, sum(error_count) AS e FROM rollup WHERE wire_api = '*' AND model = '*' AND server_ip = '10.0.0.1' AND tool_surface = 'cli' GROUP BY 1)
SELECT '' AS "group", field, g.ts AS ts, CAST(CASE field WHEN 'call_count' THEN c ELSE e END AS DOUBLE) AS value FROM g CROSS JOIN f LEFT JOIN s ON g.ts = s.ts""")
def metrics_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.rollup(bridge.spans(spark, sf_dir), _1H)
    lo, hi = rows.agg(F.min("window_us"), F.max("window_us")).first()
    start, end = (lo or 0) // 1_000_000, (hi or -3_600_000_000) // 1_000_000 + 3600
    step = predicates.check_buckets(start, end, "1h")
    fields = ["call_count", "error_count"]
    series = metrics.timeseries(rows, fields, "1h", start * 1_000_000, end * 1_000_000, predicates.tier(server_ips=["10.0.0.1"]) & predicates.one_of("tool_surface", ["cli"]))
    return metrics.on_grid(series, fields, start, end, step)


@query(f"WITH {_ALL},\n{rollup_sql(_10S)} SELECT wire_api, model, CAST(sum(call_count) AS BIGINT) AS call_count, CAST(sum(error_count) AS BIGINT) AS error_count, CAST(sum(input_tokens_sum) AS BIGINT) AS input_tokens_sum, CAST(sum(output_tokens_sum) AS BIGINT) AS output_tokens_sum, CASE WHEN sum(ttft_count) > 0 THEN sum(ttft_sum) / sum(ttft_count) END AS ttft_avg, CASE WHEN sum(e2e_count) > 0 THEN sum(e2e_sum) / sum(e2e_count) END AS e2e_avg, {_P95} AS e2e_p95 FROM rollup WHERE wire_api <> '*' AND model <> '*' AND server_ip = '*' GROUP BY 1, 2 ORDER BY call_count DESC, wire_api, model LIMIT 20", ("ttft_avg", "e2e_avg", "e2e_p95"))
def metrics_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.by_model(metrics.rollup(bridge.spans(spark, sf_dir), _10S), 0, predicates.LATEST_SECOND * 1_000_000)


@query(f"WITH {_ALL} SELECT finish_reason, request_us - request_us % 3600000000 AS window_us, count(*) AS count FROM spans WHERE finish_reason IS NOT NULL GROUP BY 1, 2")
def finish_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.finish_series(metrics.finish_rollup(bridge.spans(spark, sf_dir), _1H), "1h")


@query(f"WITH {_ALL}, x AS (SELECT source_id, id, request_us AS ts, 1 AS d FROM spans UNION ALL SELECT source_id, id, complete_us, -1 FROM spans WHERE complete_us IS NOT NULL), r AS (SELECT *, sum(d) OVER (PARTITION BY source_id ORDER BY ts, d, id ROWS UNBOUNDED PRECEDING) AS s FROM x), m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY source_id ORDER BY ts, d, id ROWS UNBOUNDED PRECEDING)) AS a FROM r) SELECT source_id, ts - ts % 60000000 AS window_us, CAST(max(a) AS BIGINT) AS active_calls_max FROM m WHERE d = 1 GROUP BY 1, 2")
def active_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.active_calls(bridge.spans(spark, sf_dir))


@query(f"WITH {_ALL} SELECT DISTINCT 'wire_api' AS dimension, wire_api AS value FROM spans UNION ALL SELECT DISTINCT 'model', model FROM spans UNION ALL SELECT DISTINCT 'server_ip', server_ip FROM spans")
def filter_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.rollup(bridge.spans(spark, sf_dir), _1H).select("wire_api", "model", "server_ip").distinct()
    out = [listing.distinct_values(rows, c).select(F.lit(c).alias("dimension"), "value") for c in ("wire_api", "model", "server_ip")]
    return out[0].union(out[1]).union(out[2])


_PAGE = "id, source_id, server_ip, server_port, wire_api, model, request_us, status_code, is_stream, e2e_latency_ms"
_WHERE = "wire_api IN ('openai-chat', 'anthropic') AND request_path LIKE '%/v1/%' AND is_stream = TRUE AND status_code IN (200, 429)"


@query(f"WITH {_ALL} SELECT {_PAGE} FROM spans WHERE {_WHERE} ORDER BY e2e_latency_ms DESC NULLS LAST, id LIMIT 50 OFFSET 50")
def spans_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = [predicates.one_of("wire_api", ["openai-chat", "anthropic"]), predicates.like("request_path", " /v1/ "), predicates.equals("is_stream", True), predicates.one_of("status_code", [200, 429])]
    rows = bridge.spans(spark, sf_dir)
    return listing.page(rows, where, "e2e_latency_ms", ("request_us", "e2e_latency_ms", "ttft_ms", "status_code"), "id", number=2).select(*_PAGE.split(", "))


@query(f"WITH {_ALL} SELECT count(*) AS total FROM spans WHERE {_WHERE}")
def spans_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = [predicates.one_of("wire_api", ["openai-chat", "anthropic"]), predicates.like("request_path", "/v1/"), predicates.equals("is_stream", True), predicates.one_of("status_code", [200, 429])]
    return listing.total(bridge.spans(spark, sf_dir), where)


@query(f"WITH {_ALL} SELECT {_PAGE} FROM spans WHERE id = '42'")
def span_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.lookup(bridge.spans(spark, sf_dir), "id", "42").select(*_PAGE.split(", "))


@query(f"WITH {_ALL}, i AS (SELECT CAST(user_id AS VARCHAR) AS \"group\", CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = 'purchase') SELECT i.\"group\" AS \"group\", s.id AS id, request_us, CAST(row_number() OVER (PARTITION BY i.\"group\" ORDER BY request_us, complete_us NULLS LAST, s.id) AS INT) AS sequence FROM spans s JOIN i ON s.id = i.id")
def spans_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bridge.read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("group"), F.col("event_id").cast("string").alias("id"))
    return listing.fetch(bridge.spans(spark, sf_dir), ids).select("group", "id", "request_us", "sequence")


@query("WITH p AS (SELECT page_id, url, length(html) AS size FROM pages) SELECT page_id, url, size FROM p WHERE url LIKE '%/en/%' ORDER BY size DESC NULLS LAST, page_id LIMIT 50")
def exchanges_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "pages").select("page_id", "url", F.char_length("html").cast("long").alias("size"))
    return listing.page(rows, [predicates.like("url", "/en/")], "size", ("size", "page_id"), "page_id")


@query(f"""WITH {bridge.HTTP_EVENTS_SQL},
n AS (SELECT *, sum(CASE WHEN kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY flow ORDER BY ts_us, kind, seq ROWS UNBOUNDED PRECEDING) AS n FROM http_events),
q AS (SELECT flow, n, seq AS request, ts_us AS request_us FROM n WHERE kind = 0),
r AS (SELECT flow, n, seq AS response, ts_us AS response_us, label AS response_label FROM n WHERE kind = 1 AND n > 0 QUALIFY row_number() OVER (PARTITION BY flow, n ORDER BY ts_us, seq) = 1)
SELECT q.flow, request, request_us, response, response_us, response_label, (response_us - request_us) / 1000.0::DOUBLE AS duration_ms FROM q LEFT JOIN r ON q.flow = r.flow AND q.n = r.n""")
def http_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exchanges.pair(bridge.http_events(spark, sf_dir))


@query("WITH p AS (SELECT user_id % 50 AS source_id, epoch_us(ts) AS ts_us, event_id AS seq FROM events), b AS (SELECT *, lag(ts_us) OVER (PARTITION BY source_id ORDER BY ts_us, seq) AS before FROM p) SELECT source_id, ts_us AS heartbeat_us, seq FROM b WHERE before IS NULL OR ts_us - before >= 600000000")
def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = bridge.read(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("source_id"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)").alias("ts_us"), F.col("event_id").alias("seq"))
    return exchanges.heartbeats(packets, 600_000_000)


SERVICES_SQL = """services AS (SELECT server_ip, server_port, list_sort(list_distinct(array_agg(model)))[1:32] AS models, list_sort(list_distinct(array_agg(wire_api)))[1:8] AS wire_apis, list_sort(list_distinct(array_agg(request_path)))[1:16] AS paths,
count(*) AS call_count, CAST(count(*) FILTER (status_code >= 400) AS BIGINT) AS error_count, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
CAST(count(*) FILTER (is_stream) AS BIGINT) AS stream_count, avg(ttft_ms) AS ttft_avg, quantile_cont(ttft_ms, 0.95) AS ttft_p95, avg(e2e_latency_ms) AS e2e_avg, quantile_cont(e2e_latency_ms, 0.95) AS e2e_p95, min(request_us) AS first_us, max(request_us) AS last_us FROM spans GROUP BY 1, 2)"""


@query(f"WITH {_ALL}, {SERVICES_SQL} SELECT * EXCLUDE (models, wire_apis, paths), array_to_string(models, ',') AS models, array_to_string(wire_apis, ',') AS wire_apis, array_to_string(paths, ',') AS paths FROM services", ("ttft_avg", "ttft_p95", "e2e_avg", "e2e_p95"))
def service_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = services.services(bridge.spans(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("models", "wire_apis", "paths")})


@query(f"WITH {_ALL} SELECT server_ip, server_port, id, request_us, request_path, CAST(row_number() OVER (PARTITION BY server_ip, server_port ORDER BY request_us DESC, id DESC) AS INT) AS rn FROM spans QUALIFY rn <= 5")
def service_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.recent_samples(bridge.spans(spark, sf_dir), ["request_path"])


#: Turns of one call; every third pair of neighbours is seen on both sides of a proxy. Services on port 8000 are proxies; some callers are services.
_HOPS = """hops AS (SELECT CAST(id AS BIGINT) AS n, CASE WHEN n // 2 % 3 = 0 THEN CASE WHEN n % 2 = 0 THEN 'proxy_in' ELSE 'proxy_out' END END AS role, n // 2 AS pair_id, CASE WHEN n % 4 = 0 THEN concat('10.0.0.', CAST(n % 5 AS VARCHAR)) ELSE client_ip END AS client_ip, server_ip, server_port FROM spans),
n AS (SELECT server_ip, server_port, CASE server_port WHEN 8000 THEN 'litellm' ELSE 'vllm' END AS app, count(*) AS call_count FROM spans GROUP BY ALL),
p AS (SELECT a.server_ip AS from_ip, a.server_port AS from_port, b.server_ip AS to_ip, b.server_port AS to_port, count(*) AS turn_count FROM hops a JOIN hops b ON a.pair_id = b.pair_id AND a.role = 'proxy_in' AND b.role = 'proxy_out' WHERE a.server_ip <> b.server_ip OR a.server_port <> b.server_port GROUP BY ALL),
e AS (SELECT client_ip, server_ip, server_port, count(*) AS turn_count FROM hops WHERE coalesce(role, '') <> 'proxy_out' GROUP BY ALL),
c AS (SELECT e.*, n.server_port AS from_port, row_number() OVER (PARTITION BY e.client_ip, e.server_ip, e.server_port ORDER BY n.server_port IS NULL, n.app = 'litellm' DESC, n.call_count DESC, n.server_port) AS rn
  FROM e LEFT JOIN n ON e.server_port <> 8000 AND n.server_ip = e.client_ip AND NOT (n.server_ip = e.server_ip AND n.server_port = e.server_port)),
k AS (SELECT 'proxy' AS kind, * FROM p UNION ALL
  SELECT 'inferred', client_ip, from_port, server_ip, server_port, sum(turn_count) FROM c WHERE rn = 1 AND from_port IS NOT NULL AND (client_ip, from_port, server_ip, server_port) NOT IN (SELECT (from_ip, from_port, to_ip, to_port) FROM p) GROUP BY ALL UNION ALL
  SELECT 'client', '__clients__', 0, server_ip, server_port, sum(turn_count) FROM c WHERE rn = 1 AND from_port IS NULL GROUP BY ALL)"""


def _topology(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    spans = bridge.spans(spark, sf_dir)
    number, pairs = F.col("id").cast("long"), "array<struct<name:string,value:string>>"
    stamp = F.when(F.col("server_port") == 8000, F.array(F.struct(F.lit("x-litellm-key").alias("name"), F.lit("1").alias("value")))).otherwise(F.array(F.struct(F.lit("server").alias("name"), F.lit("uvicorn").alias("value"))))
    seen = spans.withColumns({"client_ip": F.when(number % 4 == 0, F.concat(F.lit("10.0.0."), (number % 5).cast("string"))).otherwise(F.col("client_ip")), "response_headers": stamp, "request_headers": F.array().cast(pairs), "request_body": F.lit(None).cast("string"), "response_body": F.lit(None).cast("string")})
    nodes = services.classify(services.services(seen), services.samples(seen, 1 << 60, 1 << 61))
    pair = F.floor(number / 2)
    traces = spans.select(F.col("id").alias("turn_id"), F.when(pair % 3 == 0, F.when(number % 2 == 0, "proxy_in").otherwise("proxy_out")).alias("role"), pair.alias("pair_id"), F.array("id").alias("span_ids"))
    return services.topology(nodes, services.first_hops(traces, seen))


@query(f"WITH {_ALL}, {_HOPS} SELECT kind, from_ip, CAST(from_port AS INT) AS from_port, to_ip, to_port, CAST(turn_count AS BIGINT) AS turn_count FROM k")
def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topology(spark, sf_dir)[1]


@query(f"WITH {_ALL}, {_HOPS} SELECT * FROM n UNION ALL SELECT '__clients__', 0, 'clients', CAST(sum(turn_count) AS BIGINT) FROM k WHERE kind = 'client' HAVING count(*) > 0")
def topology_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _topology(spark, sf_dir)[0].drop("models")


@query(f"WITH {_ALL}, c AS (SELECT model, request_us - request_us % 3600000000 AS window_us, count(*) AS n, count(*) FILTER (status_code >= 400) AS e, count(*) FILTER (status_code = 429) AS t, coalesce(sum(input_tokens), 0) AS i, coalesce(sum(output_tokens), 0) AS o, coalesce(sum(cache_read_input_tokens), 0) AS r FROM spans GROUP BY 1, 2) SELECT model, window_us, n / 3600.0::DOUBLE AS call_rate, (i + o) / 3600.0::DOUBLE AS token_rate, e / n::DOUBLE AS error_rate, 1 - e / n::DOUBLE AS success_rate, t / n::DOUBLE AS throttled_rate, CASE WHEN i > 0 THEN r / i::DOUBLE END AS cache_hit_rate FROM c", ("call_rate", "token_rate", "error_rate", "success_rate", "throttled_rate", "cache_hit_rate"))
def metrics_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = bridge.spans(spark, sf_dir)
    hourly = spans.groupBy("model", (F.col("request_us") - F.col("request_us") % 3_600_000_000).alias("window_us")).agg(*metrics.counters())
    names = ["call_rate", "token_rate", "error_rate", "success_rate", "throttled_rate", "cache_hit_rate"]
    return metrics.rates(hourly, 3600).select("model", "window_us", *names)
