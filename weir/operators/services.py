"""Services (endpoints), their applications and the topology between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.json_paths import header


def first_of(values: Column, most: int) -> Column:
    """At most so many distinct values, in order."""
    return F.slice(F.array_sort(F.collect_set(values)), 1, most)


def services(spans: DataFrame, exact: bool = True) -> DataFrame:
    """Figures by endpoint. Distinct values are few by nature (models, APIs, paths of one endpoint)."""
    ttft, e2e = F.col("ttft_ms"), F.col("e2e_latency_ms")
    p95 = lambda x: F.percentile(x, 0.95) if exact else F.percentile_approx(x, 0.95, 1000)
    return spans.groupBy("server_ip", "server_port").agg(
        first_of(F.col("model"), 32).alias("models"), first_of(F.col("wire_api"), 8).alias("wire_apis"), first_of(F.col("request_path"), 16).alias("paths"),
        F.count("*").alias("call_count"), F.sum(F.when(F.col("status_code") >= 400, 1).otherwise(0)).cast("long").alias("error_count"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"), F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        F.sum(F.when(F.col("is_stream"), 1).otherwise(0)).cast("long").alias("stream_count"), F.avg(ttft).alias("ttft_avg"), p95(ttft).alias("ttft_p95"), F.avg(e2e).alias("e2e_avg"), p95(e2e).alias("e2e_p95"), F.min("request_us").alias("first_us"), F.max("request_us").alias("last_us"),
    )


def recent_samples(spans: DataFrame, columns: Sequence[str], most: int = 5) -> DataFrame:
    """The latest spans of each endpoint; Spark drops others before the shuffle."""
    order = Window.partitionBy("server_ip", "server_port").orderBy(F.col("request_us").desc(), F.col("id").desc())
    return spans.select("server_ip", "server_port", "id", "request_us", *columns).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)


def samples(spans: DataFrame, end_us: int, within_us: int = 86_400_000_000, most: int = 5) -> DataFrame:
    """By endpoint, of the last day before ``end_us``: distinct paths and finish reasons, and of the latest ``most`` spans the first of each
    header list and body that is there and of the right shape (bodies are objects, headers are not empty)."""
    own = spans.where((F.col("request_us") >= end_us - within_us) & (F.col("request_us") < end_us))
    lists = own.groupBy("server_ip", "server_port").agg(first_of(F.col("request_path"), 16).alias("sample_paths"), first_of(F.col("finish_reason"), 16).alias("finish_reasons"))
    bodies, headers = ("request_body", "response_body"), ("request_headers", "response_headers")
    recent = recent_samples(own, [*bodies, *headers], most)
    right = {c: F.ltrim(F.col(c)).startswith("{") for c in bodies} | {c: F.size(c) > 0 for c in headers}
    first = recent.groupBy("server_ip", "server_port").agg(*(F.min_by(c, F.when(ok, F.col("rn"))).alias(f"sample_{c}") for c, ok in right.items()))
    return lists.join(first, ["server_ip", "server_port"])


def app_of(paths: Column, response_headers: Column, request_headers: Column, finish_reasons: Column, request_body: Column, response_body: Column, models: Column) -> Column:
    """The application behind an endpoint by the first sign that fits, the surest first: its own paths, headers that it stamps, the host
    asked for, finish reasons and ids that only it makes, its server header, and, for a server header of several, its models; null if there is none."""

    def some(values: Column, test) -> Column:
        return F.coalesce(F.exists(values, test), F.lit(False))

    lower = F.transform(paths, F.lower)
    host, server = (F.coalesce(F.lower(header(h, n)), F.lit("")) for h, n in ((request_headers, "host"), (response_headers, "server")))
    stamped = some(response_headers, lambda h: F.lower(h["name"]).contains("x-litellm-") | F.lower(h["value"]).contains("x-litellm-"))
    own_ids = F.coalesce(response_body.rlike(r'"id": ?"chatcmpl-tool-|"system_fingerprint": ?"fp_'), F.lit(False)) | F.coalesce(request_body.contains("chatcmpl-tool-"), F.lit(False))
    both = server.contains("uvicorn") | server.contains("hypercorn")
    return (
        F.when(some(lower, lambda p: p.rlike(r"^/api/(chat|generate|tags|show)") | (p == "/api/version")), "ollama")
        .when(some(paths, lambda p: p.isin("/completion", "/tokenize", "/detokenize", "/props")), "llamacpp")
        .when(some(paths, lambda p: p.isin("/generate", "/health_generate", "/get_server_info", "/flush_cache", "/encode", "/start_profile", "/stop_profile")), "sglang")
        .when(some(paths, lambda p: (p == "/version") | p.startswith("/v1/score")), "vllm")
        .when(stamped, "litellm")
        .when(host.rlike(r"(^|\.)api\.openai\.com$"), "openai")
        .when(host.rlike(r"(^|\.)api\.anthropic\.com$"), "anthropic")
        .when(host == "generativelanguage.googleapis.com", "gemini")
        .when(some(finish_reasons, lambda r: F.lower(r).isin("matched_stop", "matched_eos", "stop_str")), "sglang")
        .when(own_ids, "vllm")
        .when(server.contains("ollama"), "ollama")
        .when(server.startswith("litellm"), "litellm")
        .when(both & some(models, lambda m: F.lower(m).rlike("(^|/)(glm|deepseek)")), "sglang")
        .when(both, "vllm")
    )


#: What ``samples`` adds to an endpoint.
SAMPLED = ("sample_paths", "finish_reasons", "sample_request_body", "sample_response_body", "sample_request_headers", "sample_response_headers")


def classify(service: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """Adds app to endpoints with paths and models. Without ``sampled`` (see ``samples``) only these can tell."""
    if sampled is None:
        nothing = F.array().cast("array<struct<name:string,value:string>>")
        return service.withColumn("app", app_of(F.col("paths"), nothing, nothing, F.array().cast("array<string>"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("models")))
    both = service.join(sampled, ["server_ip", "server_port"], "left")
    paths = F.when(F.size("sample_paths") > 0, F.col("sample_paths")).otherwise(F.col("paths"))
    return both.withColumn("app", app_of(paths, *map(F.col, ("sample_response_headers", "sample_request_headers", "finish_reasons", "sample_request_body", "sample_response_body", "models")))).drop(*SAMPLED)


#: Applications that pass calls on, and the node of all callers that are no service.
PROXIES, CLIENTS = ("litellm", "haproxy", "nginx"), "__clients__"
_EDGE = ("from_ip", "from_port", "to_ip", "to_port")


def first_hops(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """turn_id, role, pair_id and the endpoints of the first call of each trace (``span_ids``, ``role``, ``pair_id``)."""
    first = traces.select("turn_id", "role", "pair_id", F.get("span_ids", F.lit(0)).alias("id"))
    return first.join(spans.select("id", "client_ip", "server_ip", "server_port"), "id").drop("id")


def topology(nodes: DataFrame, hops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (server_ip, server_port, app, models, call_count) and edges (kind, from_ip, from_port, to_ip, to_port, turn_count).

    ``nodes``: classified endpoints; ``hops``: ``first_hops``. Legs of one pair make `proxy` edges, from the endpoint outside to the one inside.
    Every turn but those inside a proxy also has a caller: an address with services of its own makes an `inferred` edge, unless the
    target is a proxy itself or a proxy edge shows it already; of several services on an address the litellm one is taken, then another proxy, then the one with
    most calls, ties by port, and never the target. All other callers are one node of `client` edges.
    """
    ends = [F.col("server_ip"), F.col("server_port")]
    outside = hops.where("role = 'proxy_in'").select("pair_id", F.col("turn_id").alias("a"), *(c.alias(n) for c, n in zip(ends, _EDGE[:2])))
    inside = hops.where("role = 'proxy_out'").select("pair_id", F.col("turn_id").alias("b"), *(c.alias(n) for c, n in zip(ends, _EDGE[2:])))
    legs = outside.join(inside, "pair_id").where("a <> b and not (from_ip = to_ip and from_port = to_port)")
    proxied = legs.groupBy(*_EDGE).agg(F.count("*").alias("turn_count"))

    # few rows from here on: one for each caller and endpoint
    entries = hops.where(F.coalesce("role", F.lit("")) != "proxy_out").groupBy(F.col("client_ip").alias("caller"), ends[0].alias("to_ip"), ends[1].alias("to_port")).agg(F.count("*").alias("turn_count"))
    passes = F.coalesce(F.col("app").isin(*PROXIES), F.lit(False))
    target = nodes.select(ends[0].alias("to_ip"), ends[1].alias("to_port"), passes.alias("to_proxy"))
    rank = F.when(F.col("app") == "litellm", 0).when(passes, 1).otherwise(2)
    calls = F.when(passes, 0).otherwise(-F.col("call_count"))
    sources = nodes.select(ends[0].alias("caller"), ends[1].alias("port"), F.struct(rank.alias("rank"), calls.alias("calls"), ends[1].alias("port")).alias("order"))
    known = entries.join(target, ["to_ip", "to_port"], "left").join(sources, "caller", "left")
    usable = F.when(~F.coalesce("to_proxy", F.lit(False)) & ~((F.col("caller") == F.col("to_ip")) & (F.col("port") == F.col("to_port"))), F.col("order"))
    found = known.groupBy("caller", "to_ip", "to_port", "turn_count").agg(F.min(usable)["port"].alias("from_port"))
    inferred = found.where("from_port is not null").groupBy(F.col("caller").alias("from_ip"), "from_port", "to_ip", "to_port").agg(F.sum("turn_count").alias("turn_count")).join(proxied.select(*_EDGE), list(_EDGE), "left_anti")
    clients = found.where("from_port is null").groupBy(F.lit(CLIENTS).alias("from_ip"), F.lit(0).alias("from_port"), "to_ip", "to_port").agg(F.sum("turn_count").alias("turn_count"))
    edges = None
    for kind, rows in (("proxy", proxied), ("inferred", inferred), ("client", clients)):
        own = rows.select(F.lit(kind).alias("kind"), *_EDGE, F.col("turn_count").cast("long").alias("turn_count"))
        edges = own if edges is None else edges.unionByName(own)
    total = clients.agg(F.sum("turn_count").cast("long").alias("call_count")).where("call_count > 0")
    shown = nodes.select("server_ip", "server_port", "app", "models", "call_count")
    extra = total.select(F.lit(CLIENTS).alias("server_ip"), F.lit(0).alias("server_port"), F.lit("clients").alias("app"), F.array().cast("array<string>").alias("models"), "call_count")
    return shown.unionByName(extra), edges
