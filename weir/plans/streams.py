"""Queries over streams: folded answers, calls under way over batches, sketch rollups, and turns under way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import folds, messages, tokens
from ..operators import gauge, metrics, sketches, turns
from ..sources import bridge, shared
from ..store import Store
from ..streaming import tracker
from .traffic import query, rollup_sql


def _events(*data: Column) -> Column:
    return F.concat(*(F.concat(F.lit("data: "), d, F.lit("\n\n")) for d in data))


def _json(**fields: Column | str | int) -> Column:
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items())))


def _struct(**fields: Column | str | int) -> Column:
    return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()))


def _streamed(text: Column, ids: tuple[Column, Column], args: tuple[Column, Column]) -> dict[str, Column]:
    """An answer of a text and two tool calls as each API streams it: cut in two, and dealt in turns."""
    one, two = F.substring(text, 1, 7), F.substring(text, 8, 1 << 30)
    cut = [(F.substring(a, 1, 4), F.substring(a, 5, 1 << 30)) for a in args]

    def delta(index: int, **fields: Column | str) -> Column:
        return _json(type="content_block_delta", index=index, delta=_struct(**fields))

    def opened(k: int) -> Column:
        return _json(type="content_block_start", index=k + 1, content_block=_struct(type="tool_use", id=ids[k], name=f"f{k}"))

    def part(k: int, n: int) -> Column:
        return delta(k + 1, type="input_json_delta", partial_json=cut[k][n])

    def called(k: int, n: int) -> Column:
        own = {"index": F.lit(k)} | ({"id": ids[k]} if n == 0 else {}) | {"function": _struct(**({"name": F.lit(f"f{k}")} if n == 0 else {}), arguments=cut[k][n])}
        return _json(choices=F.array(_struct(delta=_struct(tool_calls=F.array(_struct(**own))))))

    def item(k: int) -> Column:
        return _json(type="response.output_item.done", item=_struct(type="function_call", call_id=ids[k], name=f"f{k}", arguments=args[k]))

    message = _struct(type="message", content=F.array(_struct(type="output_text", text=text)))
    calls = [_struct(functionCall=_struct(name=f"f{k}", id=ids[k], args=F.from_json(args[k], "map<string,long>"))) for k in (0, 1)]
    return {
        "anthropic": _events(
            _json(type="message_start", message=_struct(id="m", role="assistant")), opened(1), _json(type="content_block_start", index=0, content_block=_struct(type="text", text="")), opened(0),
            part(0, 0), delta(0, type="text_delta", text=one), part(1, 0), part(0, 1), delta(0, type="text_delta", text=two), part(1, 1), _json(type="message_delta", delta=_struct(stop_reason="tool_use")),
        ),
        "openai-chat": _events(_json(id="c", model="m", choices=F.array(_struct(delta=_struct(content=one)))), called(1, 0), called(0, 0), called(0, 1), _json(choices=F.array(_struct(delta=_struct(content=two), finish_reason="tool_calls"))), called(1, 1), F.lit("[DONE]")),
        "openai-responses": _events(_json(type="response.output_item.done", item=message), item(0), item(1), _json(type="response.completed", response=_struct(id="r", status="completed"))),
        "gemini-aistudio": _events(
            _json(responseId="g", candidates=F.array(_struct(content=_struct(parts=F.array(_struct(text=one)))))), _json(candidates=F.array(_struct(content=_struct(parts=F.array(calls[0]))))),
            _json(candidates=F.array(_struct(content=_struct(parts=F.array(_struct(text=two)))))), _json(candidates=F.array(_struct(content=_struct(parts=F.array(calls[1])), finishReason="STOP"))),
        ),
    }


#: Where each API has the ids, names and arguments of its tool calls.
_CALLS = {
    "anthropic": ("$.content[1].id", "$.content[2].name", "$.content[1].input.c", "$.content[2].input.t"),
    "openai-chat": ("$.choices[0].message.tool_calls[0].id", "$.choices[0].message.tool_calls[1].function.name", "$.choices[0].message.tool_calls[0].function.arguments", "$.choices[0].message.tool_calls[1].function.arguments"),
    "openai-responses": ("$.output[1].call_id", "$.output[2].name", "$.output[1].arguments", "$.output[2].arguments"),
    "gemini-aistudio": ("$.candidates[0].content.parts[1].functionCall.id", "$.candidates[0].content.parts[2].functionCall.name", "$.candidates[0].content.parts[1].functionCall.args.c", "$.candidates[0].content.parts[2].functionCall.args.t"),
}


@query("""WITH a AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'anthropic' WHEN 1 THEN 'openai-chat' WHEN 2 THEN 'openai-responses' ELSE 'gemini-aistudio' END AS wire_api, nullif(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g'), '') AS text FROM conversations)
SELECT conv_id, turn, wire_api, text, concat('t', CAST(conv_id AS VARCHAR)) AS first_id, 'f1' AS second_name, CASE WHEN conv_id % 2 = 1 AND conv_id % 4 <> 3 OR conv_id % 4 = 2 THEN concat('{"c":', CAST(conv_id AS VARCHAR), '}') ELSE CAST(conv_id AS VARCHAR) END AS first_arguments,
CASE WHEN conv_id % 2 = 1 AND conv_id % 4 <> 3 OR conv_id % 4 = 2 THEN concat('{"t":', CAST(turn AS VARCHAR), '}') ELSE CAST(turn AS VARCHAR) END AS second_arguments FROM a""")
def sse_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bridge.read(spark, sf_dir, "conversations").withColumn("said", F.coalesce("text", F.lit("")))
    conv, turn = F.col("conv_id"), F.col("turn")
    apis = list(_CALLS)
    streams = _streamed(F.col("said"), (F.concat(F.lit("t"), conv.cast("string")), F.concat(F.lit("u"), turn.cast("string"))), (_json(c=conv), _json(t=turn)))
    api = F.get(F.array(*map(F.lit, apis)), (conv % 4).cast("int"))
    stream = F.when(conv % 4 == 0, streams[apis[0]]).when(conv % 4 == 1, streams[apis[1]]).when(conv % 4 == 2, streams[apis[2]]).otherwise(streams[apis[3]])
    own = rows.select("conv_id", "turn", api.alias("wire_api"), stream.alias("stream")).select("conv_id", "turn", "wire_api", folds.body(F.col("wire_api"), F.col("stream")).alias("body"))
    names = ("first_id", "second_name", "first_arguments", "second_arguments")
    found = {n: F.coalesce(*(F.when(F.col("wire_api") == a, F.get_json_object("body", _CALLS[a][k])) for a in apis)) for k, n in enumerate(names)}
    return own.select("conv_id", "turn", "wire_api", messages.answer_text(F.col("wire_api"), F.col("body")).alias("text"), *(c.alias(n) for n, c in found.items()))


_STEPS_SQL = """tier AS (SELECT unnest([1, 2, 3, 4]) AS t), own AS (SELECT source_id, CASE WHEN t <= 2 THEN wire_api ELSE '*' END AS wire_api, CASE WHEN t <= 2 THEN model ELSE '*' END AS model, CASE WHEN t IN (1, 3) THEN server_ip ELSE '*' END AS server_ip, id, request_us, complete_us FROM spans, tier),
x AS (SELECT source_id, wire_api, model, server_ip, id, request_us AS ts, 1 AS d FROM own UNION ALL SELECT source_id, wire_api, model, server_ip, id, greatest(complete_us, request_us + 1), -1 FROM own WHERE complete_us IS NOT NULL),
r AS (SELECT *, sum(d) OVER w AS s FROM x WINDOW w AS (PARTITION BY source_id, wire_api, model, server_ip ORDER BY ts, d, id ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY source_id, wire_api, model, server_ip ORDER BY ts, d, id ROWS UNBOUNDED PRECEDING)) AS a FROM r)"""


@query(f"WITH {bridge.SPANS_SQL}, {_STEPS_SQL} SELECT source_id, wire_api, model, server_ip, ts - ts % 3600000000 AS window_us, CAST(max(a) AS BIGINT) AS active_calls_max, CAST(sum(a) AS BIGINT) AS active_calls_sum, count(*) AS active_calls_samples FROM m WHERE d = 1 GROUP BY ALL")
def active_calls_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls under way in three batches, in the order of their starts, each counted on from the one before."""
    spans = bridge.spans(spark, sf_dir)
    cuts = spans.agg(F.percentile_approx("request_us", [0.3, 0.7], 1000)).first()[0] or [0, 0]
    before, waiting, clocks, out = None, None, None, None
    for k in range(3):
        own = gauge.steps(spans.where((F.col("request_us") >= cuts[k - 1] if k else F.lit(True)) & (F.col("request_us") < cuts[k] if k < 2 else F.lit(True))))
        now, waiting, clocks = gauge.due(own if waiting is None else own.unionByName(waiting), clocks)
        rows, before = gauge.run(now, before, {"10s": 10, "1h": 3600})
        rows = rows.where("granularity = '1h'")
        out = rows if out is None else out.unionByName(rows)
    # a window that two batches touch has a row from each
    return out.groupBy(*gauge.KEYS, "window_us").agg(F.max("active_calls_max").alias("active_calls_max"), F.sum("active_calls_sum").alias("active_calls_sum"), F.sum("active_calls_samples").alias("active_calls_samples"))


@query(f"WITH {bridge.SPANS_SQL},\n{rollup_sql({'10s': 10, '1m': 60, '5m': 300, '1h': 3600}, 'count(e2e_latency_ms) AS e2e_count, coalesce(sum(e2e_latency_ms), 0.0::DOUBLE) AS e2e_sum, count(ttft_ms) AS ttft_count')} SELECT * EXCLUDE (source_id), source_id FROM rollup", ("e2e_sum",))
def rollup_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored rollups in all tiers, made from the finest rows."""
    rows = sketches.tiers(sketches.rollup(bridge.spans(spark, sf_dir)))
    sums = (*metrics.COUNTERS, "e2e_count", "e2e_sum", "ttft_count")
    # dealt out first, so that no task holds the rows of all tiers that it makes in a table of its own
    return rows.repartition(*metrics.KEYS).groupBy(*metrics.KEYS).agg(*(F.sum(c).alias(c) for c in sums))


_GRACE = tracker.GRACE_US
_LIVE_SQL = f"""c AS (SELECT *, lead(role) OVER w AS following, lead(turn) OVER w IS NULL AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT concat('src-', CAST(conv_id % 2 AS VARCHAR)) AS source_id, CAST(conv_id AS VARCHAR) AS session_id, role, conv_id * 3600000000 + turn * 1000000 AS request_us, conv_id * 3600000000 + turn * 1000000 + coalesce(length(text), 0) * 1000 AS end_us, role = 'assistant' AND (coalesce(following = 'user', false) OR last) AS ends FROM c),
clock AS (SELECT source_id, max(end_us) AS clock_us FROM k GROUP BY 1),
n AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY source_id, session_id ORDER BY request_us RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS turn_no FROM k WHERE role <> 'system'),
t AS (SELECT source_id, session_id, turn_no, count(*) AS call_count, min(request_us) AS start_us, max(end_us) AS end_us, bool_or(ends) AS ended, max(end_us) FILTER (ends) AS ended_us, bool_or(role = 'user') AS started FROM n GROUP BY 1, 2, 3),
g AS (SELECT t.*, bool_and(ended AND clock_us >= ended_us + {_GRACE}) OVER (PARTITION BY t.source_id, session_id ORDER BY turn_no ROWS UNBOUNDED PRECEDING) AS goes FROM t JOIN clock ON clock.source_id = t.source_id),
f AS (SELECT *, row_number() OVER (PARTITION BY source_id, session_id, goes ORDER BY turn_no) AS rn FROM g)"""


@query(f"WITH {_LIVE_SQL} SELECT concat(source_id, ':', session_id, ':', CAST(turn_no AS VARCHAR)) AS turn_id, start_us, end_us, call_count, CASE WHEN goes THEN 'complete' ELSE 'in_progress' END AS status, NOT goes AS in_progress FROM f WHERE started AND (goes OR rn = 1)")
def turns_under_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations that come in two batches: those given out by their sources' clocks, and those still under way."""
    store = Store(spark, shared.folder(spark, "turns_under_way"))
    calls = turns.conversation_calls(bridge.read(spark, sf_dir, "conversations"))
    for number, own in enumerate(("cast(split(id, '-')[1] as int) < 3", "cast(split(id, '-')[1] as int) >= 3")):
        tracker.step(calls.where(own), store, number, idle_us=1 << 60)
    going = tracker.snapshot(store).withColumn("in_progress", F.lit(True))
    names = ["turn_id", "start_us", "end_us", "call_count", "status", "in_progress"]
    return store.read("traces").withColumn("in_progress", F.lit(False)).select(*names).unionByName(going.select(*names))


@query("""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations)
SELECT conv_id, turn, CAST(octet_length(encode(role)) + octet_length(encode(text)) + 12 AS BIGINT) AS input_tokens, CAST(octet_length(encode(concat('why', CASE WHEN text = '' OR text = 'why' THEN '' ELSE chr(10) || text END))) AS BIGINT) AS output_tokens FROM c""")
def token_walkers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What counts of requests and answers, with a vocabulary of bytes: thoughts that are given twice count once."""
    rows = bridge.read(spark, sf_dir, "conversations").withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text")})
    asked = _struct(role=F.col("role"), content=F.col("text"))
    request = _json(model="m", messages=F.array(asked), tools=F.array(_struct(name=F.lit("f"))))
    answer = _json(choices=F.array(_struct(message=_struct(reasoning="why", content=F.concat(F.lit("<think>why</think>"), F.col("text"))))))
    own = rows.select("conv_id", "turn", tokens.estimates(F.lit("openai-chat"), request, answer, None).alias("e"))
    return own.select("conv_id", "turn", F.col("e.input").alias("input_tokens"), F.col("e.output").alias("output_tokens"))
