"""Turns of agents: calls of a session, cut at each terminal call, and what is asked of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a preview, and the mark of a cut one.
PREVIEW, MORE = 500, "…"


def preview(text: Column) -> Column:
    return F.when(F.char_length(text) > PREVIEW, F.concat(F.substring(text, 1, PREVIEW), F.lit(MORE))).otherwise(text)


def assemble(calls: DataFrame) -> DataFrame:
    """Traces from calls of agents.

    ``calls``: source_id, session_id, id, request_us, end_us, is_terminal, is_user_start, is_auxiliary, model, subagent, tool_surface,
    input_tokens, output_tokens, user_input, assistant_text, finish_reason. A turn is the calls up to and with a terminal one; its number is how
    many terminal calls the session has with a strictly earlier request. Turns without a user start are dropped, unless a main agent's call in them has a
    ``process`` (if there is such a column), which tells that the opening call was missed; auxiliary calls belong to none; the last turn
    without a terminal call is incomplete.
    """
    return build(numbered(calls.where(~F.col("is_auxiliary"))))


def numbered(calls: DataFrame) -> DataFrame:
    """Calls with turn_no, counted in each session."""
    earlier = Window.partitionBy("source_id", "session_id").orderBy("request_us").rangeBetween(Window.unboundedPreceding, -1)
    return calls.withColumn("turn_no", F.coalesce(F.sum(F.col("is_terminal").cast("int")).over(earlier), F.lit(0)))


def build(calls: DataFrame, status: str | None = None) -> DataFrame:
    """Traces from calls with their turn_no; ``status`` stands for all, else it is complete with a terminal call and incomplete without."""
    own, at = calls, F.struct("request_us", "id")
    started = F.max("is_user_start")
    if "process" in calls.columns:
        started = started | F.max(F.col("process").isNotNull() & F.col("subagent").isNull())
    # what only calls read from bodies have
    rank = F.max(F.when(F.col("agent_topology") == "orchestrator", 2).when(F.col("agent_topology") == "sub_agent", 1).when(F.col("agent_topology") == "single_agent", 0)) if "agent_topology" in calls.columns else None
    extra = {n: F.min_by(n, at).alias(n) for n in ("wire_api", "agent_kind", "client_ip", "server_ip") if n in calls.columns}
    extra |= {f"total_{n}": F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"total_{n}") for n in ("cache_read_input_tokens", "cache_creation_input_tokens") if n in calls.columns}
    extra |= {"agent_topology": F.get(F.array(F.lit("single_agent"), F.lit("sub_agent"), F.lit("orchestrator")), rank).alias("agent_topology")} if rank is not None else {}
    ordered = F.array_sort(F.collect_list(F.struct("request_us", "id", "model", "subagent")))
    turns = own.groupBy("source_id", "session_id", "turn_no").agg(
        F.min("request_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.count("*").alias("call_count"),
        ordered.alias("_calls"),
        F.array_sort(F.collect_set("tool_surface")).alias("tool_surfaces"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("long").alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("long").alias("total_output_tokens"),
        F.max("is_terminal").alias("_done"),
        started.alias("_started"),
        F.min_by(F.when(F.col("is_user_start"), F.struct("id", "user_input")), F.when(F.col("is_user_start"), at)).alias("_user"),
        F.max_by(F.struct("id", "assistant_text", "finish_reason"), at).alias("_final"),
        *(f for name, f in extra.items()),
    )
    names = F.array_distinct(F.filter(F.transform("_calls", lambda c: c["model"]), lambda m: m.isNotNull()))
    subagents = F.array_distinct(F.filter(F.transform("_calls", lambda c: c["subagent"]), lambda m: m.isNotNull()))
    return turns.where("_started").select(
        F.concat_ws(":", "source_id", "session_id", F.col("turn_no").cast("string")).alias("turn_id"),
        "source_id", "session_id", "start_us", "end_us",
        ((F.col("end_us") - F.col("start_us")) / 1000).cast("long").alias("duration_ms"),
        "call_count", names.alias("models_used"), subagents.alias("subagents_used"), F.transform("_calls", lambda c: c["id"]).alias("span_ids"), "tool_surfaces",
        "total_input_tokens", "total_output_tokens",
        (F.lit(status) if status else F.when(F.col("_done"), "complete").otherwise("incomplete")).alias("status"),
        F.col("_final.finish_reason").alias("final_finish_reason"),
        preview(F.col("_user.user_input")).alias("user_input_preview"), F.col("_user.id").alias("user_call_id"),
        preview(F.col("_final.assistant_text")).alias("final_answer_preview"), F.col("_final.id").alias("final_call_id"), *extra,
    )


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """Calls of agents from the conversations table: a row each, in turn order; an assistant row before a user row, or the last, is terminal."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    following = F.lead("role").over(w)
    last = F.lead("turn").over(w).isNull()
    own = conversations.withColumns({"_next": following, "_last": last})
    terminal = (F.col("role") == "assistant") & (F.coalesce(F.col("_next") == "user", F.lit(False)) | F.col("_last"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    return own.select(
        F.concat(F.lit("src-"), (F.col("conv_id") % 2).cast("string")).alias("source_id"),
        F.col("conv_id").cast("string").alias("session_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        (F.col("conv_id") * 3_600_000_000 + F.col("turn") * 1_000_000).alias("request_us"),
        (F.col("conv_id") * 3_600_000_000 + F.col("turn") * 1_000_000 + size * 1000).alias("end_us"),
        terminal.alias("is_terminal"),
        (F.col("role") == "user").alias("is_user_start"),
        (F.col("role") == "system").alias("is_auxiliary"),
        F.concat(F.lit("m"), ((F.col("conv_id") + F.col("turn")) % 3).cast("string")).alias("model"),
        F.when(F.col("turn") % 4 == 3, F.lit("helper")).alias("subagent"),
        F.when(F.col("turn") % 2 == 1, F.lit("cli")).when(F.col("turn") % 6 == 0, F.lit("mcp")).alias("tool_surface"),
        F.when(F.col("role") == "user", size).cast("long").alias("input_tokens"),
        F.when(F.col("role") == "assistant", size).cast("long").alias("output_tokens"),
        F.when(F.col("role") == "user", F.col("text")).alias("user_input"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("assistant_text"),
        F.when(F.col("role") == "assistant", F.when(terminal, "stop").otherwise("tool_calls")).alias("finish_reason"),
    )


def with_first_span_port(traces: DataFrame, spans: DataFrame, ports: Sequence[int]) -> DataFrame:
    """Traces whose first call went to one of the ports."""
    first = spans.where(F.col("server_port").isin(list(ports))).select(F.col("id").alias("_first"))
    return traces.join(first, F.get("span_ids", F.lit(0)) == F.col("_first"), "left_semi")


def summary_by(traces: DataFrame, key: str) -> DataFrame:
    return traces.groupBy(key).agg(
        F.count("*").alias("turn_count"), F.sum("call_count").cast("long").alias("call_count"), F.sum("total_input_tokens").cast("long").alias("input_tokens"),
        F.sum("total_output_tokens").cast("long").alias("output_tokens"), F.avg("duration_ms").alias("avg_duration_ms"), F.max("duration_ms").alias("max_duration_ms"),
    )


def auto_bucket(window_s: int) -> int:
    """Seconds of a bucket, for about 120 of them."""
    want = max(window_s / 120, 60)
    return next((b for b in (60, 300, 600, 1800, 3600, 7200, 14400, 86400) if b >= want), 86400)


def activity(traces: DataFrame, key: str, bucket_s: int) -> DataFrame:
    """Turns begun by bucket. Buckets start at 2000-01-03, as SQL's time_bucket has them."""
    size, origin = bucket_s * 1_000_000, 946_857_600_000_000
    return traces.groupBy((F.col("start_us") - F.pmod(F.col("start_us") - origin, F.lit(size))).alias("bucket_us"), key).agg(F.count("*").alias("turn_count"))


def sessions(traces: DataFrame) -> DataFrame:
    """Sessions over their whole life, with the preview of their first turn."""
    return traces.groupBy("source_id", "session_id").agg(
        F.min("start_us").alias("first_turn_us"), F.max("start_us").alias("last_turn_us"), F.count("*").alias("turn_count"),
        F.sum("call_count").cast("long").alias("call_count"), F.sum("total_input_tokens").cast("long").alias("input_tokens"), F.sum("total_output_tokens").cast("long").alias("output_tokens"),
        F.min_by("user_input_preview", F.struct("start_us", "turn_id")).alias("first_preview"),
    )


def full_texts(traces: DataFrame, spans: DataFrame) -> DataFrame:
    """turn_id, user_input and final_answer in full: a preview that was cut is looked up in the call that it is from, any other is whole already.

    ``spans``: id, user_input, assistant_text. A cut preview whose call is no longer there stays as it is.
    """
    cut = lambda c: F.coalesce(F.col(c).endswith(MORE) & (F.char_length(c) > PREVIEW), F.lit(False))
    out = traces.select("turn_id", "user_input_preview", "final_answer_preview", F.when(cut("user_input_preview"), F.col("user_call_id")).alias("_asked"), F.when(cut("final_answer_preview"), F.col("final_call_id")).alias("_said"))
    wanted = out.select(F.explode(F.filter(F.array("_asked", "_said"), lambda x: x.isNotNull())).alias("id")).distinct()
    # only calls that are asked for bring their texts
    texts = spans.join(wanted, "id", "left_semi").groupBy("id").agg(F.max("user_input").alias("user_input"), F.max("assistant_text").alias("assistant_text"))
    asked, said = texts.select(F.col("id").alias("_asked"), "user_input"), texts.select(F.col("id").alias("_said"), "assistant_text")
    both = out.join(asked, "_asked", "left").join(said, "_said", "left")
    return both.select("turn_id", F.coalesce("user_input", "user_input_preview").alias("user_input"), F.coalesce("assistant_text", "final_answer_preview").alias("final_answer"))


def under_way(snapshot: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Turns under way that overlap a range, both ends with it; written turns are asked for by their start alone."""
    return snapshot.where((F.col("end_us") >= start_us) & (F.col("start_us") <= end_us))


def union_in_progress(persisted: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Turns under way before those written, each newest first; sort by in_progress desc, start_us desc, turn_id."""
    return snapshot.withColumn("in_progress", F.lit(True)).unionByName(persisted.withColumn("in_progress", F.lit(False)), allowMissingColumns=True)
