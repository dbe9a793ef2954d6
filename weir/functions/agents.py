"""Agents behind requests: whose they are, which tools they called, how they work together, which session they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .json_paths import header, is_list, stripped

ANTHROPIC, CHAT, RESPONSES, GEMINI = "anthropic", "openai-chat", "openai-responses", "gemini-aistudio"
#: Names, prefixes and headers by which agents and their tools are known.
CLI_TOOLS = ("bash", "shell", "exec", "run_command", "ShellExec")
MCP_PREFIX = "mcp__"
CLAUDE_AGENT, CLAUDE_SESSION = "claude-cli/", "x-claude-code-session-id"
CODEX_AGENTS, CODEX_META, CODEX_SUBAGENT = ("codex_cli_rs", "codex-tui", "codex_exec"), "x-codex-turn-metadata", "x-openai-subagent"
OPENCODE_AGENT, OPENCODE_SESSION = "opencode/", "x-session-affinity"
OPENCLAW_TOOLS = ("sessions_spawn", "sessions_yield", "subagents", "sessions_list", "sessions_history", "sessions_send", "session_status")
OPENCLAW_SUMMARY = "You are a context summarization assistant."
HERMES_TOOLS = ("skill_view", "skill_manage", "skills_list", "delegate_task", "session_search", "cronjob")
SECURITY_MONITOR = "You are a security monitor for autonomous AI coding agents"
LOOP_MARKS, MCP_MARKS = ("you are an agent", "you are claude code"), ("mcp server", "mcp tool")

_NAMES = "array<string>"
_MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,function:struct<name:string>>>>>"
_BLOCKS = "array<struct<type:string,name:string,id:string,text:string>>"
_ITEMS = "array<struct<type:string,role:string,name:string,call_id:string,content:string>>"


def _none(kind: str = _NAMES) -> Column:
    return F.array().cast(kind)


def _messages(body: Column) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(body, "$.messages"), _MESSAGES), _none(_MESSAGES))


def _items(body: Column) -> Column:
    return F.when(is_list(body, "$.input"), F.from_json(F.get_json_object(body, "$.input"), _ITEMS)).otherwise(_none(_ITEMS))


def _blocks(content: Column) -> Column:
    """The blocks of a content that is a list; none of one that is a text."""
    return F.when(F.ltrim(content).startswith("["), F.coalesce(F.from_json(content, _BLOCKS), _none(_BLOCKS))).otherwise(_none(_BLOCKS))


def offered_tools(body: Column, flat: bool = True, nested: bool = True) -> Column:
    """The distinct names of the tools that a request offers, in order: ``flat`` ones, and those ``nested`` in a function, which count first."""
    tools = F.from_json(F.get_json_object(body, "$.tools"), "array<struct<name:string,function:struct<name:string>>>")
    name = lambda t: F.coalesce(*([t["function"]["name"]] if nested else []), *([t["name"]] if flat else []))
    return F.when(is_list(body, "$.tools"), F.array_distinct(F.filter(F.transform(tools, name), lambda n: n.isNotNull()))).otherwise(_none())


def _hits(names: Column, marks: tuple[str, ...]) -> Column:
    return F.size(F.array_intersect(names, F.array(*map(F.lit, marks))))


def system_text(wire_api: Column, body: Column) -> Column:
    """The first system text of a request."""
    raw = F.get_json_object(body, "$.system")
    blocks = F.transform(F.filter(_blocks(raw), lambda b: b["text"].isNotNull()), lambda b: b["text"])
    chat = F.get(F.filter(_messages(body), lambda m: m["role"].isin("system", "developer")), F.lit(0))["content"]
    return (
        F.when(wire_api == ANTHROPIC, F.when(F.ltrim(raw).startswith("["), F.get(blocks, F.lit(0))).otherwise(raw))
        .when(wire_api == CHAT, chat)
        .when(wire_api == RESPONSES, F.get_json_object(body, "$.instructions"))
    )


def tool_anchor(wire_api: Column, request: Column, response: Column) -> Column:
    """The id of the first tool call of the first assistant message, in the request, or, if that has no assistant message, in the response."""
    first = F.get(F.filter(_messages(request), lambda m: m["role"] == "assistant"), F.lit(0))
    used = lambda blocks: F.get(F.filter(blocks, lambda b: (b["type"] == "tool_use") & b["id"].isNotNull()), F.lit(0))["id"]
    anthropic = F.when(first.isNotNull(), used(_blocks(first["content"]))).otherwise(used(_blocks(F.get_json_object(response, "$.content"))))
    chat = F.when(first.isNotNull(), F.get(first["tool_calls"], F.lit(0))["id"]).otherwise(F.get_json_object(response, "$.choices[0].message.tool_calls[0].id"))
    called = lambda items: F.get(F.filter(items, lambda i: (i["type"] == "function_call") & i["call_id"].isNotNull()), F.lit(0))["call_id"]
    outputs = F.coalesce(F.from_json(F.get_json_object(response, "$.output"), _ITEMS), _none(_ITEMS))
    return F.when(wire_api == ANTHROPIC, anthropic).when(wire_api == CHAT, chat).when(wire_api == RESPONSES, F.coalesce(called(_items(request)), called(outputs)))


def profile(wire_api: Column, headers: Column, body: Column, anchor: Column, user: Column) -> Column:
    """The agent that sent a request, the first that fits; null if none does.

    ``anchor``: ``tool_anchor``; ``user``: the first text of a user. A call with both, and no other sign, is of a `generic` agent.
    """
    agent = F.coalesce(header(headers, "user-agent"), F.lit(""))
    anchored = anchor.isNotNull() & user.isNotNull()
    offered = offered_tools(body)
    known = wire_api.isin(ANTHROPIC, CHAT, RESPONSES) & F.try_parse_json(body).isNotNull()
    codex = F.coalesce(header(headers, "originator").isin(*CODEX_AGENTS), F.lit(False)) | F.substring_index(agent, "/", 1).isin(*CODEX_AGENTS) & agent.contains("/")
    summary = (F.size(offered) == 0) & F.coalesce(system_text(wire_api, body).startswith(OPENCLAW_SUMMARY), F.lit(False))
    return (
        F.when((wire_api == ANTHROPIC) & agent.startswith(CLAUDE_AGENT) & (header(headers, CLAUDE_SESSION).isNotNull() | anchored), "claude-cli")
        .when((wire_api == RESPONSES) & codex & header(headers, CODEX_META).isNotNull(), "codex-cli")
        .when((wire_api == CHAT) & agent.startswith(OPENCODE_AGENT) & header(headers, OPENCODE_SESSION).isNotNull(), "opencode")
        .when(known & ((_hits(offered, OPENCLAW_TOOLS) >= 2) | summary), "openclaw")
        .when(known & (_hits(offered, HERMES_TOOLS) >= 2), "hermes")
        .when(anchored, "generic")
    )


def subagent(agent: Column, headers: Column, body: Column) -> Column:
    """The mark of a call by a sub-agent: tools without one to start agents, or a header; null for others."""
    names = offered_tools(body, nested=False)
    return F.when((agent == "claude-cli") & (F.size(names) > 0) & ~F.array_contains(names, "Agent"), "task").when(agent == "codex-cli", header(headers, CODEX_SUBAGENT))


def is_auxiliary(agent: Column, body: Column) -> Column:
    """Calls beside a conversation, which belong to no turn: with an empty list of tools, or of a monitor."""
    system = F.get_json_object(body, "$.system")
    texts = F.transform(_blocks(system), lambda b: b["text"])
    monitor = F.when(F.ltrim(system).startswith("["), F.coalesce(F.exists(texts, lambda t: t.contains(SECURITY_MONITOR)), F.lit(False))).otherwise(F.coalesce(system.contains(SECURITY_MONITOR), F.lit(False)))
    flat = is_list(body, "$.tools") & (F.size(offered_tools(body, nested=False)) == 0)
    any_ = F.size(offered_tools(body)) == 0
    missing = F.get_json_object(body, "$.tools").isNull()
    return F.coalesce(F.when(agent == "claude-cli", monitor | flat).when(agent == "openclaw", any_ & (missing | is_list(body, "$.tools"))), F.lit(False))


def primitives(agent: Column, headers: Column, body: Column) -> Column:
    """What a request shows of an agent: tool_call_count, tool_names (distinct, in order), loop and mcp (marks of its system prompt), dispatches."""
    messages, items = _messages(body), _items(body)
    used = F.filter(F.flatten(F.transform(messages, lambda m: _blocks(m["content"]))), lambda b: b["type"] == "tool_use")
    calls = F.flatten(F.transform(messages, lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,function:struct<name:string>>>"))))
    asked = F.filter(items, lambda i: i["type"] == "function_call")
    by_use, by_call, by_item = F.transform(used, lambda b: b["name"]), F.transform(calls, lambda c: c["function"]["name"]), F.transform(asked, lambda i: i["name"])
    # which of these an agent's requests show
    blocks = agent.isin("claude-cli", "openclaw", "generic")
    chats = agent.isin("opencode", "openclaw", "hermes", "generic")
    listed = agent.isin("codex-cli", "openclaw", "generic")
    offers = F.when(agent == "opencode", offered_tools(body, flat=False)).when(agent.isin("openclaw", "hermes"), offered_tools(body)).otherwise(_none())
    called = F.concat(F.when(blocks, by_use).otherwise(_none()), F.when(chats, by_call).otherwise(_none()), F.when(listed, by_item).otherwise(_none()))
    names = F.array_distinct(F.filter(F.concat(offers, called), lambda n: n.isNotNull()))
    raw = F.get_json_object(body, "$.system")
    joined = F.array_join(F.transform(F.filter(_blocks(raw), lambda b: b["text"].isNotNull()), lambda b: b["text"]), " ")
    plain = F.when(~F.ltrim(raw).startswith("["), raw)
    said = F.transform(F.filter(messages, lambda m: (m["role"] == "system") & ~F.ltrim(m["content"]).startswith("[")), lambda m: m["content"])
    told = F.transform(F.filter(items, lambda i: i["role"].isin("developer", "system")), lambda i: F.when(F.ltrim(i["content"]).startswith("["), F.array_join(F.transform(_blocks(i["content"]), lambda b: b["text"]), " ")).otherwise(i["content"]))
    prompts = F.lower(F.concat_ws("\n", F.when(agent.isin("claude-cli", "generic"), plain).when(agent == "openclaw", F.coalesce(F.nullif(joined, F.lit("")), plain)), F.when(agent.isin("opencode", "hermes", "generic"), F.array_join(said, "\n")), F.when(agent == "codex-cli", F.array_join(told, "\n"))))
    some = lambda marks: F.coalesce(F.array_max(F.array(*(prompts.contains(m) for m in marks))), F.lit(False))
    return F.struct(
        F.size(called).alias("tool_call_count"), names.alias("tool_names"), some(LOOP_MARKS).alias("loop"), (some(MCP_MARKS) & (agent != "hermes")).alias("mcp"),
        ((agent == "claude-cli") & F.array_contains(by_use, "Task")).alias("dispatches"),
    )


def is_agent_request(found: Column, mark: Column) -> Column:
    """``found``: ``primitives``; ``mark``: ``subagent``."""
    return F.coalesce((found["tool_call_count"] > 0) | mark.isNotNull() | found["loop"], F.lit(False))


def tool_surface(found: Column) -> Column:
    """How tools are reached, if any was called: mcp, cli or function_call, mixed if in several ways, unknown if none has a name."""
    names = found["tool_names"]
    mcp = found["mcp"] | F.exists(names, lambda n: n.startswith(MCP_PREFIX))
    cli = F.exists(names, lambda n: n.isin(*CLI_TOOLS))
    other = F.exists(names, lambda n: ~n.startswith(MCP_PREFIX) & ~n.isin(*CLI_TOOLS))
    ways = mcp.cast("int") + cli.cast("int") + other.cast("int")
    return F.when(found["tool_call_count"] > 0, F.when(ways == 0, "unknown").when(ways > 1, "mixed").when(mcp, "mcp").when(cli, "cli").otherwise("function_call"))


def topology(found: Column, mark: Column) -> Column:
    """How an agent works with others; null for requests of none."""
    return F.when(is_agent_request(found, mark), F.when(mark.isNotNull(), "sub_agent").when(found["dispatches"], "orchestrator").otherwise("single_agent"))


def canonical_tool_id(raw: Column) -> Column:
    """Ids that lost the underscore after their kind get it back."""
    return F.regexp_replace(raw, r"^(call|toolu|fc|chatcmpl)(?!_)(.+)", "$1_$2")


def without_reminders(text: Column) -> Column:
    return stripped(F.regexp_replace(text, r"(?s)<system-reminder>.*?(</system-reminder>|$)", ""))


def fnv1a(text: Column) -> Column:
    """The 64-bit FNV-1a hash of a text in hexadecimal, by whole-number steps of two 32-bit halves, as no step may overflow."""
    data = F.transform(F.sequence(F.lit(1), F.octet_length(text)), lambda k: F.conv(F.hex(F.substring(text.cast("binary"), k, F.lit(1))), 16, 10).cast("long"))
    data = F.when(F.octet_length(text) > 0, data).otherwise(F.array().cast("array<bigint>"))

    def step(h: Column, b: Column) -> Column:
        low = h["low"].bitwiseXOR(b)
        # the prime is 2^40 + 0x1b3
        product = low * 0x1B3
        high = h["high"] * 0x1B3 + F.shiftright(product, 32) + F.shiftleft(low, 8)
        return F.struct(high.bitwiseAND(0xFFFFFFFF).alias("high"), product.bitwiseAND(0xFFFFFFFF).alias("low"))

    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("high"), F.lit(0x84222325).cast("long").alias("low"))
    return F.aggregate(data, start, step, lambda h: F.lower(F.concat(F.lpad(F.hex(h["high"]), 8, "0"), F.lpad(F.hex(h["low"]), 8, "0"))))


def session_id(agent: Column, headers: Column, anchor: Column, user: Column, answer: Column) -> Column:
    """By agent: from a session header or a turn's metadata, else the first tool id, or, for agents known by their tools, the hash of the first texts."""
    anchored = F.when(anchor.isNotNull() & user.isNotNull(), canonical_tool_id(anchor))
    hashed = F.when(user.isNotNull() & answer.isNotNull(), F.concat(F.lit("gen-"), fnv1a(F.concat(user, F.lit("\n"), answer))))
    return (
        F.when(agent == "claude-cli", F.coalesce(header(headers, CLAUDE_SESSION), anchored))
        .when(agent == "codex-cli", F.get_json_object(header(headers, CODEX_META), "$.session_id"))
        .when(agent == "opencode", header(headers, OPENCODE_SESSION))
        .when(agent.isin("openclaw", "hermes"), F.coalesce(anchored, hashed))
        .when(agent == "generic", anchored)
    )


def tool_index(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Each tool id of a turn with the call that asks for it and the one that brings its result, either of which may be missing; the first of each counts.

    Both sides: turn_id, tool_id, call_id, sequence.
    """

    def first(side: DataFrame, name: str) -> DataFrame:
        own = side.withColumn("tool_id", canonical_tool_id(F.col("tool_id")))
        return own.groupBy("turn_id", "tool_id").agg(F.min_by("call_id", "sequence").alias(name))

    return first(uses, "origin").join(first(results, "resolution"), ["turn_id", "tool_id"], "full_outer")


def fold_calls(calls: DataFrame, within_us: int = 100_000) -> DataFrame:
    """One call of each group that carries the same content within ``within_us`` over different connections: the longest, then the first."""
    from pyspark.sql import Window

    by = Window.partitionBy("turn_id", "content").orderBy("start_us", "call_id")
    gap = F.when(F.col("start_us") - F.lag("start_us").over(by) > within_us, 1).otherwise(0)
    own = calls.withColumn("_gap", gap).withColumn("_group", F.sum("_gap").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy("turn_id", "content", "_group", "connection").orderBy("start_us", "call_id")))
    best = Window.partitionBy("turn_id", "content", "_group").orderBy((F.col("end_us") - F.col("start_us")).desc(), "start_us", "call_id")
    # calls of one connection never are copies of each other
    return ranked.withColumn("_best", F.row_number().over(best)).where("_best = 1 or _rank > 1").drop("_gap", "_group", "_rank", "_best")
