"""Training trajectories from the bodies of a turn's last call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED = ("anthropic", "openai-chat")

_CALLS = "array<struct<id:string,name:string,arguments:string>>"
_MESSAGES = f"array<struct<role:string,content:string,reasoning:string,tool_call_id:string,tool_calls:{_CALLS}>>"
_BLOCKS = "array<struct<type:string,text:string,thinking:string,id:string,name:string,input:string,tool_use_id:string,content:string>>"


def arguments(raw: Column) -> Column:
    """A tool call's arguments as they are if they are a JSON object, else {}."""
    return F.when(F.try_parse_json(raw).isNotNull() & F.ltrim(raw).startswith("{"), raw).otherwise("{}")


def _message(role: Column, content: Column, reasoning: Column | None = None, tool_call_id: Column | None = None, calls: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        role.alias("role"), content.alias("content"), (none if reasoning is None else reasoning).alias("reasoning"), (none if tool_call_id is None else tool_call_id).alias("tool_call_id"),
        F.coalesce(F.lit(None).cast(_CALLS) if calls is None else calls, F.array().cast(_CALLS)).alias("tool_calls"),
    )


def _said(blocks: Column, kind: str, field: str) -> Column:
    """The texts of the blocks of a kind, a line each; null if there are none."""
    own = F.transform(F.filter(blocks, lambda b: (b["type"] == kind) & b[field].isNotNull()), lambda b: b[field])
    return F.nullif(F.array_join(own, "\n"), F.lit(""))


def _plain(content: Column) -> Column:
    """A content that is a text, or the text blocks of one that is a list."""
    return F.when(F.ltrim(content).startswith("["), _said(F.from_json(content, _BLOCKS), "text", "text")).otherwise(content)


def _assistant(content: Column) -> Column:
    """One message from an assistant's content: its text, its thoughts and its tool calls."""
    blocks = F.when(F.ltrim(content).startswith("["), F.from_json(content, _BLOCKS))
    calls = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), arguments(b["input"]).alias("arguments")))
    return _message(F.lit("assistant"), _plain(content), _said(blocks, "thinking", "thinking"), None, calls)


def anthropic_messages(request: Column, response: Column) -> Column:
    """The system text, the messages (each tool result of a user's one is a message of its own, before the text), and the answer."""
    system = _plain(F.get_json_object(request, "$.system"))
    asked = F.from_json(F.get_json_object(request, "$.messages"), "array<struct<role:string,content:string>>")
    none = F.array().cast(_MESSAGES)

    def one(m: Column) -> Column:
        blocks = F.when(F.ltrim(m["content"]).startswith("["), F.from_json(m["content"], _BLOCKS))
        results = F.transform(F.filter(blocks, lambda b: b["type"] == "tool_result"), lambda b: _message(F.lit("tool"), _plain(b["content"]), None, b["tool_use_id"]))
        text = _plain(m["content"])
        user = F.concat(F.coalesce(results, none), F.when(text.isNotNull(), F.array(_message(m["role"], text))).otherwise(none))
        return F.when(m["role"] == "assistant", F.array(_assistant(m["content"]))).otherwise(user)

    answer = F.get_json_object(response, "$.content")
    return F.concat(F.when(F.length(system) > 0, F.array(_message(F.lit("system"), system))).otherwise(none), F.flatten(F.transform(asked, one)), F.when(answer.isNotNull(), F.array(_assistant(answer))).otherwise(none))


def chat_messages(request: Column, response: Column) -> Column:
    """The messages of a chat request, and the answer."""
    one = "struct<role:string,content:string,reasoning_content:string,tool_call_id:string,tool_calls:array<struct<id:string,function:struct<name:string,arguments:string>>>>"
    call = lambda c: F.struct(c["id"].alias("id"), c["function"]["name"].alias("name"), arguments(c["function"]["arguments"]).alias("arguments"))
    messages = F.from_json(F.get_json_object(request, "$.messages"), f"array<{one}>")
    answer = F.from_json(F.get_json_object(response, "$.choices[0].message"), one)
    every = F.concat(messages, F.when(answer.isNotNull(), F.array(answer)).otherwise(F.array().cast(f"array<{one}>")))
    return F.transform(every, lambda m: _message(F.coalesce(m["role"], F.lit("assistant")), m["content"], m["reasoning_content"], m["tool_call_id"], F.transform(m["tool_calls"], call)))


def export(rows: DataFrame) -> DataFrame:
    """One JSON line for each turn of a supported wire API: messages, the tools offered and _meta; turns without messages are left out.

    ``rows``: turn_id, wire_api, request_body and, if there is one, response_body.
    """
    own = rows.where(F.col("wire_api").isin(*SUPPORTED))
    answer = F.col("response_body") if "response_body" in rows.columns else F.lit(None).cast("string")
    messages = F.when(F.col("wire_api") == "anthropic", anthropic_messages(F.col("request_body"), answer)).otherwise(chat_messages(F.col("request_body"), answer))
    tools = F.from_json(F.get_json_object("request_body", "$.tools"), "array<string>")
    own = own.select("turn_id", "wire_api", messages.alias("messages"), tools.alias("tools")).where("messages is not null")
    return own.select("turn_id", F.to_json(F.struct("messages", "tools", F.struct("turn_id", "wire_api").alias("_meta"))).alias("line"))
