"""What a request's messages say: whether a user begins a turn, what was asked and what was answered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .agents import without_reminders
from .json_paths import stripped

_PARTS = "array<struct<type:string,text:string>>"


def _last(body: Column, path: str, skip_system: bool) -> Column:
    """The last message as JSON, system messages at the end left out if asked for."""
    items = F.from_json(F.get_json_object(body, path), "array<string>")
    own = F.filter(items, lambda m: F.coalesce(F.get_json_object(m, "$.role") != "system", F.lit(True))) if skip_system else items
    return F.try_element_at(own, F.lit(-1))


def _text(content: Column, kinds: tuple[str, ...]) -> Column:
    """A content that is a text, or the text parts of one that is a list, a line each; trimmed, null if blank."""
    parts = F.from_json(content, _PARTS)
    joined = F.array_join(F.transform(F.filter(parts, lambda p: p["type"].isin(*kinds)), lambda p: p["text"]), "\n")
    return F.nullif(stripped(F.when(F.ltrim(content).startswith("["), joined).otherwise(content)), F.lit(""))


def user_text(wire_api: Column, body: Column) -> Column:
    """What the user asks in the last message; null if it isn't a user's, or is only a tool's result."""
    anthropic, chat = _last(body, "$.messages", True), _last(body, "$.messages", False)
    item, plain = _last(body, "$.input", False), F.get_json_object(body, "$.input")
    by_role = lambda m: F.when(F.get_json_object(m, "$.role") == "user", F.get_json_object(m, "$.content"))
    responses = F.when(F.ltrim(plain).startswith("["), F.when(F.coalesce(F.get_json_object(item, "$.type"), F.lit("message")) == "message", _text(by_role(item), ("input_text", "text")))).otherwise(F.nullif(stripped(plain), F.lit("")))
    gemini = _last(body, "$.contents", False)
    parts = F.from_json(F.get_json_object(gemini, "$.parts"), "array<struct<text:string>>")
    asked = F.nullif(stripped(F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")), F.lit(""))
    return (
        F.when(wire_api == "anthropic", F.nullif(without_reminders(_text(by_role(anthropic), ("text",))), F.lit("")))
        .when(wire_api == "openai-chat", _text(by_role(chat), ("text",)))
        .when(wire_api == "openai-responses", responses)
        .when(wire_api == "gemini-aistudio", F.when(F.get_json_object(gemini, "$.role") == "user", asked))
    )


def first_user_text(wire_api: Column, body: Column) -> Column:
    """The text of the first message of a user."""
    of = lambda path, kinds: F.get(F.filter(F.transform(F.filter(F.from_json(F.get_json_object(body, path), "array<struct<role:string,content:string>>"), lambda m: m["role"] == "user"), lambda m: _text(m["content"], kinds)), lambda t: t.isNotNull()), F.lit(0))
    plain = F.get_json_object(body, "$.input")
    listed = F.ltrim(plain).startswith("[")
    parts = F.from_json(F.get_json_object(body, "$.contents"), "array<struct<role:string,parts:array<struct<text:string>>>>")
    asked = F.transform(F.filter(parts, lambda m: m["role"] == "user"), lambda m: F.nullif(stripped(F.array_join(F.transform(F.filter(m["parts"], lambda p: p["text"].isNotNull()), lambda p: p["text"]), "\n")), F.lit("")))
    return (
        F.when(wire_api.isin("anthropic", "openai-chat"), of("$.messages", ("text",)))
        .when(wire_api == "openai-responses", F.when(listed, of("$.input", ("input_text", "text"))).otherwise(F.nullif(stripped(plain), F.lit(""))))
        .when(wire_api == "gemini-aistudio", F.get(F.filter(asked, lambda t: t.isNotNull()), F.lit(0)))
    )


def is_user_turn_start(wire_api: Column, body: Column, agent: Column | None = None) -> Column:
    """Whether the last message is a user's own, not a tool's result; null where the request does not tell.

    An image, or any block of another type, counts as a text does. ``agent``: for `claude-cli`, reminders alone are no text; for `codex-cli`, any message of a user starts a turn.
    """
    claude = F.lit(False) if agent is None else F.coalesce(agent == "claude-cli", F.lit(False))
    codex = F.lit(False) if agent is None else F.coalesce(agent == "codex-cli", F.lit(False))
    seen = lambda t: F.coalesce(F.nullif(stripped(F.when(claude, without_reminders(t)).otherwise(t)), F.lit("")).isNotNull(), F.lit(False))
    last = _last(body, "$.messages", True)
    content = F.get_json_object(last, "$.content")
    shown = lambda b: F.when(b["type"].isNull() | (b["type"] == "tool_result"), False).when(b["type"] == "text", seen(F.coalesce(b["text"], F.lit("")))).otherwise(True)
    anthropic = F.when(F.get_json_object(last, "$.role") != "user", False).when(F.ltrim(content).startswith("["), F.exists(F.from_json(content, _PARTS), shown)).otherwise(F.when(content.isNotNull(), seen(content)))
    chat = _last(body, "$.messages", False)
    by_chat = F.when(chat.isNotNull(), F.coalesce((F.get_json_object(chat, "$.role") == "user") & _text(F.get_json_object(chat, "$.content"), ("text",)).isNotNull(), F.lit(False)))
    plain, item = F.get_json_object(body, "$.input"), _last(body, "$.input", False)
    kind, user = F.get_json_object(item, "$.type"), F.coalesce(F.get_json_object(item, "$.role") == "user", F.lit(False))
    by_item = F.when(codex, F.when(kind == "message", user).when(kind.isin("function_call_output", "reasoning", "function_call"), False)).otherwise(
        F.when(item.isNotNull(), F.coalesce(kind == "message", F.lit(False)) & user & _text(F.get_json_object(item, "$.content"), ("input_text", "text")).isNotNull())
    )
    responses = F.when(F.ltrim(plain).startswith("["), by_item).otherwise(F.when(plain.isNotNull() & ~codex, stripped(plain) != ""))
    gemini = _last(body, "$.contents", False)
    parts = F.from_json(F.get_json_object(gemini, "$.parts"), "array<struct<text:string,functionResponse:string,inlineData:string>>")
    by_part = F.exists(parts, lambda p: F.when(p["functionResponse"].isNotNull(), False).when(p["text"].isNotNull(), stripped(p["text"]) != "").otherwise(p["inlineData"].isNotNull()))
    return (
        F.when(wire_api == "anthropic", anthropic)
        .when(wire_api == "openai-chat", by_chat)
        .when(wire_api == "openai-responses", responses)
        .when(wire_api == "gemini-aistudio", F.when(F.get_json_object(gemini, "$.role") != "user", False).otherwise(by_part))
    )


def answer_text(wire_api: Column, body: Column) -> Column:
    """The text of a whole response."""
    outputs = F.from_json(F.get_json_object(body, "$.output"), f"array<struct<type:string,content:{_PARTS}>>")
    said = F.flatten(F.transform(F.filter(outputs, lambda o: o["type"] == "message"), lambda o: o["content"]))
    parts = F.from_json(F.get_json_object(body, "$.candidates[0].content.parts"), "array<struct<text:string>>")
    return (
        F.when(wire_api == "anthropic", _text(F.get_json_object(body, "$.content"), ("text",)))
        .when(wire_api == "openai-chat", _text(F.get_json_object(body, "$.choices[0].message.content"), ("text",)))
        .when(wire_api == "openai-responses", F.nullif(stripped(F.array_join(F.transform(F.filter(said, lambda p: p["type"] == "output_text"), lambda p: p["text"]), "\n")), F.lit("")))
        .when(wire_api == "gemini-aistudio", F.nullif(stripped(F.array_join(F.transform(F.filter(parts, lambda p: p["text"].isNotNull()), lambda p: p["text"]), "")), F.lit("")))
    )
