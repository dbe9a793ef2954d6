"""Token estimates of calls that name no counts: byte-pair merges by rank over what a request and its answer say.

A vocabulary is a file of ranks (a token in base 64 and its rank, a line each), whose path is a parameter; every executor must have it. Texts are cut into words by the vocabulary's published
pattern, and in a word the pair of neighbours with the lowest rank is merged until none has one. A request counts text by text: roles, contents,
calls and tools as JSON. Of an answer all distinct pieces count once, so thoughts that are given twice, or stand in the
content between think tags and in a field of their own, are no double work.
"""

import base64
import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the published pattern that cuts words for the vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_THOUGHT = re.compile(r"<think>(.*?)</think>", re.S)
#: Words whose counts are kept, and the longest of them in bytes.
_KEPT, _LONGEST = 200_000, 64


class Ranks:
    """A vocabulary by ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        self.ranks, self.cut, self.known = ranks, regex.compile(pattern), {}

    def _merged(self, word: bytes) -> int:
        """Tokens of a word: the lowest-ranked pair, the leftmost of equals, is merged again and again; pairs wait in a heap."""
        if word in self.ranks:
            return 1
        end = list(range(1, len(word) + 1))  # of the piece that starts here
        before = list(range(-1, len(word) - 1))
        alive, pieces = [True] * len(word), len(word)
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < len(word):
                to = end[end[at]]
                if (r := self.ranks.get(word[at:to])) is not None:
                    heapq.heappush(heap, (r, at, to))

        for k in range(len(word)):
            offer(k)
        while heap:
            _, at, to = heapq.heappop(heap)
            if not alive[at] or end[at] >= len(word) or end[end[at]] != to:
                continue  # one of the two has been merged since
            alive[end[at]] = False
            end[at] = to
            if to < len(word):
                before[to] = at
            pieces -= 1
            offer(at)
            offer(before[at])
        return pieces

    def count(self, text: str) -> int:
        total = 0
        for word in self.cut.findall(text):
            if (n := self.known.get(word)) is None:
                raw = word.encode("utf-8", "surrogatepass")
                n = self._merged(raw)
                if len(raw) <= _LONGEST:
                    if len(self.known) >= _KEPT:
                        self.known.clear()
                    self.known[word] = n
            total += n
        return total


@lru_cache(maxsize=2)
def load(path: str, pattern: str = PATTERN) -> Ranks:
    """One per worker process and vocabulary."""
    with open(path, "rb") as f:
        return Ranks({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}, pattern)


def _json(x: object) -> str:
    return json.dumps(x, ensure_ascii=False, separators=(",", ":"))


def _items(x: object) -> list[dict]:
    return [i for i in x if isinstance(i, dict)] if isinstance(x, list) else []


def _own(x: object, *fields: str) -> Iterator[str]:
    """The texts of some fields."""
    yield from (x[f] for f in fields if isinstance(x, dict) and isinstance(x.get(f), str))


def _content(x: object, *fields: str) -> Iterator[str]:
    """A content that is a text, or a list of parts with texts."""
    if isinstance(x, str):
        yield x
    for part in _items(x):
        yield from _own(part, *fields)


def _offered(request: dict) -> Iterator[str]:
    yield from map(_json, request["tools"] if isinstance(request.get("tools"), list) else [])
    if request.get("tool_choice") is not None:
        yield _json(request["tool_choice"])


def _asked_anthropic(request: dict) -> Iterator[str]:
    yield from _content(request.get("system"), "text")
    for m in _items(request.get("messages")):
        yield from _own(m, "role", "content")
        for block in _items(m.get("content")):
            kind = block.get("type")
            yield from [_json(block)] if kind in ("tool_use", "tool_result") else _own(block, kind) if kind in ("text", "thinking") else ()
    yield from _offered(request)


def _asked_chat(request: dict) -> Iterator[str]:
    for m in _items(request.get("messages")):
        yield from _own(m, "role")
        yield from _content(m.get("content"), "text")
        yield from map(_json, _items(m.get("tool_calls")))
    yield from _offered(request)


def _asked_responses(request: dict) -> Iterator[str]:
    yield from _own(request, "instructions")
    for item in _items(request.get("input")):
        yield from _own(item, "role", "output")
        yield from _content(item.get("content"), "text")
        if item.get("type") == "function_call":
            yield _json(item)
    yield from _offered(request)


def _apart(text: str) -> Iterator[str]:
    """Thoughts between tags, then the text without them."""
    yield from _THOUGHT.findall(text)
    yield _THOUGHT.sub("", text)


def _said_anthropic(answer: dict) -> Iterator[str]:
    for block in _items(answer.get("content")):
        yield from _own(block, "thinking") if block.get("type") == "thinking" else [_json(block)] if block.get("type") == "tool_use" else (x for t in _own(block, "text") for x in _apart(t))


def _said_chat(answer: dict) -> Iterator[str]:
    for choice in _items(answer.get("choices"))[:1]:
        m = choice.get("message") if isinstance(choice.get("message"), dict) else {}
        yield from _own(m, "reasoning_content", "reasoning")
        yield from (x for t in _content(m.get("content"), "text") for x in _apart(t))
        yield from map(_json, _items(m.get("tool_calls")))


def _said_responses(answer: dict) -> Iterator[str]:
    for item in _items(answer.get("output")):
        yield from _content(item.get("summary"), "text")
        yield from (x for t in _content(item.get("content"), "text") for x in _apart(t))
        if str(item.get("type", "")).endswith("_call"):
            yield _json(item)


_ASKED: dict[str, Callable[[dict], Iterator[str]]] = {"anthropic": _asked_anthropic, "openai-chat": _asked_chat, "openai-responses": _asked_responses}
_SAID: dict[str, Callable[[dict], Iterator[str]]] = {"anthropic": _said_anthropic, "openai-chat": _said_chat, "openai-responses": _said_responses}


def _object(text: object) -> dict:
    try:
        own = json.loads(text) if isinstance(text, str) else None
    except ValueError:
        own = None
    return own if isinstance(own, dict) else {}


def counts(ranks: Ranks, wire_api: str, request: object, answer: object) -> tuple[int, int]:
    """Tokens of a request, text by text, and of an answer's distinct pieces."""
    asked = sum(map(ranks.count, _ASKED[wire_api](_object(request))))
    return asked, ranks.count("\n".join(dict.fromkeys(x for x in _SAID[wire_api](_object(answer)) if x)))


def estimates(wire_api: Column, request: Column, answer: Column, path: str | None, pattern: str = PATTERN) -> Column:
    """input and output tokens of a call; null where its API has no walker. Without a path every byte is a token."""

    def estimated(apis: pd.Series, requests: pd.Series, answers: pd.Series) -> pd.DataFrame:
        ranks = load(path, pattern) if path else Ranks({bytes([k]): k for k in range(256)})
        rows = [counts(ranks, a, q, r) if a in _ASKED else (None, None) for a, q, r in zip(apis, requests, answers)]
        return pd.DataFrame({n: pd.Series([r[k] for r in rows], dtype="Int64") for k, n in enumerate(("input", "output"))})

    return F.pandas_udf(estimated, "input long, output long")(wire_api, request, answer)


def backfill(spans: DataFrame, path: str | None, limit: int | None = None, dry_run: bool = False, pattern: str = PATTERN) -> DataFrame:
    """Spans with estimates where an answer of status 2xx names no counts; doing it again changes nothing.

    ``limit``: at most so many spans, by id, are changed. ``dry_run``: only the id, and the input and output that would be put in, of those.
    """
    zero = lambda c: F.coalesce(c, F.lit(0)) == 0
    bare = F.col("status_code").between(200, 299) & zero("input_tokens") & zero("output_tokens") & F.col("response_body").isNotNull() & F.col("wire_api").isin(*_ASKED)
    due = spans.where(bare)
    due = due.orderBy("id").limit(limit) if limit is not None else due
    # bodies of spans that have counts are not read
    found = due.select("id", estimates(*map(F.col, ("wire_api", "request_body", "response_body")), path, pattern).alias("e")).select("id", F.col("e.input").alias("_in"), F.col("e.output").alias("_out"))
    if dry_run:
        return found.select("id", F.col("_in").alias("input_tokens"), F.col("_out").alias("output_tokens"))
    both = spans.join(found, "id", "left")
    return both.withColumns({"input_tokens": F.coalesce("_in", "input_tokens"), "output_tokens": F.coalesce("_out", "output_tokens")}).select(*spans.columns)
