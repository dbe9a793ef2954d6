r"""Conversations as text for training, with a mask of what the loss counts, checked by reading the text again.

A turn is written as ``### role: text</turn>`` and a line feed. ``parse`` reads such text with a deterministic grammar, one token after
another: `###` opens a turn and `</turn>` closes it, a backslash before one of the characters in ``_ESCAPED`` takes the next character as it is, and
anything else is text; a control string where the grammar has none is an error.

**Round trip.** A turn is written at the first of three levels that the parser reads back as exactly the role and text it was made from: as it is; with a
backslash before each control string and doubled backslashes; with a backslash before each character that could belong to one. The last level always
holds. The parser ends a turn in the state in which it began, so a conversation is read back right if its turns are; ``read_back`` does
read whole conversations, from the written rows.

**Whole conversations.** Turns are formatted where they lie, then dealt by conversation and sorted by turn on disk. They are written on as chunks of about ``CHUNK`` code
points, whole turns each, with the loss mask as spans in the chunk; most conversations are one chunk. A task goes through a conversation
of any length a batch at a time and holds one chunk. Digests of a conversation run over its turns in order, so one conversation is one
task's work, though never its memory.

Null texts and roles are empty ones. Turns go by number, null first; turns of one number as they are written, and repeated rows count each.
Rows with a null conversation belong to one of null. Role `assistant`, in just these letters, counts for the loss. No rows give no rows.
Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import slices

#: The grammar's words.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
#: Code points of a chunk, about; one turn may have more.
CHUNK = 1 << 20
_ESCAPED = r"\\#<:"
_TOKEN = re.compile(rf"\\[{_ESCAPED}]|###|</turn>")
_ESCAPE = re.compile(rf"\\([{_ESCAPED}])")
_LEVELS = (None, re.compile(r"###|</turn>|\\"), re.compile(rf"[{_ESCAPED}]"))
_ROLE_END = re.compile(rf"(?:\\[{_ESCAPED}]|[^\\:])*")


class Conflict(ValueError):
    """Text that the grammar does not take."""


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def parse(text: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and where the text begins and ends, of each turn of a formatted text."""
    while at < len(text):
        if not text.startswith(OPEN, at):
            raise Conflict(f"no turn opens at {at}")
        end = _ROLE_END.match(text, at + len(OPEN)).end()
        if not text.startswith(AFTER_ROLE, end):
            raise Conflict(f"no role ends at {end}")
        start = end + len(AFTER_ROLE)
        token = next((t for t in _TOKEN.finditer(text, start) if t[0][0] != "\\"), None)
        if token is None or not text.startswith(CLOSE, token.start()):
            raise Conflict(f"the turn at {at} does not close")
        yield unescape(text[at + len(OPEN) : end]), unescape(text[start : token.start()]), start, token.start()
        at = token.start() + len(CLOSE)


def render(role: str, text: str) -> tuple[str, int, int, int]:
    """The turn as text, where its own text begins and ends, and the level it took."""
    name = _LEVELS[-1].sub(r"\\\g<0>", role)
    for level, control in enumerate(_LEVELS):
        out = f"{OPEN}{name}{AFTER_ROLE}{text if control is None else control.sub(r'\\\g<0>', text)}{CLOSE}"
        try:
            turns = list(parse(out))
        except Conflict:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return out, turns[0][2], turns[0][3], level
    raise Conflict("the last level holds for every text")


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def format_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, role, text, formatted, start, end (of the text in it, in code points), level and learned (whether the loss counts it), a row for each row."""
    own = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    new = [("formatted", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("level", T.IntegerType()), ("learned", T.BooleanType())]
    schema = T.StructType([*own.schema.fields, *(T.StructField(n, t) for n, t in new)])
    arrow = to_arrow_schema(schema)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            roles = [r or "" for r in b.column(2).to_pylist()]
            made = [render(r, t or "") for r, t in zip(roles, b.column(3).to_pylist())]
            columns = [list(c) for c in zip(*made)] or [[]] * 4
            values = [*columns, [r == LEARNED for r in roles]]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(b.columns, arrow)), *(pa.array(v, arrow.field(n).type) for v, (n, _) in zip(values, new))], schema=arrow)

    return own.mapInArrow(formatted, schema)


def format_conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """conv_id, chunk (from 0), formatted and loss (spans in the chunk, in code points): chunks of a conversation stand in order in one partition."""
    turns = format_turns(df, conv_id, turn, role, text)
    dealt = turns.select("conv_id", "turn", "formatted", "start", "end", "learned").repartition("conv_id")
    ordered = dealt.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")
    schema = T.StructType([turns.schema["conv_id"], T.StructField("chunk", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", SPANS)])
    arrow = to_arrow_schema(schema)

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, size = None, 0, 0
        pieces: list[str] = []
        loss: list[dict] = []

        def row() -> dict:
            return {"conv_id": conv, "chunk": number, "formatted": "".join(pieces), "loss": loss}

        for b in slices(batches):
            done: list[dict] = []
            for own, piece, start, end, learned in zip(*(b.column(n).to_pylist() for n in ("conv_id", "formatted", "start", "end", "learned"))):
                if pieces and (own != conv or size + len(piece) > chunk):
                    done.append(row())
                    number, size, pieces, loss = (number + 1 if own == conv else 0), 0, [], []
                conv = own
                if learned:
                    loss.append({"start": size + start, "end": size + end})
                pieces.append(piece)
                size += len(piece)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if pieces:
            yield pa.RecordBatch.from_pylist([row()], schema=arrow)

    return ordered.mapInArrow(put_together, schema)


def read_back(chunks: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars of each conversation, read from its chunks, which stand in order.

    turns_sha256 is over role, line feed, text and line feed of each turn, loss_sha256 over all text under the mask, unescaped.
    """
    longs = ("n_turns", "loss_chars", "formatted_chars")
    schema = T.StructType([chunks.schema["conv_id"], *(T.StructField(n, T.LongType() if n in longs else T.StringType()) for n in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"))])
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, chars, loss_chars, turns, loss = None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def row() -> dict:
            return {"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

        for b in slices(batches):
            done: list[dict] = []
            for own, number, text, spans in zip(*(b.column(c).to_pylist() for c in ("conv_id", "chunk", "formatted", "loss"))):
                if number == 0:
                    if n:
                        done.append(row())
                    conv, n, chars, loss_chars, turns, loss = own, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in parse(text):
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for s in spans:
                    said = unescape(text[s["start"] : s["end"]])
                    loss.update(said.encode("utf-8", "surrogatepass"))
                    loss_chars += len(said)
                chars += len(text)
            yield pa.RecordBatch.from_pylist(done, schema=arrow)
        if n:
            yield pa.RecordBatch.from_pylist([row()], schema=arrow)

    return chunks.mapInArrow(read, schema)


#: Each level's condition, from the grammar: a backslash that would be read as one that escapes (before an escapable character, or at the end, before the
#: closing word), control strings, and runs of # whose length leaves one or two beyond threes.
ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
l AS (SELECT *, CASE WHEN NOT (regexp_matches(text, '\\[\\#<:]|###|</turn>') OR ends_with(text, '\')) THEN text
  WHEN regexp_matches(text, '(^|[^#])(###)+#{1,2}($|[^#])') THEN regexp_replace(text, '([\\#<:])', '\\\1', 'g') ELSE regexp_replace(text, '(###|</turn>|\\)', '\\\1', 'g') END AS escaped FROM t),
f AS (SELECT *, '### ' || regexp_replace(role, '([\\#<:])', '\\\1', 'g') || ': ' || escaped || '</turn>' || chr(10) AS formatted FROM l)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(formatted)) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""
