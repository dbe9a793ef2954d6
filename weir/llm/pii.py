"""Personal data by regular expressions, checksums and context, in DataFrame operations only.

Regular expressions propose spans; lengths and checksums (Luhn for cards, mod 97 for IBANs) confirm them; words near a span
adjust its score, and spans below ``least`` are left out. Kinds with a contract of their own (the base kinds) start at the
score 1, so context never removes them; the other kinds need a checksum or a word nearby.

Where a pattern matches follows from what it leaves over: the parts between matches and the matches themselves, whose lengths
add up to positions in code points. Repetitions are possessive and matches start only where a run of their first characters
starts, so time is linear in the length of a text, and no match recurses, however long a run is.

Null and empty texts have no spans. Each row, repeated ones too, is searched on its own; other columns pass through, but for one named ``spans``, in
any case, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on either side of a span that count as near.
NEAR = 40
#: Matches added up at a time, and code points of a piece of text in which context is looked up (at least ``NEAR``).
BLOCK, PIECE = 64, 512


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """The Luhn sum of the digits of s is a multiple of 10."""
    d = F.reverse(_digits(s))

    def worth(k: Column) -> Column:
        x = F.substring(d, k, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(d)), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(s: Column) -> Column:
    n = F.char_length(_digits(s))
    return F.when(n.between(13, 19), _luhn(s)).otherwise(False)


def _ip(s: Column) -> Column:
    return s.rlike(r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$")


def _phone(s: Column) -> Column:
    return F.char_length(_digits(s)).between(9, 15)


def _iban(s: Column) -> Column:
    """The country's letters and the check digits moved to the end, letters as 10 to 35, are 1 modulo 97."""
    x = F.replace(s, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(x, 5, 34), F.substring(x, 1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(c == "", a).otherwise((a * F.when(v > 9, 100).otherwise(10) + v) % 97)

    return F.when(F.char_length(x).between(15, 34), F.aggregate(moved, F.lit(0), step) == 1).otherwise(False)


@dataclass(frozen=True)
class Kind:
    """A kind of span. ``hint``: a cheap test of a text that holds for all with a match. ``start``: the score before context;
    ``near`` words raise it by ``raises``, ``against`` words lower it by as much."""

    name: str
    pattern: str
    hint: Callable[[Column], Column]
    valid: Callable[[Column], Column] | None
    start: float
    near: str = ""
    against: str = ""
    raises: float = 0.0


_LOCAL = "[A-Za-z0-9._%+-]"
_NAMED = r"(?i)\b(?:token|secret|password|passwd|api_?key|access_?key)\b"
#: The base kinds, in the order of the contract, then those that need a checksum, a known form or words nearby.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@"), None, 1.0),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), _ip, 1.0),
    # from the first digit of a run on, 13 digits at least; shorter runs can hold no card
    Kind("card", r"(?<![0-9])(?=[0-9](?:[\x20-]?[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+", lambda t: t.rlike(r"[0-9][0-9\x20-]{12}"), _card, 1.0),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), _phone, 1.0),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}"), _iban, 0.9, r"(?i)\b(?:iban|account|bank)\b", r"(?i)\b(?:example|sample|invalid)\b", 0.1),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", lambda t: t.rlike(r"[0-9]-[0-9]"), None, 0.3, r"(?i)\b(?:ssn|social)\b", r"(?i)\b(?:order|invoice|part|serial)\b", 0.4),
    Kind("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", lambda t: t.contains("AKIA"), None, 0.9),
    # / + . inside a token, and / + = around it; an = before it belongs to the name
    Kind("secret", r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+.=-]{16})[/+]*+[A-Za-z0-9_-]++(?:[/+.]++[A-Za-z0-9_-]++)*+[/+]*+={0,2}+", lambda t: t.rlike(_NAMED), lambda s: (F.char_length(s) >= 16) & s.rlike("[0-9]") & s.rlike("[A-Za-z]"), 0.1, _NAMED + r"[\W]{1,5}$", "", 0.5),
)
BASE = ("email", "ip", "card", "phone")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with this computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _proposed(text: Column, pattern: str) -> Column:
    """first, end (code points) and s of every match, in order.

    The parts between matches and the matches are added up in blocks of ``BLOCK``, from offsets added up over blocks: an
    array that grows is copied at each step, so one over a whole text would take time with the square of its matches.
    """
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))
    steps = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("s"))
    none = F.array().cast("array<struct<first:int,end:int,s:string>>")

    def add(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        end = first + F.char_length(x["s"])
        span = F.struct(first.alias("first"), end.alias("end"), x["s"].alias("s"))
        return F.struct(F.coalesce(end, first).alias("at"), F.when(x["s"].isNull(), acc["spans"]).otherwise(F.concat(acc["spans"], F.array(span))).alias("spans"))

    def length(block: Column) -> Column:
        return F.aggregate(block, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.char_length(x["s"]), F.lit(0)))

    def placed(blocks: Column) -> Column:
        offsets = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + length(b))))
        both = F.arrays_zip(blocks.alias("block"), F.slice(offsets, 1, F.size(blocks)).alias("at"))
        return F.flatten(F.transform(both, lambda z: F.aggregate(z["block"], F.struct(z["at"].alias("at"), none.alias("spans")), add, lambda acc: acc["spans"])))

    def in_blocks(whole: Column) -> Column:
        last = F.floor((F.size(whole) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(whole, i * BLOCK + 1, F.lit(BLOCK)))

    return _let(steps, lambda whole: _let(in_blocks(whole), placed))


def _around(pieces: Column, at: Column, before: bool) -> Column:
    """The ``NEAR`` code points before or from position ``at`` on, from the text in pieces of ``PIECE``: a place far back costs no more than one in front."""
    k = F.floor(at / PIECE).cast("int")
    offset = at - k * PIECE
    if before:
        both = F.concat(F.coalesce(F.get(pieces, k - 1), F.lit("")), F.coalesce(F.get(pieces, k), F.lit("")))
        end = F.when(k > 0, offset + PIECE).otherwise(offset)
        return F.substring(both, F.greatest(end - NEAR, F.lit(0)) + 1, F.least(end, F.lit(NEAR)))
    return F.substring(F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit(""))), offset + 1, F.lit(NEAR))


def _confirmed(text: Column, kind: Kind, least: float) -> Column:
    """kind, first, end and score of the spans of a kind."""

    def scored(x: Column, pieces: Column | None) -> Column:
        score = F.lit(kind.start)
        if pieces is not None:
            before = _around(pieces, x["first"], True)
            around = F.concat_ws(" ", before, _around(pieces, x["end"], False))
            if kind.near:
                score = score + F.when(before.rlike(kind.near) if kind.near.endswith("$") else around.rlike(kind.near), kind.raises).otherwise(0.0)
            if kind.against:
                score = score - F.when(around.rlike(kind.against), kind.raises).otherwise(0.0)
        return F.struct(F.lit(kind.name).alias("kind"), x["first"].alias("first"), x["end"].alias("end"), score.alias("score"))

    spans = _proposed(text, kind.pattern)
    if kind.valid is not None:
        valid = kind.valid
        spans = F.filter(spans, lambda x: valid(x["s"]))
    none = F.array().cast("array<struct<kind:string,first:int,end:int,score:double>>")
    if kind.near or kind.against:
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        near = lambda own: _let(pieces, lambda p: F.transform(own, lambda x: scored(x, p)))
        scores = _let(spans, lambda own: F.when(F.size(own) > 0, near(own)).otherwise(none))
    else:
        scores = F.transform(spans, lambda x: scored(x, None))
    return F.when(kind.hint(text), F.filter(scores, lambda x: x["score"] >= least)).otherwise(none)


def find(df: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """Adds ``spans``: an array of (kind, first, end, score), by kind in the order of ``KINDS``, then by position."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumn("spans", F.concat(*(_confirmed(whole, k, least) for k in KINDS)))


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*kinds))


def listed(spans: Column) -> Column:
    """kind:first:end of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["first"].cast("string"), x["end"].cast("string"))), ",")
