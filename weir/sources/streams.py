"""Streams of bytes from TCP segments, by intervals of sequence numbers, and HTTP messages from the pieces of a stream.

No task needs a whole connection. What depends on order (which incarnation of a connection a segment belongs to, how far sequence numbers have
wrapped, how much is already there) is found within slices first, of time or of sequence, and then over the slices' totals:

* a connection begins anew at a SYN, after a RST, and after 120 s of silence of a direction;
* numbers of 32 bits become positions from the first one on, by differences that are less than half of the range;
* a segment brings what lies beyond all that earlier positions have; repeats bring nothing, and where bytes are missing a new ``run`` begins.

A stream comes as pieces of about ``SLICE`` bytes, in order by incarnation, run and slice. ``messages`` reads the pieces of a direction one after another, and keeps what a message
still lacks; where bytes are missing it gives what there is and goes on at the next start line. Cut as you like, the pieces give the messages of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import http

CONNECTION = ["source_id", "src", "sport", "dst", "dport"]
PIECE = "source_id string, src string, sport int, dst string, dport int, first_us long, incarnation long, run long, slice long, start long, data binary"
SLICE, IDLE_US, TIME_US = 1 << 20, 120_000_000, 60_000_000
FIN, SYN, RST = 1, 2, 4


def _signed(difference: Column) -> Column:
    """A difference of 32-bit numbers, by the shorter way round."""
    return F.pmod(difference + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def _counted(rows: DataFrame, keys: list[str], part: str, order: list, flag: Column, name: str) -> DataFrame:
    """``rows`` with how many up to and with each one have ``flag``: within the parts of a key, then over the parts before."""
    own = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_n", F.sum(F.when(flag, 1).otherwise(0)).over(own))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, part).agg(F.max("_n").alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return rows.join(totals, [*keys, part]).withColumn(name, F.col("_n") + F.col("_before")).drop("_n", "_before")


def positioned(segments: DataFrame) -> DataFrame:
    """Segments with incarnation and pos, the place of their first byte in it; those that only open or close a connection come along."""
    order = ["ts_us", "seq", "flags", "payload"]
    rows = segments.withColumn("part", F.floor(F.col("ts_us") / TIME_US))
    own = Window.partitionBy(*CONNECTION, "part").orderBy(*order)
    parts = Window.partitionBy(*CONNECTION).orderBy("part")
    # the last time and flags of the part before stand for the segment before a part's first one
    ends = rows.groupBy(*CONNECTION, "part").agg(F.max(F.struct("ts_us", "seq", "flags")).alias("_end")).withColumn("_last", F.lag("_end").over(parts)).drop("_end")
    rows = rows.withColumn("_prior", F.lag(F.struct("ts_us", "seq", "flags")).over(own)).join(ends, [*CONNECTION, "part"])
    prior = F.coalesce("_prior", "_last")
    has = lambda c, bit: c.bitwiseAND(F.lit(bit)) != 0
    # a SYN that is sent again opens nothing anew
    again = has(F.col("flags"), SYN) & has(prior["flags"], SYN) & (prior["seq"] == F.col("seq"))
    begins = prior.isNull() | (has(F.col("flags"), SYN) & ~again) | has(prior["flags"], RST) | (F.col("ts_us") - prior["ts_us"] > IDLE_US)
    rows = _counted(rows.withColumn("_new", F.coalesce(begins, F.lit(True))).drop("_prior", "_last"), CONNECTION, "part", order, F.col("_new"), "incarnation").drop("_new")

    keys = [*CONNECTION, "incarnation"]
    opens = has(F.col("flags"), SYN)
    rows = rows.withColumn("at", F.col("seq") + F.when(opens, 1).otherwise(0))
    heads = rows.where(opens | (F.octet_length("payload") > 0)).groupBy(*keys, "part").agg(F.min_by("at", F.struct(*order)).alias("head"))
    steps = Window.partitionBy(*keys).orderBy("part")
    moved = heads.withColumn("_step", F.coalesce(_signed(F.col("head") - F.lag("head").over(steps)), F.lit(0)))
    heads = moved.withColumn("offset", F.sum("_step").over(steps.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")
    return rows.join(heads, [*keys, "part"]).withColumn("pos", F.col("offset") + _signed(F.col("at") - F.col("head"))).drop("head", "offset", "at", "part")


def streams(segments: DataFrame, slice_bytes: int = SLICE) -> DataFrame:
    """The bytes of each direction of each connection as pieces (``PIECE``): of one run, in one slice of its positions."""
    keys = [*CONNECTION, "incarnation"]
    rows = positioned(segments)
    firsts = rows.groupBy(*keys).agg(F.min("ts_us").alias("first_us"))
    # positions start at 0 with the first byte seen, or the one after SYN; what lies before is a repeat of what was not captured
    own = rows.where(F.octet_length("payload") > 0).select(*keys, "ts_us", "payload", F.greatest("pos", F.lit(0)).alias("start"), F.col("pos"), (F.col("pos") + F.octet_length("payload")).alias("end")).where("end > start")
    own = own.withColumn("slice", F.floor(F.col("start") / slice_bytes))
    order = ["start", "ts_us", F.col("end").desc(), "payload"]
    within = Window.partitionBy(*keys, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    slices = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = own.groupBy(*keys, "slice").agg(F.max("end").alias("_end")).withColumn("_before", F.max("_end").over(slices)).drop("_end")
    own = own.withColumn("_there", F.max("end").over(within)).join(ends, [*keys, "slice"])
    there = F.greatest(F.coalesce("_there", F.lit(0)), F.coalesce("_before", F.lit(0)))
    own = own.withColumn("from", F.greatest("start", there)).withColumn("hole", F.col("from") > there).where("end > from").drop("_there", "_before")
    own = _counted(own, keys, "slice", ["from"], F.col("hole"), "run")
    fresh = own.select(*keys, "run", "slice", "from", F.substring("payload", (F.col("from") - F.col("pos") + 1).cast("int"), F.lit(1 << 30)).alias("bytes"))
    # a slice has no more than its bytes and one segment's
    pieces = fresh.groupBy(*keys, "run", "slice").agg(F.min("from").alias("start"), F.array_sort(F.collect_list(F.struct("from", F.hex("bytes").alias("x")))).alias("all"))
    pieces = pieces.withColumn("data", F.unhex(F.array_join(F.transform("all", lambda x: x["x"]), "")))
    return pieces.join(firsts, keys).select(*CONNECTION, "first_us", "incarnation", "run", "slice", "start", "data")


#: Of bytes without a start line so many are kept, as one may be cut; a zero before them tells that they don't begin a line.
_TAIL = 12


class Messages:
    """HTTP messages of one direction, from pieces that come one after another."""

    def __init__(self) -> None:
        self.left, self.need = b"", 0

    def feed(self, data: bytes) -> Iterator[http.Message]:
        """The messages that are whole by now."""
        self.left += data
        # what a body lacks is known, so the bytes there are not read again and again
        if len(self.left) < self.need:
            return
        at, self.need = 0, 0
        while at < len(self.left):
            got = http.scan(self.left, at)
            if got is None or got[0] is None and len(self.left) - got[1] > http.MOST_HEADER:
                # what follows a message may be the beginning of a start line
                rest = self.left[at:]
                self.left = rest if len(rest) <= _TAIL else b"\0" + rest[-_TAIL:]
                return
            message, end, whole, need = got
            if not whole:
                at = at if message else end
                self.left, self.need = self.left[at:], need - at
                return
            yield message
            at = end
        self.left = b""

    def end(self) -> Iterator[http.Message]:
        """What there is of a message that is cut; then nothing is left."""
        yield from http.messages(self.left)
        self.left, self.need = b"", 0


def messages(pieces: DataFrame) -> DataFrame:
    """The messages (``http.MESSAGES``) of each direction, numbered by incarnation; a task reads a direction piece by piece, and holds a message at most."""
    dealt = pieces.repartition(*CONNECTION).sortWithinPartitions(*CONNECTION, "incarnation", "run", "slice").select(*CONNECTION, "first_us", "incarnation", "run", "data")
    names = [c.split()[0] for c in http.MESSAGES.replace("array<struct<name:string,value:string>>", "array").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, stretch, number = Messages(), None, None, 0

        def rows(found: Iterator[http.Message]) -> Iterator[dict]:
            nonlocal number
            for kind, method, uri, status, headers, body in found:
                own = {"seq": number, "kind": kind, "method": method, "uri": uri, "status": status, "headers": [{"name": n, "value": v} for n, v in headers], "body": body}
                yield dict(zip(names, key)) | own
                number += 1

        for b in batches:
            out: list[dict] = []
            for *conn, first_us, incarnation, piece, data in zip(*(c.to_pylist() for c in b.columns)):
                if (here := (*conn, first_us, incarnation)) != stretch:
                    if key is not None:
                        out += rows(state.end())
                    key, stretch, last, number = (*conn, first_us), here, piece, 0
                elif piece != last:
                    # bytes are missing between the two
                    out += rows(state.end())
                    last = piece
                out += rows(state.feed(data))
            yield pa.RecordBatch.from_pylist(out, schema=_MESSAGE)
        if key is not None:
            yield pa.RecordBatch.from_pylist(list(rows(state.end())), schema=_MESSAGE)

    return dealt.mapInArrow(run, http.MESSAGES)


_MESSAGE = pa.schema([("source_id", pa.string()), ("src", pa.string()), ("sport", pa.int32()), ("dst", pa.string()), ("dport", pa.int32()), ("first_us", pa.int64()), ("seq", pa.int32()), ("kind", pa.string()), ("method", pa.string()), ("uri", pa.string()), ("status", pa.int32()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("body", pa.binary())])
