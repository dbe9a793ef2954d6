"""Rollups of a stream of starts and ends of calls, each source by a clock of its own.

Spark's watermark is one for the whole query, so a source that is hours behind would have all its rows late. Here a clock
is kept for each source: the latest time of any of its events, heartbeats too. Events wait in state by window of the
finest granularity and are given out when a cadence of that length has passed on their source's clock, counted from the first window's start, and their
window lies behind it. Events whose window was given out already open it again and go out with the next cadence; readers add rows up. No event is ever dropped.

A source is dealt over ``shards`` by the id of the call, as one may have a third of all events. Every task that reads events tells all shards
of a source its latest time, so their clocks go together; that is a row for each task, source and shard.

A start tells the traffic (calls, of streams or not), an end what became of it (tokens, errors, times, finish reason); both count in the window of the
request. Only an end knows the tool surface, so starts have none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import gauge, metrics, sketches
from ..operators.predicates import GRANULARITIES
from ..store import Store

FINEST_US = GRANULARITIES[sketches.FINEST] * 1_000_000
#: Columns of an event; ``ts_us`` is what its source's clock goes by. Kinds: start, complete, heartbeat, and end, after which nothing is held back.
EVENT = (
    "kind string, source_id string, ts_us long, id string, request_us long, wire_api string, model string, server_ip string, tool_surface string, is_stream boolean, status_code int, "
    "input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long, ttft_ms double, e2e_latency_ms double, response_us long, complete_us long, finish_reason string"
)
_TICK = "tick"


def call_events(spans: DataFrame) -> DataFrame:
    """A start for each span, and an end for each that has one."""
    names = [c.split()[0] for c in EVENT.split(", ")]
    start = {"kind": F.lit("start"), "ts_us": F.col("request_us")} | {n: F.lit(None) for n in names[8:] if n != "is_stream"}
    end = {"kind": F.lit("complete"), "ts_us": F.coalesce("complete_us", "request_us")}
    typed = [c.split() for c in EVENT.split(", ")]

    def rows(own: dict) -> DataFrame:
        return spans.select(*(own.get(n, F.col(n) if n in spans.columns else F.lit(None)).cast(t).alias(n) for n, t in typed))

    # a call without an end is under way
    return rows(start).unionByName(rows(end).where("complete_us is not null"))


def two_phase(events: DataFrame) -> DataFrame:
    """Rollup rows of the finest windows: of starts with the traffic, of ends with the rest."""
    starts = sketches.finest(events.where("kind = 'start'"))
    ends = sketches.finest(events.where("kind = 'complete'"))
    traffic = ("call_count", "stream_count", "non_stream_count")
    return starts.unionByName(ends.withColumns({c: F.lit(0).cast("long") for c in traffic}))


class SourceClock(StatefulProcessor):
    """Holds the events of a source's shard until the source's clock is past their windows."""

    def __init__(self, names: list[str], silent_ms: int | None) -> None:
        self.names, self.silent_ms = names, silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        long = T.LongType()
        self.handle = handle
        self.clock = handle.getValueState("clock", T.StructType([T.StructField(n, long) for n in ("clock_us", "drained_us", "entries")]))
        self.held = handle.getMapState("held", T.StructType([T.StructField("window_us", long), T.StructField("entry", long)]), T.StructType([T.StructField("rows", T.BinaryType())]))

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clock, drained, entries = self.clock.get() if self.clock.exists() else (None, None, 0)
        ended = False
        for frame in rows:
            latest = int(frame["ts_us"].max())
            clock = latest if clock is None else max(clock, latest)
            ended = ended or bool((frame["kind"] == "end").any())
            own = frame[frame["kind"].isin(["start", "complete"])]
            if len(own):
                window = own["request_us"].astype("int64") // FINEST_US * FINEST_US
                drained = int(window.min()) if drained is None else drained
                for at, part in own[self.names].groupby(window):
                    self.held.updateValue((int(at), entries), (_packed(part),))
                    entries += 1
        if ended or drained is not None and clock - drained >= FINEST_US:
            yield from self._given(None if ended else clock)
            drained = clock
        self.clock.update((clock, drained, entries))
        if self.silent_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._given(None)

    def _given(self, clock: int | None) -> Iterator[pd.DataFrame]:
        """Gives out, and forgets, the windows that end by ``clock``; all of them without one."""
        for window, entry in sorted(tuple(k) for k in self.held.keys()):
            if clock is None or window + FINEST_US <= clock:
                yield _unpacked(self.held.getValue((window, entry))[0])
                self.held.removeKey((window, entry))

    def close(self) -> None:
        pass


def _packed(frame: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_pandas(frame, preserve_index=False)
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(rows: bytes) -> pd.DataFrame:
    """As objects, so that whole numbers and nulls stay what they are."""
    table = pa.ipc.open_stream(rows).read_all()
    return pd.DataFrame({n: pd.Series(table.column(n).to_pylist(), dtype=object) for n in table.column_names})


def by_clock(events: DataFrame, shards: int = 8, silent_ms: int | None = None) -> DataFrame:
    """The starts and ends of a stream of ``EVENT``, given out by the clocks of their sources.

    ``silent_ms``: after so long without any event, by the time of day, a source gives out what it holds.
    """
    names = [c.split()[0] for c in EVENT.split(", ")]
    dealt = events.select(*names).withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    schema = to_arrow_schema(dealt.schema)

    def with_ticks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latest: dict[str, int] = {}
        ended: set[str] = set()
        for b in batches:
            kind = b.column(names.index("kind"))
            for source, at, k in zip(b.column(names.index("source_id")).to_pylist(), b.column(names.index("ts_us")).to_pylist(), kind.to_pylist()):
                latest[source] = max(at, latest.get(source, at))
                if k == "end":
                    ended.add(source)
            yield b.filter(pc.is_in(kind, pa.array(["start", "complete"])))
        ticks = [{"kind": "end" if source in ended else _TICK, "source_id": source, "ts_us": at, "shard": k} for source, at in latest.items() for k in range(shards)]
        yield pa.RecordBatch.from_pylist(ticks, schema=schema)

    told = dealt.where("source_id is not null and ts_us is not null").mapInArrow(with_ticks, dealt.schema)
    mode = "none" if silent_ms is None else "processingTime"
    return told.groupBy("source_id", "shard").transformWithStateInPandas(SourceClock(names, silent_ms), events.select(*names).schema, "append", mode)


def start(events: DataFrame, store: Store, checkpoint: str, once: bool = False, every: str = "1 second", shards: int = 8, silent_ms: int | None = None) -> list[StreamingQuery]:
    """Two queries: the rollups by source clock, and the calls under way, which are counted as events come. A batch done again replaces its own rows."""

    def windows(batch: DataFrame, number: int) -> None:
        store.ingest_rollups(two_phase(batch), number)
        store.write("llm_finish_metrics", metrics.finish_rows(batch.where("kind = 'complete'")), number)

    def going(batch: DataFrame, number: int) -> None:
        store.ingest_active(gauge.event_steps(batch), number)

    out = []
    for name, rows, write in (("windows", by_clock(events, shards, silent_ms), windows), ("active", events, going)):
        writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}")
        out.append((writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start())
    return out
