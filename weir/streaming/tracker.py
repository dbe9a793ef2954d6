"""Turns of a stream of calls, by the clocks of their sources, and the turns that are still under way.

What waits is a table of its own, written with each micro-batch (``Store.keep``): open calls, what is known of sessions, and the clock of each source,
which is the latest end of its calls and heartbeats. Anyone can read it while the stream goes on (``snapshot``), and a batch that is done again starts from
the same tables. All steps are joins and windows by session; nothing is one global watermark's business.

A turn that has ended is given out when its source's clock is ``grace_us`` past the end of its terminal call, and the turns of its session before it
are out; until then calls that come late, or in another order, still count. Calls from strictly before what a session gave out last are dropped; those of the same
microsecond belong to the next turn. A session whose last call is ``idle_us`` behind its source's clock, and that has no terminal call waiting, gives up its open turn as
incomplete. Sessions without calls for twice as long are forgotten. Turns are made of their calls by ``turns.build``, with the numbers, and so the ids, that the batch gives
them; after a turn that was given up, the next number is used. Once sessions of a source have been forgotten, those it does not know begin with ``EPOCH`` times the spans of time
that sessions are known for since the source began, so no id is used again.

Auxiliary calls belong to no turn. Rows without a session are heartbeats (``end_us``). A turn's calls are its session's state, so a session that never ends one grows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import turns
from ..store import Store

GRACE_US, IDLE_US = 1_000_000, 600_000_000
#: More turns than a session has before it is forgotten.
EPOCH = 1_000_000
SESSION = ["source_id", "session_id"]
OPEN, SESSIONS, CLOCKS = "open_calls", "sessions", "turn_clocks"


def _numbered(calls: DataFrame, sessions: DataFrame) -> DataFrame:
    """Open calls with turn_no, counted on from what their session gave out."""
    own = turns.numbered(calls).join(sessions.select(*SESSION, "given"), SESSION, "left")
    return own.withColumn("turn_no", F.col("turn_no") + F.coalesce("given", F.lit(0))).drop("given")


def step(calls: DataFrame, store: Store, number: int, grace_us: int = GRACE_US, idle_us: int = IDLE_US) -> None:
    """One micro-batch: writes the turns that are given out, and what waits."""

    def kept(name: str, rows: DataFrame) -> DataFrame:
        store.keep(name, rows, number)
        return store.spark.read.schema(rows.schema).parquet(store.state_path(name, number))

    forget_us = 2 * idle_us
    opened, sessions, clocks = (store.state(n, number) for n in (OPEN, SESSIONS, CLOCKS))
    latest = calls.groupBy("source_id").agg(F.max("end_us").alias("clock_us"), F.min("end_us").alias("first_us"))
    latest = latest if clocks is None else latest.unionByName(clocks).groupBy("source_id").agg(F.max("clock_us").alias("clock_us"), F.min("first_us").alias("first_us"))
    clocks = kept(CLOCKS, latest)

    own = calls.where("session_id is not null and not is_auxiliary")
    fresh = ((F.col("clock_us") - F.col("first_us")) / forget_us).cast("long") * EPOCH
    seen = own.groupBy(*SESSION).agg(F.max("end_us").alias("active_us")).join(clocks, "source_id").select(*SESSION, "active_us", fresh.alias("given"), F.lit(None).cast("long").alias("done_us"), F.lit(False).alias("known"))
    both = seen if sessions is None else seen.unionByName(sessions.withColumn("known", F.lit(True)))
    sessions = kept("sessions_seen", both.groupBy(*SESSION).agg(F.max("active_us").alias("active_us"), F.max_by("given", "known").alias("given"), F.max("done_us").alias("done_us")))
    own = own.join(sessions.select(*SESSION, "done_us"), SESSION, "left").where("done_us is null or request_us >= done_us").drop("done_us")
    waiting = own if opened is None else opened.unionByName(own, allowMissingColumns=True)
    numbered = _numbered(waiting, sessions).join(clocks.drop("first_us"), "source_id")

    # a turn is ready if its terminal calls are past their grace; it goes with all before it, or waits with all after it
    told = numbered.groupBy(*SESSION, "turn_no").agg(
        F.max("is_terminal").alias("ended"), F.max(F.when(F.col("is_terminal"), F.col("end_us"))).alias("ended_us"), F.sum(F.col("is_terminal").cast("int")).alias("terminals"),
        F.max("request_us").alias("last_us"), F.max("end_us").alias("active_us"), F.first("clock_us").alias("clock_us"),
    )
    order = Window.partitionBy(*SESSION).orderBy("turn_no").rowsBetween(Window.unboundedPreceding, 0)
    ready = F.when(F.col("ended"), F.col("clock_us") >= F.col("ended_us") + grace_us).otherwise(F.col("clock_us") > F.max("active_us").over(Window.partitionBy(*SESSION)) + idle_us)
    told = told.withColumn("ready", ready).withColumn("goes", F.min("ready").over(order))
    # read again by what follows, so the joins with the state are done once
    marked = kept("turn_calls", numbered.join(told.select(*SESSION, "turn_no", "goes"), [*SESSION, "turn_no"]).drop("clock_us"))
    store.write("traces", turns.build(marked.where("goes").drop("goes")), number)
    store.keep(OPEN, marked.where("not goes").drop("goes", "turn_no"), number)

    out = marked.where("goes").groupBy(*SESSION, "turn_no").agg(F.max("request_us").alias("last_us"), F.sum(F.col("is_terminal").cast("int")).alias("terminals"))
    gone = out.groupBy(*SESSION).agg(F.max("last_us").alias("_done"), F.max(F.col("turn_no") + F.greatest("terminals", F.lit(1))).alias("_given"))
    busy = marked.where("not goes").select(*SESSION, F.lit(True).alias("_busy")).distinct()
    left = sessions.join(gone, SESSION, "left").join(busy, SESSION, "left").join(clocks, "source_id").where(F.col("_busy") | (F.col("active_us") >= F.col("clock_us") - forget_us))
    store.keep(SESSIONS, left.select(*SESSION, "active_us", F.coalesce("_given", "given").alias("given"), F.greatest("_done", "done_us").alias("done_us")), number)


def snapshot(store: Store) -> DataFrame | None:
    """Turns under way: of each session with open calls, those up to and with the first terminal one, if they would be a turn; its id is the one it will be written with."""
    opened, sessions = store.state(OPEN, before=False), store.state(SESSIONS, before=False)
    if opened is None:
        return None
    own = _numbered(opened, sessions)
    first = F.min("turn_no").over(Window.partitionBy(*SESSION))
    return turns.build(own.withColumn("_first", first).where("turn_no = _first").drop("_first"), "in_progress")


def start(calls: DataFrame, store: Store, checkpoint: str, once: bool = False, every: str = "1 second", grace_us: int = GRACE_US, idle_us: int = IDLE_US) -> StreamingQuery:
    """Turns of a stream of calls, as ``turns.assemble`` takes them."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            step(batch, store, number, grace_us, idle_us)
        finally:
            batch.unpersist()

    writer = calls.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
