"""Calls under way at once, as a running count that goes on over batches.

Each start of a call adds one to its source's count in every tier, each end takes one away, never below none; the count is sampled at starts.
With S the running sum from a count x before, the count is S - min(0, running minimum of S), so it can be taken up where a batch
ended. Both run within chunks of time first, then over the chunks' totals, so no task needs all calls of a source.

A batch of spans knows ends that lie beyond its last start. These wait (``pending``) until a start of their source goes as far, so spans that come in several
batches in the order of their starts count as they do in one. A span that comes late counts with what its source has under way when it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .predicates import ANY, GRANULARITIES
from .sketches import DIMENSIONS, TIERS

KEYS = ("source_id", *DIMENSIONS)
CHUNK_US = 3_600_000_000
STEP = "source_id string, wire_api string, model string, server_ip string, id string, ts_us long, delta int"
STATE = "source_id string, wire_api string, model string, server_ip string, active long"


def steps(spans: DataFrame) -> DataFrame:
    """Starts and known ends of spans; an end counts after its own start."""
    starts = spans.select(*KEYS, "id", F.col("request_us").alias("ts_us"), F.lit(1).alias("delta"))
    ends = spans.where("complete_us is not null").select(*KEYS, "id", F.greatest(F.col("complete_us"), F.col("request_us") + 1).alias("ts_us"), F.lit(-1).alias("delta"))
    return starts.unionByName(ends)


def event_steps(events: DataFrame) -> DataFrame:
    """Starts and ends of events (kind `start` or `complete`), in the order of their own times."""
    return events.where(F.col("kind").isin("start", "complete")).select(*KEYS, "id", "ts_us", F.when(F.col("kind") == "start", 1).otherwise(-1).alias("delta"))


def due(own: DataFrame, clocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The steps up to the last start of each source, those beyond it, and the clocks (source_id, clock_us)."""
    now = own.where("delta = 1").groupBy("source_id").agg(F.max("ts_us").alias("clock_us"))
    if clocks is not None:
        now = now.unionByName(clocks).groupBy("source_id").agg(F.max("clock_us").alias("clock_us"))
    # a row for each source
    told = own.join(now, "source_id", "left")
    passed = F.coalesce(F.col("ts_us") <= F.col("clock_us"), F.lit(False))
    return told.where(passed).drop("clock_us"), told.where(~passed).drop("clock_us"), now


def _in_tiers(own: DataFrame) -> DataFrame:
    kept = F.explode(F.array(*(F.struct(*((F.col(d) if keep else F.lit(ANY)).alias(d) for d, keep in zip(DIMENSIONS, t))) for t in TIERS)))
    rest = [c for c in own.columns if c not in DIMENSIONS]
    return own.withColumn("_t", kept).select(*rest, *(F.col(f"_t.{d}").alias(d) for d in DIMENSIONS))


def run(own: DataFrame, before: DataFrame | None = None, granularities: dict[str, int] = GRANULARITIES, chunk_us: int = CHUNK_US, hold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """The most calls under way, and the sum and number of samples, by source, tier, granularity and window; and the counts afterwards (``STATE``).

    Sources and dimensions go by a fingerprint of 64 bits until the windows are counted, as sorting by names takes several times as long. Which of two starts at one
    time counts first makes no difference. ``hold``: stores rows that are read twice.
    """
    tiered = _in_tiers(own.select(*KEYS, "ts_us", "delta"))
    rows = tiered.select(F.xxhash64(*KEYS).alias("k"), "ts_us", "delta", F.floor(F.col("ts_us") / chunk_us).alias("chunk"))
    names = _in_tiers(own.select(*KEYS).distinct()).distinct().select(F.xxhash64(*KEYS).alias("k"), *KEYS)
    order = Window.partitionBy("k", "chunk").orderBy("ts_us", "delta").rowsBetween(Window.unboundedPreceding, 0)
    going = hold(rows.withColumn("s", F.sum("delta").over(order)).withColumn("low", F.min("s").over(order)))
    totals = going.groupBy("k", "chunk").agg(F.sum("delta").alias("d"), F.min("s").alias("m"))
    if before is None:
        totals = totals.withColumn("x", F.lit(0))
    else:
        totals = totals.join(before.select(F.xxhash64(*KEYS).alias("k"), "active"), "k", "left").withColumn("x", F.coalesce("active", F.lit(0))).drop("active")
    earlier = Window.partitionBy("k").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("offset", F.col("x") + F.coalesce(F.sum("d").over(earlier), F.lit(0)))
    offsets = offsets.withColumn("lowest", F.coalesce(F.min(F.col("offset") + F.col("m")).over(earlier), F.lit(0)))
    low = F.least(F.lit(0), F.col("lowest"), F.col("offset") + F.col("low"))
    active = (F.col("offset") + F.col("s") - low).cast("long").alias("active")
    samples = going.where("delta = 1").join(offsets.select("k", "chunk", "offset", "lowest"), ["k", "chunk"]).select("k", "ts_us", active)
    counted = None
    # each granularity from the finer one before: a maximum and sums add up over time
    at, finest = F.col("ts_us"), None
    for name, seconds in sorted(granularities.items(), key=lambda x: x[1]):
        window = (at - F.pmod(at, F.lit(seconds * 1_000_000))).alias("window_us")
        if finest is None:
            finest = hold(samples.groupBy("k", window).agg(F.max("active").alias("active_calls_max"), F.sum("active").alias("active_calls_sum"), F.count("*").alias("active_calls_samples")))
            level = finest
        else:
            level = finest.groupBy("k", window).agg(*(f(c).alias(c) for f, c in ((F.max, "active_calls_max"), (F.sum, "active_calls_sum"), (F.sum, "active_calls_samples"))))
        at = F.col("window_us")
        level = level.withColumn("granularity", F.lit(name))
        counted = level if counted is None else counted.unionByName(level)
    after = offsets.groupBy("k").agg((F.max("x") + F.sum("d") - F.least(F.lit(0), F.min(F.col("offset") + F.col("m")))).cast("long").alias("active"))
    after = after.join(names, "k").select(*KEYS, "active")
    if before is not None:
        after = after.unionByName(before.join(after, list(KEYS), "left_anti"))
    return counted.join(names, "k").drop("k"), after
