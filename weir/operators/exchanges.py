"""HTTP exchanges: pairing requests with responses, and heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pair(events: DataFrame) -> DataFrame:
    """Each request with the first response of its flow before the next request.

    ``events``: flow, ts_us, kind (0 request, 1 response), seq, label. A request that another one follows first stays unpaired, and so do
    further responses. Requests of a flow are numbered in order; a response belongs to the last request before it. Events without a time come last
    in their flow; requests without a flow have no response. Of responses equal in time and seq the one with the least label counts.
    """
    order = Window.partitionBy("flow").orderBy(*(F.asc_nulls_last(c) for c in ("ts_us", "kind", "seq"))).rowsBetween(Window.unboundedPreceding, 0)
    own = events.withColumn("n", F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(order)).where("n > 0")
    at = F.struct(F.col("ts_us").isNull(), "ts_us", F.col("seq").isNull(), "seq", "label")
    out = own.groupBy("flow", "n").agg(F.min(F.when(F.col("kind") == 0, at)).alias("q"), F.min(F.when((F.col("kind") == 1) & F.col("flow").isNotNull(), at)).alias("r"))
    return out.select("flow", F.col("q.seq").alias("request"), F.col("q.ts_us").alias("request_us"), F.col("r.seq").alias("response"), F.col("r.ts_us").alias("response_us"), F.col("r.label").alias("response_label"), ((F.col("r.ts_us") - F.col("q.ts_us")) / 1000.0).alias("duration_ms"))


def heartbeats(packets: DataFrame, gap_us: int = 1_000_000, chunk_us: int = 3_600_000_000) -> DataFrame:
    """A heartbeat before each packet that comes a gap or more after the one before it, by source, and before the first.

    Packets are put in order within chunks of time; the last one of the chunk before comes from a row for each source and chunk, so no
    task needs all packets of a source.
    """
    own = packets.select("source_id", "ts_us", "seq", F.floor(F.col("ts_us") / chunk_us).alias("chunk"))
    near = own.withColumn("before", F.lag("ts_us").over(Window.partitionBy("source_id", "chunk").orderBy("ts_us", "seq")))
    ends = own.groupBy("source_id", "chunk").agg(F.max("ts_us").alias("last"))
    carried = ends.select("source_id", "chunk", F.lag("last").over(Window.partitionBy("source_id").orderBy("chunk")).alias("carried"))
    same = F.col("n.source_id").eqNullSafe(F.col("c.source_id")) & (F.col("n.chunk") == F.col("c.chunk"))
    both = near.alias("n").join(carried.alias("c"), same).select("n.source_id", "n.ts_us", "n.seq", F.coalesce("n.before", "c.carried").alias("before"))
    return both.where(F.col("before").isNull() | (F.col("ts_us") - F.col("before") >= gap_us)).select("source_id", F.col("ts_us").alias("heartbeat_us"), "seq")
