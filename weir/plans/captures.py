"""Queries over captured packets: dumps written and read back, sweeps of dump files, batches of remote probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import bridge, dumps, packets, probes, shared
from .traffic import query

#: A packet for each span: a TCP segment of its request line between its two ends; each tenth row is a heartbeat.
_PACKETS_SQL = f"""{bridge.SPANS_SQL},
packets AS (SELECT source_id, client_ip, client_port, server_ip, server_port, request_us, request_us // 60000000 AS minute, octet_length(encode(request_path)) + 54 AS bytes, request_path FROM spans WHERE CAST(id AS BIGINT) % 10 <> 0)"""


def _be(value, size: int):
    """Bytes of a number, the greatest first."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), size * 2, "0"))


def _ip(column: str):
    parts = F.split(column, r"\.")
    return F.concat(*(_be(F.get(parts, F.lit(k)), 1) for k in range(4)))


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = bridge.spans(spark, sf_dir)
    body = F.encode("request_path", "utf-8")
    size = F.octet_length(body)
    # Ethernet; IPv4 with its length, time to live and protocol; TCP with ports, numbers and a header of five words
    ip = F.concat(F.lit(b"\x45\x00"), _be(size + 40, 2), F.lit(b"\0\0\0\0\x40\x06\0\0"), _ip("client_ip"), _ip("server_ip"))
    tcp = F.concat(_be(F.col("client_port"), 2), _be(F.col("server_port"), 2), F.lit(b"\0\0\0\1\0\0\0\0\x50\x18\0\0\0\0\0\0"))
    frame = F.concat(F.lit(b"\0" * 12 + b"\x08\0"), ip, tcp, body)
    beat = F.col("id").cast("long") % 10 == 0
    return spans.select("source_id", F.col("request_us").alias("ts_us"), F.lit(packets.ETHERNET).alias("link_type"), F.when(beat, F.lit(dumps.HEARTBEAT)).otherwise(frame).alias("data"))


@query(f"""WITH {_PACKETS_SQL} SELECT source_id, minute, client_ip, server_ip, server_port, count(*) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes, min(request_us) AS first_us, max(request_us) AS last_us,
CAST(count(*) FILTER (request_path = '/v1/messages') AS BIGINT) AS messages FROM packets GROUP BY ALL""")
def packet_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets dumped to framed minute files, read back and decoded."""
    folder = shared.folder(spark, "packet_dumps")
    dumps.dump(_sent(spark, sf_dir), folder)
    own = packets.segments(packets.read_pcap(spark, f"{folder}/*"))
    by = own.groupBy("source_id", F.floor(F.col("ts_us") / dumps.MINUTE_US).cast("long").alias("minute"), F.col("src").alias("client_ip"), F.col("dst").alias("server_ip"), F.col("dport").alias("server_port"))
    return by.agg(
        F.count("*").alias("packets"), F.sum(F.octet_length("payload") + 54).alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
        F.count(F.when(F.col("payload") == F.lit(b"/v1/messages"), 1)).alias("messages"),
    )


@query("""WITH f AS (SELECT concat('src-', CAST(o_custkey % 3 AS VARCHAR), '/', CAST(o_orderkey AS VARCHAR)) AS path, epoch_us(o_orderdate) // 60000000 AS minute, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 7 <> 0),
n AS (SELECT max(minute) AS now, CAST(sum(bytes) // 3 AS BIGINT) AS room FROM f), s AS (SELECT path, minute, bytes, minute < now - 24 * 1500 * 60 AS old, room FROM f, n WHERE minute < now - 1),
r AS (SELECT *, coalesce(sum(CASE WHEN old THEN 0 ELSE bytes END) OVER (ORDER BY minute DESC, path DESC ROWS UNBOUNDED PRECEDING), 0) AS newer FROM s)
SELECT path, minute, bytes, old FROM r WHERE old OR newer > room""")
def dump_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files go: an order is a dump file of its day, a seventh of them belongs to others."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)")
    minute = F.when(F.col("o_orderkey") % 7 != 0, F.floor(us / dumps.MINUTE_US).cast("long"))
    files = bridge.read(spark, sf_dir, "orders").select(F.concat(F.lit("src-"), (F.col("o_custkey") % 3).cast("string"), F.lit("/"), F.col("o_orderkey").cast("string")).alias("path"), minute.alias("minute"), F.floor("o_totalprice").cast("long").alias("bytes"))
    last, all_ = files.where("minute is not null").agg(F.max("minute"), F.sum("bytes")).first()
    hours = 24 * 1500
    gone = dumps.doomed(files, (last or 0) * dumps.MINUTE_US, hours, (all_ or 0) // 3)
    return gone.withColumn("old", F.col("minute") < (last or 0) - hours * 60)


@query("""WITH o AS (SELECT l_orderkey, epoch_us(l_shipdate) AS ts_us, octet_length(encode(concat(l_returnflag, CAST(l_partkey AS VARCHAR)))) AS size, CAST(l_quantity AS BIGINT) AS wire, l_linenumber FROM lineitem),
b AS (SELECT l_orderkey, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, CAST(count(*) FILTER (size < wire) AS BIGINT) AS cut, min(ts_us) AS first_us, max(ts_us) AS last_us FROM o GROUP BY 1)
SELECT concat(lower(lpad(hex(l_orderkey % 100), 8, '0')), '-0000-0000-0000-000000000000') AS source_id, count(*) AS batches, CAST(sum(CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS whole_batches, CAST(coalesce(sum(CASE WHEN l_orderkey % 9 <> 0 THEN n END), 0) AS BIGINT) AS packets,
CAST(coalesce(sum(CASE WHEN l_orderkey % 9 <> 0 THEN bytes END), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(CASE WHEN l_orderkey % 9 <> 0 THEN cut END), 0) AS BIGINT) AS truncated, min(first_us) FILTER (l_orderkey % 9 <> 0) AS first_us, max(last_us) FILTER (l_orderkey % 9 <> 0) AS last_us FROM b GROUP BY 1""")
def probe_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a batch of its lines, sent by one of a hundred probes; each ninth batch comes without its last byte."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', l_shipdate)")
    body, key = F.encode(F.concat("l_returnflag", F.col("l_partkey").cast("string")), "utf-8"), F.col("l_orderkey")
    size = F.octet_length(body)
    packet = F.concat(_be(size, 2), _be(F.floor(us / 1_000_000), 4), _be(us % 1_000_000, 4), _be(size, 4), _be(F.greatest(size, F.col("l_quantity").cast("long")), 4), body)
    lines = bridge.read(spark, sf_dir, "lineitem").select(key, F.struct("l_linenumber", packet.alias("p")).alias("p"))
    sent = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("p")).alias("p"))
    whole = F.concat(F.lit(b"\0\1"), _be(F.size("p"), 2), F.lit(b"\0\0\0\0"), _be(key % 100, 4), F.lit(b"\0" * 12), F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["p"])), "")))
    messages = sent.select(F.when(key % 9 == 0, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole).alias("value"))
    heads = probes.heads(messages).groupBy(F.col("uuid").alias("source_id")).agg(F.count("*").alias("batches"), F.count(F.when(F.col("whole"), 1)).alias("whole_batches"), F.sum("n_truncated").alias("truncated"))
    rows = probes.packets_of(messages).groupBy("source_id").agg(F.count("*").alias("packets"), F.sum(F.octet_length("data")).alias("bytes"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    out = heads.join(rows, "source_id", "left")
    return out.select("source_id", "batches", "whole_batches", F.coalesce("packets", F.lit(0)).alias("packets"), F.coalesce("bytes", F.lit(0)).alias("bytes"), "truncated", "first_us", "last_us")
