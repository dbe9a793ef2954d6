"""Captured packets: pcap files as rows, decoded to TCP segments (``streams`` puts these together).

Files are read by Spark (``binaryFile``), so they can be in any store; a task holds one file at a time. Captures are rotated by
minute and source, which bounds a file.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snappy
from .streams import streams

__all__ = ["between", "read_pcap", "records", "segment", "segments", "streams"]

PACKETS = "source_id string, ts_us long, link_type int, data binary, wire_len long"
FILED = PACKETS + ", file string, at long"
KINDS = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
BATCH = 16 << 20
SEGMENTS = "source_id string, ts_us long, src string, sport int, dst string, dport int, seq long, flags int, payload binary"
#: Magic numbers of pcap files (order of bytes, units of a second), and link types.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
NULL, ETHERNET, RAW, SLL, SLL2 = 0, 1, 101, 113, 276
IPV4, IPV6, TCP = 0x0800, 0x86DD, 6


def records(data: bytes) -> Iterator[tuple[int, int, bytes, int]]:
    """Microseconds, link type, bytes and length on the wire of each whole record; a cut last record is left out."""
    if data[:4] not in MAGIC:
        return
    order, per_us = MAGIC[data[:4]]
    link, at = struct.unpack(order + "I", data[20:24])[0], 24
    while at + 16 <= len(data):
        s, part, kept, wire = struct.unpack_from(order + "IIII", data, at)
        if at + 16 + kept > len(data):
            return
        yield s * 1_000_000 + part // per_us, link, data[at + 16 : at + 16 + kept], wire
        at += 16 + kept


def of_files(files: DataFrame) -> DataFrame:
    """Packets of files (path, content), framed by snappy or plain, with their file and their place in it. A task holds one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                data = content.as_py() or b""
                rows, size = [], 0
                for at, r in enumerate(records(snappy.unframe(data) if data.startswith(snappy.MARK) else data)):
                    rows.append((path.split("/")[-2], *r, path, at))
                    size += len(r[2])
                    if size >= BATCH or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return files.select("path", "content").mapInArrow(run, FILED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names=[c.split()[0] for c in FILED.split(", ")])


def read_pcap(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Packets of the pcap files at ``path``; the source is the name of the file's folder."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    return of_files(reader.format("binaryFile").load(path)).drop("file", "at")


def _network(link: int, data: bytes) -> tuple[int, bytes]:
    """Ethernet type and payload below the link layer."""
    if link == ETHERNET:
        kind, at = int.from_bytes(data[12:14]), 14
        while kind in (0x8100, 0x88A8, 0x9100):
            kind, at = int.from_bytes(data[at + 2 : at + 4]), at + 4
        if kind in (0x8847, 0x8848):
            while at + 4 <= len(data) and not data[at + 2] & 1:
                at += 4
            at += 4
            kind = IPV6 if data[at : at + 1] and data[at] >> 4 == 6 else IPV4
        return kind, data[at:]
    if link == SLL:
        return int.from_bytes(data[14:16]), data[16:]
    if link == SLL2:
        return int.from_bytes(data[0:2]), data[20:]
    payload = data[4:] if link == NULL else data
    return (IPV6 if payload[:1] and payload[0] >> 4 == 6 else IPV4), payload


def segment(link: int, data: bytes) -> tuple | None:
    """Addresses, ports, sequence number, flags and payload of a TCP packet; None for any other."""
    kind, ip = _network(link, data)
    if kind == IPV4 and len(ip) >= 20 and ip[9] == TCP:
        head, size = (ip[0] & 15) * 4, int.from_bytes(ip[2:4])
        src, dst = ".".join(map(str, ip[12:16])), ".".join(map(str, ip[16:20]))
        tcp = ip[head:size] if size else ip[head:]
    elif kind == IPV6 and len(ip) >= 40 and ip[6] == TCP:
        src, dst = ip[8:24].hex(":", 2), ip[24:40].hex(":", 2)
        tcp = ip[40 : 40 + int.from_bytes(ip[4:6])]
    else:
        return None
    if len(tcp) < 20:
        return None
    sport, dport, seq = struct.unpack(">HHI", tcp[:8])
    return src, sport, dst, dport, seq, tcp[13], tcp[(tcp[12] >> 4) * 4 :]


def segments(packets: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, t, *x) for s, t, link, data in zip(*(c.to_pylist() for c in b.columns)) if data and (x := segment(link, data))]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return packets.select("source_id", "ts_us", "link_type", "data").mapInArrow(run, SEGMENTS)


def with_ends(rows: DataFrame) -> DataFrame:
    """The TCP packets among ``rows`` (``FILED``), as they are, with addresses and ports of both ends."""
    names = ["src", "sport", "dst", "dport"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = [segment(link, data) if data is not None else None for link, data in zip(b.column("link_type").to_pylist(), b.column("data").to_pylist())]
            kept = pa.RecordBatch.from_arrays(b.columns, names=b.schema.names).filter(pa.array([e is not None for e in ends], pa.bool_()))
            own = list(zip(*(e[:4] for e in ends if e is not None))) or [()] * 4
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(own, (pa.string(), pa.int32()) * 2))], names=[*kept.schema.names, *names])

    return rows.mapInArrow(run, FILED + ", src string, sport int, dst string, dport int")


def between(packets: DataFrame, a: tuple[str, int], b: tuple[str, int]) -> DataFrame:
    """Segments of one connection, in either direction, by time."""
    def end(name: str, port: str, x: tuple[str, int]):
        return (F.col(name) == x[0]) & (F.col(port) == x[1])

    out = segments(packets)
    return out.where((end("src", "sport", a) & end("dst", "dport", b)) | (end("src", "sport", b) & end("dst", "dport", a))).orderBy("ts_us", "seq")
