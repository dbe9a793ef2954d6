"""Packets kept as pcap files by source and minute: written by a data source (batch or stream), read back by range, swept by age and size.

A file is ``<folder>/<source>/<minute>-<job>-<n>.pcap`` (``.snappy`` when framed), the minute as ``yyyyMMddTHHmm`` in UTC; plain ``<minute>.pcap`` is read, too. Before writing,
packets are rebalanced by source and minute, so a hot minute becomes several files and no task holds it; a file rolls at ``ROLL`` bytes. Tasks write below ``_going-<job>``, which
readers do not see; the commit moves whole files to their places and removes what lost tasks left. A micro-batch that is done again replaces its own files.

Files are reached through Arrow's file systems for writing and deleting, through Spark's readers for reading. Heartbeats, and rows without source, time or bytes, are not
kept. A source's folder name has ``_`` for anything but letters, digits, ``.``, ``_`` and ``-``; as Spark hides names that begin with ``.`` or ``_``, these get a ``-`` in front.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from . import packets, snappy

#: Version and snap length in the head of a file, the minute, the link type of an empty extract.
VERSION, SNAP_LENGTH, MINUTE_US, EMPTY_LINK = (2, 4), 262_144, 60_000_000, 1
#: Fixed value: an Ethernet header that marks a heartbeat.
HEARTBEAT = b"\0" * 12 + b"\xff\xff"
ROLL, CHUNK, MOVERS = 64 << 20, 1 << 20, 16
COLUMNS = ["source_id", "minute", "link_type", "ts_us", "wire_len", "data"]
LABEL = r"^(\d{8}T\d{4})(?:-[\w-]+)?\.pcap(?:\.snappy)?$"


def head(link_type: int) -> bytes:
    return struct.pack("<IHHiIII", 0xA1B2C3D4, *VERSION, 0, 0, SNAP_LENGTH, link_type)


def record(ts_us: int, wire_len: int, data: bytes) -> bytes:
    return struct.pack("<IIII", ts_us // 1_000_000 & 0xFFFFFFFF, ts_us % 1_000_000, len(data), wire_len) + data


def folder_of(source: Column) -> Column:
    """The name of a source's folder; null where it can have none."""
    safe = F.regexp_replace(source, "[^A-Za-z0-9._-]", "_")
    return F.when(safe.isin("", ".", ".."), F.lit(None)).when(safe.rlike("^[._]"), F.concat(F.lit("-"), safe)).otherwise(safe)


def label_of(minute: Column) -> Column:
    return F.date_format(F.timestamp_seconds(minute * 60), "yyyyMMdd'T'HHmm")


def minute_of(name: Column) -> Column:
    """The minute since 1970 that a file's name begins with; null for files of others."""
    found = F.regexp_extract(name, LABEL, 1)
    return F.when(found != "", F.floor(F.unix_timestamp(F.try_to_timestamp(found, F.lit("yyyyMMdd'T'HHmm"))) / 60).cast("long"))


def is_heartbeat(link_type: Column, data: Column) -> Column:
    return (link_type == packets.ETHERNET) & (F.substring(data, 1, len(HEARTBEAT)) == F.lit(HEARTBEAT))


def _kept(rows: DataFrame) -> DataFrame:
    wire = F.col("wire_len") if "wire_len" in rows.columns else F.octet_length("data")
    own = rows.select(
        folder_of(F.col("source_id")).alias("source_id"), F.floor(F.col("ts_us") / MINUTE_US).cast("long").alias("minute"), F.col("link_type").cast("int").alias("link_type"), F.col("ts_us").cast("long").alias("ts_us"),
        F.coalesce(wire, F.octet_length("data")).cast("long").alias("wire_len"), F.col("data").cast("binary").alias("data"),
    )
    return own.where("source_id is not null and minute is not null and link_type is not null and data is not null").where(~is_heartbeat(F.col("link_type"), F.col("data")))


def by_minute(rows: DataFrame) -> DataFrame:
    """The packets to keep, near their own kind and in order."""
    return _kept(rows).hint("rebalance", F.col("source_id"), F.col("minute")).sortWithinPartitions("source_id", "minute", "link_type", "ts_us")


def dump(rows: DataFrame, folder: str, compression: str = "snappy") -> None:
    """Adds the packets (``packets.PACKETS``; ``wire_len`` may be missing) to the files below ``folder``."""
    rows.sparkSession.dataSource.register(PacketDump)
    by_minute(rows).write.format("packet_dump").mode("append").option("compression", compression).save(folder)


def dump_stream(rows: DataFrame, folder: str, checkpoint: str, name: str = "stream", compression: str = "snappy", **trigger):
    """The same for a stream; ``name`` tells apart streams into one folder."""
    rows.sparkSession.dataSource.register(PacketDump)
    return _kept(rows).writeStream.format("packet_dump").option("checkpointLocation", checkpoint).option("compression", compression).option("job", name).trigger(**trigger).start(folder)


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where they are now, the source's folder, and how their names begin."""

    files: list[tuple[str, str, str]]


class _Writer:
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.framed, self.job, self.roll = options["path"], options.get("compression", "snappy") == "snappy", options.get("job", ""), int(options.get("roll", ROLL))
        if options.get("compression", "snappy") not in ("snappy", "none"):
            raise ValueError("compression is snappy or none")
        self.run = uuid.uuid4().hex[:12]

    def _open(self) -> tuple[files.FileSystem, str, str]:
        fs, root = files.FileSystem.from_uri(self.folder)
        return fs, root, f"{root}/_going-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, _, going = self._open()
        fs.create_dir(going, recursive=True)
        done, key, out, pending, size = [], None, None, [], 0

        def flush(last: bool = False) -> None:
            """Whole chunks of what waits, or all of it."""
            nonlocal pending
            data = b"".join(pending)
            cut = len(data) if last else len(data) - len(data) % snappy.BLOCK
            for k in range(0, cut, snappy.BLOCK):
                block = data[k : min(k + snappy.BLOCK, cut)]
                out.write(snappy.chunk(block) if self.framed else block)
            pending = [data[cut:]] if cut < len(data) else []

        def close() -> None:
            if out is not None:
                flush(last=True)
                out.close()

        try:
            waiting = 0
            for b in batches:
                for source, minute, link, ts, wire, data in zip(*(b.column(c).to_pylist() for c in COLUMNS)):
                    if (source, minute, link) != key or size >= self.roll:
                        close()
                        key, size, waiting, path = (source, minute, link), 0, 0, f"{going}/{uuid.uuid4().hex}"
                        out = fs.open_output_stream(path)
                        if self.framed:
                            out.write(snappy.MARK)
                        pending = [head(link)]
                        done.append((path, source, _label(minute)))
                    pending.append(record(ts, wire, data))
                    size += 16 + len(data)
                    waiting += 16 + len(data)
                    if waiting >= 16 * snappy.BLOCK:
                        flush()
                        waiting = 0
        finally:
            close()
        return Written(done)

    def _place(self, messages: list[Written | None], job: str, again: bool) -> None:
        """Moves whole files to their places; with ``again``, in place of those of the same job."""
        fs, root, going = self._open()
        all_ = sorted(f for m in messages if m is not None for f in m.files)
        for source in sorted({s for _, s, _ in all_}):
            fs.create_dir(f"{root}/{source}", recursive=True)
            if again:
                for info in fs.get_file_info(files.FileSelector(f"{root}/{source}")):
                    if f"-{job}-" in info.base_name:
                        fs.delete_file(info.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            list(pool.map(lambda nf: fs.move(nf[1][0], f"{root}/{nf[1][1]}/{nf[1][2]}-{job}-{nf[0]:06d}.pcap{'.snappy' if self.framed else ''}"), enumerate(all_)))
        self._drop(fs, going)

    def _drop(self, fs: files.FileSystem, going: str) -> None:
        if fs.get_file_info(going).type == files.FileType.Directory:
            fs.delete_dir(going)


def _label(minute: int) -> str:
    from datetime import datetime, timedelta

    return (datetime(1970, 1, 1) + timedelta(minutes=minute)).strftime("%Y%m%dT%H%M")


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._place(messages, self.run, again=False)

    def abort(self, messages: list[Written | None]) -> None:
        fs, _, going = self._open()
        self._drop(fs, going)


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._place(messages, f"{self.job or 'stream'}-b{batchId:010d}", again=True)

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        fs, _, going = self._open()
        self._drop(fs, going)


class PacketDump(DataSource):
    """Options: ``compression`` (snappy or none), ``roll`` (bytes of a file), ``job`` (name of a stream)."""

    @classmethod
    def name(cls) -> str:
        return "packet_dump"

    def schema(self) -> str:
        return "source_id string, minute long, link_type int, ts_us long, wire_len long, data binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        self._check(schema, overwrite)
        return _BatchWriter(dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        self._check(schema, overwrite)
        return _StreamWriter(dict(self.options))

    def _check(self, schema: StructType, overwrite: bool) -> None:
        if overwrite:
            raise ValueError("packets are only appended; sweep deletes")
        if missing := [c for c in COLUMNS if c not in schema.names]:
            raise ValueError(f"columns missing: {missing}")


def _listed(spark: SparkSession, folder: str, **options: str) -> DataFrame | None:
    """Files below a folder, which may not be there yet."""
    try:
        return spark.read.format("binaryFile").options(**options).load(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read(spark: SparkSession, folder: str, source: str, start_us: int, end_us: int) -> DataFrame:
    """Packets of a source in a range of times, both ends included. Only the files of its minutes are opened."""
    safe = spark.range(1).select(folder_of(F.lit(source))).first()[0]
    none = spark.createDataFrame([], packets.FILED)
    if safe is None:
        return none
    if (own := _listed(spark, f"{folder}/{safe}", pathGlobFilter="*.pcap*")) is None:
        return none
    label = F.substring("_metadata.file_name", 1, 13)
    own = own.where((label >= _label(start_us // MINUTE_US)) & (label <= _label(end_us // MINUTE_US)))
    return packets.of_files(own).where(F.col("ts_us").between(start_us, end_us))


def extract(spark: SparkSession, folder: str, source: str, start_us: int, end_us: int, client: tuple[str | None, int | None] = (None, None), server: tuple[str | None, int | None] = (None, None)) -> DataFrame:
    """TCP packets of a range between two ends, in either direction and by time; None stands for any address or port."""
    own = packets.with_ends(read(spark, folder, source, start_us, end_us))

    def goes(a: tuple[str, str], b: tuple[str, str]) -> Column:
        out = F.lit(True)
        for column, value in zip((*a, *b), (*client, *server)):
            out = out & (F.col(column) == value) if value is not None else out
        return out

    there, back = (("src", "sport"), ("dst", "dport")), (("dst", "dport"), ("src", "sport"))
    return own.where(goes(*there) | goes(*back)).orderBy("ts_us", "file", "at")


def pcap_chunks(rows: DataFrame) -> DataFrame:
    """A pcap file in chunks of about a MiB: ``data`` in order of (part, n), the head first. Packets in order of time stay in it, over as many tasks as sorted them.
    Packets of several link types fail, as a file has one."""
    links = [r[0] for r in rows.select("link_type").distinct().limit(2).collect()]
    if len(links) > 1:
        raise ValueError(f"link types differ: {sorted(links)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, pending, size = TaskContext.get().partitionId(), 0, [], 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([b"".join(pending)], pa.binary())], names=["part", "n", "data"])

        for b in batches:
            for ts, wire, data in zip(*(c.to_pylist() for c in b.columns)):
                pending.append(record(ts, wire, data))
                size += len(pending[-1])
                if size >= CHUNK:
                    yield give()
                    n, pending, size = n + 1, [], 0
        if pending:
            yield give()

    first = rows.sparkSession.range(1).select(F.lit(-1).alias("part"), F.lit(0).alias("n"), F.lit(head(links[0] if links else EMPTY_LINK)).alias("data"))
    return first.unionByName(rows.select("ts_us", "wire_len", "data").mapInArrow(run, "part int, n int, data binary"))


def dumped(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder``: path, minute (null for those of others), bytes. No file is opened."""
    own = _listed(spark, folder, recursiveFileLookup="true")
    if own is None:
        own = spark.createDataFrame([], "path string, length long")
    return own.select("path", minute_of(F.element_at(F.split("path", "/"), -1)).alias("minute"), F.col("length").alias("bytes"))


def doomed(kept: DataFrame, now_us: int, max_age_hours: int = 0, max_bytes: int = 0) -> DataFrame:
    """Files to delete: those older than the age, then the oldest of the rest until all fit. Zero stands for no limit. The current minute and the one before are never
    touched, and do not count.

    What newer files take is added up by day first, then over the days' totals, so no task sees all files."""
    now = now_us // MINUTE_US
    own = kept.where(F.col("minute") < now - 1)
    old = F.col("minute") < now - max_age_hours * 60 if max_age_hours > 0 else F.lit(False)
    if max_bytes <= 0:
        return own.where(old).select("path", "minute", "bytes")
    own = own.withColumns({"old": old, "day": F.floor(F.col("minute") / 1440)}).withColumn("left", F.when(F.col("old"), 0).otherwise(F.col("bytes")))
    days = own.groupBy("day").agg(F.sum("left").alias("left"))
    later = days.select("day", F.coalesce(F.sum("left").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("later"))
    within = F.sum("left").over(Window.partitionBy("day").orderBy(F.desc("minute"), F.desc("path")).rowsBetween(Window.unboundedPreceding, 0))
    out = own.withColumn("within", within).join(later, "day")
    return out.where(F.col("old") | (F.col("later") + F.col("within") > max_bytes)).select("path", "minute", "bytes")


def sweep(spark: SparkSession, folder: str, now_us: int, max_age_hours: int = 0, max_size_mb: int = 0) -> tuple[int, int, int]:
    """Deletes what is ``doomed`` and tells files, bytes and failures. Files that are already gone count for nothing; folders stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone, size, failed = 0, 0, 0
            for path, length in zip(*(c.to_pylist() for c in b.columns)):
                fs, at = files.FileSystem.from_uri(path)
                try:
                    fs.delete_file(at)
                    gone, size = gone + 1, size + length
                except FileNotFoundError:
                    pass
                except OSError:
                    failed += 1
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (gone, size, failed)], names=["files", "bytes", "errors"])

    out = doomed(dumped(spark, folder), now_us, max_age_hours, max_size_mb << 20).select("path", "bytes").mapInArrow(run, "files long, bytes long, errors long")
    return tuple(out.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("files", "bytes", "errors"))).first())
