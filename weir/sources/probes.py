"""Batches of packets that remote probes send, from spool files or from any table of messages.

A spool is ``<path>/<probe>/<file>``: a probe appends batches, each behind its length in four bytes (big-endian), and goes on in a file of a greater name. ``spark.read`` takes what is
there; ``spark.readStream`` goes on from a position for each probe, always between batches, so a batch that is still being written waits. Tasks read runs of whole batches
of about ``SPLIT`` bytes, one batch at a time; the driver reads nothing but the lengths of what is new.

A batch that is cut is left out whole, as is one without its header; any version is taken, and bytes behind the last packet are let be.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from . import packets

#: Bytes of a batch's header, of a packet's length and header; probes send Ethernet.
BATCH_HEAD, PACKET_HEAD, LINK = 24, 2 + 16, packets.ETHERNET
SPLIT, ROWS = 32 << 20, 10_000
HEADS = "uuid string, version int, n_packets int, n_truncated int, whole boolean"
NAMES, KINDS = ["source_id", "ts_us", "link_type", "data", "wire_len"], packets.KINDS[:5]


def name_of(uuid: bytes) -> str:
    text = uuid.hex()
    return "-".join((text[:8], text[8:12], text[12:16], text[16:20], text[20:]))


def parse(batch: bytes) -> tuple[str, list[tuple[int, bytes, int, int]]] | None:
    """The probe's name, and of each packet the microseconds, bytes, captured length and length on the wire; None if the batch is cut."""
    if len(batch) < BATCH_HEAD:
        return None
    at, out = BATCH_HEAD, []
    for _ in range(int.from_bytes(batch[2:4])):
        if at + PACKET_HEAD > len(batch):
            return None
        size, s, us, captured, wire = struct.unpack_from(">HIIII", batch, at)
        at += PACKET_HEAD + size
        if at > len(batch):
            return None
        out.append((s * 1_000_000 + us, batch[at - size : at], captured, wire))
    return name_of(batch[8:24]), out


def build(uuid: bytes, rows: Sequence[tuple[int, bytes, int]], version: int = 1, keybit: int = 0) -> bytes:
    """A batch of packets (microseconds, bytes, length on the wire), as probes send it."""
    head = struct.pack(">HHI", version, len(rows), keybit) + uuid
    return head + b"".join(struct.pack(">HIIII", len(data), *divmod(ts, 1_000_000), len(data), wire) + data for ts, data, wire in rows)


def _rows(batches: Iterator[bytes | None]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for batch in batches:
        source, own = parse(batch or b"") or ("", [])
        rows += [(source, ts, LINK, data, wire) for ts, data, _, wire in own]
        size += len(batch or b"")
        if len(rows) >= ROWS or size >= packets.BATCH:
            yield _columns(rows)
            rows, size = [], 0
    yield _columns(rows)


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], names=NAMES)


def packets_of(messages: DataFrame, payload: str = "value") -> DataFrame:
    """The packets of a table or stream of messages (as a queue's reader gives them, in ``payload``); the source is the probe's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _rows(x.as_py() for x in b.column(0))

    return messages.select(payload).mapInArrow(run, packets.PACKETS)


def heads(messages: DataFrame, payload: str = "value") -> DataFrame:
    """One row a message: the probe and what it announces, packets that the probe cut short, and whether the batch is whole. What is missing from a header is null."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.bool_()]

    def head(batch: bytes) -> tuple:
        own = parse(batch)
        if len(batch) < BATCH_HEAD:
            return None, None, None, 0, False
        return name_of(batch[8:24]), int.from_bytes(batch[:2]), int.from_bytes(batch[2:4]), sum(c < w for _, _, c, w in own[1]) if own else 0, own is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [head(x.as_py() or b"") for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * len(kinds), kinds)], names=[c.split()[0] for c in HEADS.split(", ")])

    return messages.select(payload).mapInArrow(run, HEADS)


@dataclass
class Run(InputPartition):
    """Whole batches of a file, from one byte to another."""

    path: str
    start: int
    end: int


class _Spool:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def _listed(self) -> tuple[files.FileSystem, dict[str, list[files.FileInfo]]]:
        """Files with bytes of each probe, by name."""
        fs, root = files.FileSystem.from_uri(self.path)
        found: dict[str, list[files.FileInfo]] = {}
        for info in fs.get_file_info(files.FileSelector(root, allow_not_found=True, recursive=True)):
            probe, _, name = info.path[len(root) :].strip("/").rpartition("/")
            if info.type == files.FileType.File and probe and info.size and name[0] not in "._":
                found.setdefault(probe, []).append(info)
        return fs, {p: sorted(all_, key=lambda i: i.base_name) for p, all_ in found.items()}

    def _runs(self, fs: files.FileSystem, path: str, start: int, size: int) -> Iterator[tuple[int, int]]:
        """Runs of whole batches between two bytes, found by their lengths."""
        with fs.open_input_file(path) as f:
            first = at = start
            while at + 4 <= size:
                end = at + 4 + int.from_bytes(f.read_at(4, at))
                if end > size:
                    break
                at = end
                if at - first >= self.split:
                    yield first, at
                    first = at
            if at > first:
                yield first, at

    def read(self, partition: Run | None) -> Iterator[pa.RecordBatch]:
        """Spark gives None where there is no run at all."""
        if partition is None:
            return
        fs, _ = files.FileSystem.from_uri(self.path)

        def batches() -> Iterator[bytes]:
            with fs.open_input_file(partition.path) as f:
                f.seek(partition.start)
                at = partition.start
                while at < partition.end:
                    if len(head := f.read(4)) < 4:
                        return
                    size = int.from_bytes(head)
                    if len(batch := f.read(size)) < size:
                        return
                    yield batch
                    at += 4 + size

        yield from _rows(batches())


class _BatchReader(_Spool, DataSourceReader):
    def partitions(self) -> list[Run]:
        """A file is a run, as nothing is known of where its batches begin; a cut batch at its end is left out when it is read."""
        _, found = self._listed()
        return [Run(i.path, 0, i.size) for own in found.values() for i in own]


class _StreamReader(_Spool, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.seen: dict[str, list] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The file of each probe that it has come to, and the byte behind the last whole batch there."""
        fs, found = self._listed()
        for probe, own in found.items():
            name, at = self.seen.get(probe, ["", 0])
            if own[-1].base_name < name:
                continue
            start = at if own[-1].base_name == name else 0
            end = max((e for _, e in self._runs(fs, own[-1].path, start, own[-1].size)), default=start)
            self.seen[probe] = [own[-1].base_name, end]
        return {p: list(v) for p, v in self.seen.items()}

    def partitions(self, start: dict, end: dict) -> list[Run]:
        fs, found = self._listed()
        out = []
        for probe, (last, stop) in end.items():
            name, at = start.get(probe, ["", 0])
            for i in found.get(probe, []):
                if name <= i.base_name <= last:
                    size = stop if i.base_name == last else i.size
                    out += [Run(i.path, a, b) for a, b in self._runs(fs, i.path, at if i.base_name == name else 0, size)]
        return out

    def commit(self, end: dict) -> None:
        """Files are left to their owner."""


class ProbeBatches(DataSource):
    """Options: ``split`` (bytes of a task's run)."""

    @classmethod
    def name(cls) -> str:
        return "probe_batches"

    def schema(self) -> str:
        return packets.PACKETS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _BatchReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(dict(self.options))
