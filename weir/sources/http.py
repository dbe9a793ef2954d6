"""HTTP messages in streams of bytes: header blocks, chunked and measured bodies, compression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MESSAGES = "source_id string, src string, sport int, dst string, dport int, first_us long, seq int, kind string, method string, uri string, status int, headers array<struct<name:string,value:string>>, body binary"
#: Fixed value: methods that begin a request.
METHODS = (b"GET ", b"POST ", b"PUT ", b"PATCH ", b"DELETE ", b"HEAD ", b"OPTIONS ")
#: A header block longer than this is no HTTP.
MOST_HEADER = 1 << 20


def decoded(body: bytes, encoding: str) -> bytes:
    """A body as it was before gzip or deflate; other encodings and broken data stay as they are."""
    bits = {"gzip": 31, "x-gzip": 31, "deflate": 15}.get(encoding.strip().lower())
    if bits is None:
        return body
    try:
        return zlib.decompressobj(bits).decompress(body)
    except zlib.error:
        return body


def _chunked(data: bytes, at: int) -> tuple[bytes, int, bool]:
    """The body of chunks from ``at`` on, where it ends, and whether it does; what is there if it is cut."""
    out: list[bytes] = []
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            return b"".join(out), len(data), False
        try:
            size = int(data[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return b"".join(out), end + 2, True
        if size == 0:
            done = data.find(b"\r\n\r\n", end)
            return b"".join(out), len(data) if done < 0 else done + 4, done >= 0
        out.append(data[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
        if at > len(data):
            return b"".join(out), len(data), False


Message = tuple[str, str | None, str | None, int | None, list[tuple[str, str]], bytes]


def scan(data: bytes, at: int = 0) -> tuple[Message | None, int, bool, int] | None:
    """The next message from ``at`` on with what there is of it, where it ends, whether it is whole, and if not, up to where data is needed at least.

    Bytes before its start line are skipped; None without one. No message, and the place of the start line, if its headers are cut.
    """
    while not data.startswith((*METHODS, b"HTTP/1."), at):
        starts = [p for m in (*METHODS, b"HTTP/1.") if (p := data.find(b"\r\n" + m, at)) >= 0]
        if not starts:
            return None
        at = min(starts) + 2
    end = data.find(b"\r\n\r\n", at, at + MOST_HEADER)
    if end < 0:
        return None, at, False, len(data) + 1
    first, *rest = data[at:end].decode("latin-1").split("\r\n")
    headers = [(n.strip(), v.strip()) for n, sep, v in (x.partition(":") for x in rest) if sep]
    known = {n.lower(): v for n, v in reversed(headers)}
    words = first.split(" ", 2)
    answer = first.startswith("HTTP/")
    status = int(words[1]) if answer and len(words) > 1 and words[1].isdigit() else None
    at = end + 4
    body, whole, need = b"", True, at
    if "chunked" in known.get("transfer-encoding", "").lower():
        body, at, whole = _chunked(data, at)
        need = len(data) + 1
    elif known.get("content-length", "").isdigit():
        need = at + int(known["content-length"])
        body, at, whole = data[at:need], need, need <= len(data)
    elif answer and status not in (204, 304) and not (status or 0) // 100 == 1:
        body, at, whole, need = data[at:], len(data), False, 1 << 62  # until the connection ends
    kind = "response" if answer else "request"
    return (kind, None if answer else words[0], None if answer or len(words) < 2 else words[1], status, headers, decoded(body, known.get("content-encoding", ""))), at, whole, need


def messages(data: bytes) -> Iterator[Message]:
    """Kind, method, URI, status, headers and body of each message; bytes before the next start line are skipped."""
    at = 0
    while at < len(data) and (got := scan(data, at)) and got[0]:
        yield got[0]
        at = got[1]


def parse(streams: DataFrame) -> DataFrame:
    """The messages of each stream (as ``packets.streams`` makes them), numbered in order."""
    kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])), pa.binary()]
    names = ["source_id", "src", "sport", "dst", "dport", "first_us", "seq", "kind", "method", "uri", "status", "headers", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for *key, data in zip(*(c.to_pylist() for c in b.columns)):
                rows = [(*key, k, kind, method, uri, status, [{"name": n, "value": v} for n, v in headers], body) for k, (kind, method, uri, status, headers, body) in enumerate(messages(data or b""))]
                columns = list(zip(*rows)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return streams.select("source_id", "src", "sport", "dst", "dport", "first_us", "data").mapInArrow(run, MESSAGES)
