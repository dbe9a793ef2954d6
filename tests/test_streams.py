"""Streams of bytes from shuffled, doubled and cut segments, and HTTP messages over any cuts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.sources import http, packets, streams

FIRST = (2**32) - 3_000  # numbers wrap
S = 1_000_000


def _rows(segs, port=4000):
    return [("probe", at, "10.0.0.1", port, "10.0.0.2", 80, seq % 2**32, flags, bytes(data)) for at, seq, flags, data in segs]


def _pieces(spark, rows, slice_bytes):
    got = streams.streams(spark.createDataFrame(rows, packets.SEGMENTS).repartition(5), slice_bytes).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.sport, r.incarnation, r.run, r.slice)):
        out.setdefault((r.sport, r.incarnation, r.run), []).append(bytes(r.data))
        assert len(r.data) < slice_bytes + 2_000
    return {k: b"".join(v) for k, v in out.items()}, len(got)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 1_000])
def test_shuffled_doubled_and_cut_segments_give_the_same_bytes(spark, slice_bytes):
    rng = random.Random(slice_bytes)
    data = rng.randbytes(40_000)
    segs, at = [], 0
    while at < len(data):
        size = rng.randint(1, 900)
        segs.append((at, data[at : at + size]))
        at += size
    segs += [(s, d[: rng.randint(1, len(d))]) for s, d in rng.sample(segs, 20)] + [(s - 10, data[max(s - 10, 0) : s + 30]) for s, _ in rng.sample(segs[1:], 20) if s > 10]
    # sent over three minutes, each a little early or late
    sent = [(int((s / len(data) * 180 + rng.random()) * S) + S, FIRST + 1 + s, 16, d) for s, d in segs]
    rows = _rows([(0, FIRST, 2, b""), (5, FIRST, 2, b""), *sent])
    got, n = _pieces(spark, rows, slice_bytes)
    assert got == {(4000, 1, 0): data} and n == -(-40_000 // slice_bytes)


def test_holes_resets_and_silence_begin_anew(spark):
    rows = _rows([(S, 100, 16, b"abc"), (2 * S, 110, 16, b"later"), (3 * S, 103, 16, b"d"), (4 * S, 115, 4, b""), (5 * S, 9, 16, b"new"), (200 * S, 12, 16, b"after silence"), (201 * S, 5_000, 2, b""), (202 * S, 5_001, 16, b"again")])
    rows += _rows([(S, 0, 16, b"other")], 4001)
    got, _ = _pieces(spark, rows, 1 << 20)
    assert got == {(4000, 1, 0): b"abcd", (4000, 1, 1): b"later", (4000, 2, 0): b"new", (4000, 3, 0): b"after silence", (4000, 4, 0): b"again", (4001, 1, 0): b"other"}
    assert streams.streams(spark.createDataFrame([], packets.SEGMENTS)).count() == 0


WHOLE = (
    b"garbage\r\nPOST /v1/messages HTTP/1.1\r\nContent-Length: 5\r\n\r\nhelloGET /x HTTP/1.1\r\nHost: h\r\n\r\n"
    b"POST /c HTTP/1.1\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nwiki\r\n6;x=1\r\npedia \r\n0\r\n\r\nHTTP/1.1 204 No\r\n\r\nHTTP/1.1 200 OK\r\nContent-Type: text/event-stream\r\n\r\ndata: a\n\ndata: b\n\n"
)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, len(WHOLE)), max_size=12))
def test_any_cuts_give_the_messages_of_the_whole(cuts):
    state, got = streams.Messages(), []
    ends = sorted({*cuts, len(WHOLE)})
    for a, b in zip([0, *ends], ends):
        got += state.feed(WHOLE[a:b])
    assert got + list(state.end()) == list(http.messages(WHOLE)) and len(list(http.messages(WHOLE))) == 5


@pytest.mark.parametrize("slice_bytes", [1 << 20, 16])
def test_messages_of_pieces_with_a_hole(spark, slice_bytes):
    sent, at = [], 0
    second = b"POST /lost HTTP/1.1\r\nContent-Length: 400\r\n\r\n" + b"x" * 100
    third = b"tail of what was lost\r\nGET /back HTTP/1.1\r\n\r\n"
    for data, skip in ((WHOLE[:150], 0), (WHOLE[150:203], 0), (second, 0), (third, 300)):
        at += skip
        sent += [(at + k, data[k : k + 40]) for k in range(0, len(data), 40)]
        at += len(data)
    rows = _rows([(S + k, FIRST + s, 16, d) for k, (s, d) in enumerate(sent)])
    pieces = streams.streams(spark.createDataFrame(rows, packets.SEGMENTS).repartition(4), slice_bytes)
    got = sorted((r.seq, r.kind, r.method, r.uri, len(r.body)) for r in streams.messages(pieces).collect())
    whole = [(m[0], m[1], m[2], len(m[5])) for m in http.messages(WHOLE[:203])]
    assert [g[1:] for g in got] == [*whole[:-1], *[(m[0], m[1], m[2], len(m[5])) for m in http.messages(WHOLE[:203] + second)][len(whole) - 1 :], ("request", "GET", "/back", 0)]
