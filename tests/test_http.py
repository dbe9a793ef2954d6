"""HTTP messages in streams."""

import gzip
import zlib

from weir.sources import http


def test_messages_of_a_stream():
    packed = gzip.compress(b"hello")
    data = (
        b"junk\r\nPOST /v1/x HTTP/1.1\r\nContent-Length: 3\r\nX-A: 1\r\nx-a: 2\r\n\r\nabc"
        b"GET / HTTP/1.1\r\n\r\n"
        b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4;x=y\r\nWiki\r\n5\r\npedia\r\n0\r\n\r\n"
        b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Length: %d\r\n\r\n%s"
        b"HTTP/1.1 204 No\r\n\r\n"
        b"HTTP/1.1 200 OK\r\n\r\nto the end"
    ) % (len(packed), packed)
    got = list(http.messages(data))
    assert [(m[0], m[1], m[2], m[3], m[5]) for m in got] == [
        ("request", "POST", "/v1/x", None, b"abc"), ("request", "GET", "/", None, b""), ("response", None, None, 200, b"Wikipedia"),
        ("response", None, None, 200, b"hello"), ("response", None, None, 204, b""), ("response", None, None, 200, b"to the end"),
    ]
    assert got[0][4] == [("Content-Length", "3"), ("X-A", "1"), ("x-a", "2")]
    assert list(http.messages(b"")) == [] and list(http.messages(b"nothing here")) == []
    assert http.decoded(zlib.compress(b"x"), "deflate") == b"x" and http.decoded(b"bad", "gzip") == b"bad" and http.decoded(b"x", "br") == b"x"


def test_messages_as_rows(spark):
    rows = [("s", "a", 1, "b", 80, 5, b"GET /p HTTP/1.1\r\nHost: h\r\n\r\n"), ("s", "b", 80, "a", 1, 6, None)]
    table = spark.createDataFrame(rows, "source_id string, src string, sport int, dst string, dport int, first_us long, data binary")
    got = http.parse(table).collect()
    assert [(r.kind, r.method, r.uri, r.headers[0].name) for r in got] == [("request", "GET", "/p", "Host")]
