"""Batches of remote probes: parsing, tables of messages, spools read at once and as a stream."""

import random
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weir.sources import packets, probes

ONE, TWO = uuid.UUID(int=1).bytes, uuid.UUID("12345678-9abc-def0-1234-56789abcdef0").bytes
ROW = st.tuples(st.integers(0, 2**32 * 1_000_000 - 1), st.binary(max_size=60), st.integers(0, 2**32 - 1))


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=16, max_size=16), st.lists(ROW, max_size=5), st.integers(0, 2**16 - 1), st.data())
def test_batches_come_back_and_cut_ones_do_not(own, rows, version, data):
    batch = probes.build(own, rows, version, 7)
    name, got = probes.parse(batch)
    assert name == str(uuid.UUID(bytes=own)) and [(t, d, w) for t, d, _, w in got] == rows
    assert probes.parse(batch + b"more")[1] == got
    assert probes.parse(batch[: data.draw(st.integers(0, len(batch) - 1))]) is None


def test_layout():
    # header: version, packets, key, probe; a packet: its length, seconds, microseconds, captured, on the wire
    batch = bytes.fromhex("0002 0001 00000009" + TWO.hex() + "0003 00000005 00000007 00000003 00000040") + b"abc"
    assert probes.parse(batch) == (str(uuid.UUID(bytes=TWO)), [(5_000_007, b"abc", 3, 64)]) and probes.build(TWO, [(5_000_007, b"abc", 64)], 2, 9) == batch


def test_tables_of_messages(spark):
    good = probes.build(ONE, [(10, b"ab", 2), (11, b"cd", 90)])
    rows = [(good,), (good,), (good[:-1],), (probes.build(TWO, []),), (b"short",), (b"",), (None,)]
    df = spark.createDataFrame([(r[0], "clash") for r in rows], "value binary, source_id string").repartition(2)
    got = sorted((r.source_id, r.ts_us, r.link_type, bytes(r.data), r.wire_len) for r in probes.packets_of(df).collect())
    one = str(uuid.UUID(bytes=ONE))
    assert got == sorted([(one, 10, 1, b"ab", 2), (one, 11, 1, b"cd", 90)] * 2)
    heads = sorted(map(str, probes.heads(df).collect()))
    assert heads == sorted(map(str, [*[spark_row(one, 1, 2, 1, True)] * 2, spark_row(one, 1, 2, 0, False), spark_row(str(uuid.UUID(bytes=TWO)), 1, 0, 0, True), *[spark_row(None, None, None, 0, False)] * 3]))
    assert probes.packets_of(df.where("false")).count() == probes.heads(df.where("false")).count() == 0


def spark_row(*values):
    from pyspark.sql import Row

    return Row(**dict(zip([c.split()[0] for c in probes.HEADS.split(", ")], values)))


def _append(path, *batches):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("ab") as f:
        f.write(b"".join(len(b).to_bytes(4) + b for b in batches))


@pytest.mark.parametrize("split", [1, 1 << 20])
def test_a_spool_as_a_stream_and_at_once(spark, tmp_path, split):
    spark.dataSource.register(probes.ProbeBatches)
    rng, sent, spool, out = random.Random(split), [], tmp_path / "spool", tmp_path / "out"

    def batch(n):
        rows = [(rng.randrange(10**12), rng.randbytes(rng.randrange(50)), rng.randrange(2000)) for _ in range(n)]
        sent.extend((t, d, w) for t, d, w in rows)
        return probes.build(ONE, rows)

    def run():
        stream = spark.readStream.format("probe_batches").option("split", split).load(str(spool))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
        assert q.awaitTermination(120) is not False
        return sorted((r.ts_us, bytes(r.data), r.wire_len) for r in spark.read.schema(packets.PACKETS).parquet(str(out)).collect())

    _append(spool / "a" / "0001", *(batch(3) for _ in range(5)))
    _append(spool / "b" / "0001", batch(2))
    (spool / "a" / ".0009").write_bytes(b"\0\0\0\1x")
    assert run() == sorted(sent)
    late = batch(4)
    framed = len(late).to_bytes(4) + late
    with (spool / "b" / "0001").open("ab") as f:
        f.write(framed[:40])
    waiting, sent[:] = sent[-4:], sent[:-4]
    assert run() == sorted(sent)  # a batch that is still being written waits
    with (spool / "b" / "0001").open("ab") as f:
        f.write(framed[40:])
    sent += waiting
    _append(spool / "b" / "0002", batch(1), probes.build(ONE, [(1, b"cut", 3)])[:-1], batch(2))
    _append(spool / "a" / "0001", batch(2))
    assert run() == sorted(sent) and run() == sorted(sent)
    whole = spark.read.format("probe_batches").load(str(spool))
    assert sorted((r.ts_us, bytes(r.data), r.wire_len) for r in whole.collect()) == sorted(sent)
    assert spark.read.format("probe_batches").load(str(tmp_path / "nothing")).count() == 0
