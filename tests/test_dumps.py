"""Packet dumps: framing, minute files, ranges read back, bytes of a merged capture, sweeps by age and size."""

import random
import struct
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from weir.sources import dumps, packets, snappy

S, M = 1_000_000, 60_000_000
T0 = 1_777_987_800 * S  # 2026-05-05 13:30 UTC


def _tcp(src, sport, dst, dport, payload=b"x"):
    ip4 = lambda a: bytes(map(int, a.split(".")))
    tcp = struct.pack(">HHIIBBHHH", sport, dport, 1, 0, 5 << 4, 16, 0, 0, 0) + payload
    return b"\0" * 12 + b"\x08\x00" + struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(tcp), 0, 0, 64, 6, 0) + ip4(src) + ip4(dst) + tcp


def _rows(rng, n):
    ends = [("10.0.0.1", 4000, "10.0.0.2", 80), ("10.0.0.2", 80, "10.0.0.1", 4000), ("10.0.0.3", 4000, "10.0.0.2", 80)]
    return [("probe/1", T0 + rng.randrange(0, 3 * M), 1, _tcp(*rng.choice(ends), rng.randbytes(rng.randrange(1, 60)) * rng.choice((1, 30))), 5_000) for _ in range(n)]


def test_checksums_and_frames():
    # published vectors
    assert [snappy.crc32c(x) for x in (b"", b"a", b"123456789", b"\0" * 32)] == [0, 0xC1D04330, 0xE3069283, 0x8A9136AA]
    rng = random.Random(1)
    for n in (0, 1, 5, 999, 1_000, 1_001, 1_024, 65_535, 65_536, 65_537, 200_000):
        data = rng.randbytes(n // 2) + b"ab" * (n // 4)
        framed = snappy.frame(data)
        assert snappy.unframe(framed) == data
        assert data.startswith(snappy.unframe(framed[:-1])) and (len(data) == 0 or len(snappy.unframe(framed[:-1])) < len(data))
    broken = bytearray(snappy.frame(b"hello" * 100))
    broken[-1] ^= 1
    assert snappy.unframe(bytes(broken)) == b""
    assert snappy.unframe(snappy.MARK + b"\xfe\x03\0\0abc" + snappy.chunk(b"after padding")) == b"after padding"


@pytest.mark.parametrize("compression", ["snappy", "none"])
def test_what_was_dumped_comes_back(spark, tmp_path, compression):
    rows = _rows(random.Random(2), 400)
    beat = ("probe/1", T0, 1, dumps.HEARTBEAT, 14)
    odd = [(None, T0, 1, b"x", 1), ("..", T0, 1, b"x", 1), ("", T0, 1, b"x", 1), ("probe/1", None, 1, b"x", 1), ("probe/1", T0, 1, None, 1), beat]
    df = spark.createDataFrame(rows + odd + [(".hidden", T0, 101, b"", 0)], packets.PACKETS).repartition(3)
    dumps.dump(df.withColumn("clash", F.lit(1)), str(tmp_path), compression)
    names = sorted(p.relative_to(tmp_path).as_posix() for p in tmp_path.rglob("*") if p.is_file() and not p.name.startswith("."))
    assert {n.split("/")[0] for n in names} == {"probe_1", "-.hidden"}
    assert {n.split("/")[1][:13] for n in names} == {"20260505T1330", "20260505T1331", "20260505T1332"} and all(n.endswith(".snappy") == (compression == "snappy") for n in names)
    got = dumps.read(spark, str(tmp_path), "probe/1", T0, T0 + 3 * M)
    assert sorted((r.ts_us, bytes(r.data), r.wire_len) for r in got.collect()) == sorted((r[1], r[3], r[4]) for r in rows)
    assert dumps.read(spark, str(tmp_path), ".hidden", T0, T0).count() == 1
    for none in ("nobody", "..", ""):
        assert dumps.read(spark, str(tmp_path), none, T0, T0).count() == 0
    # other minutes' files are not opened: one that cannot be read stays unseen
    (tmp_path / "probe_1" / "20260505T1329.pcap").symlink_to(tmp_path / "missing")
    lo, hi = T0 + M + 5, T0 + 2 * M - 7
    assert dumps.read(spark, str(tmp_path), "probe/1", lo, hi).count() == sum(lo <= r[1] <= hi for r in rows)


def test_a_hot_minute_rolls_and_empty_tables_write_nothing(spark, tmp_path):
    spark.dataSource.register(dumps.PacketDump)
    df = spark.createDataFrame([("s", T0 + k, 1, b"y" * 1_000, 1_000) for k in range(100)], packets.PACKETS)
    dumps.by_minute(df).write.format("packet_dump").mode("append").option("roll", 20_000).save(str(tmp_path / "a"))
    assert len(list((tmp_path / "a" / "s").glob("*.pcap.snappy"))) >= 5
    assert [r.ts_us for r in dumps.read(spark, str(tmp_path / "a"), "s", 0, T0 + S).orderBy("ts_us").collect()] == [T0 + k for k in range(100)]
    dumps.dump(df, str(tmp_path / "a"))  # appends
    assert dumps.read(spark, str(tmp_path / "a"), "s", 0, T0 + S).count() == 200
    (tmp_path / "b").mkdir()
    dumps.dump(df.where("false"), str(tmp_path / "b"))
    assert not list((tmp_path / "b").rglob("*.pcap*")) and not list(tmp_path.rglob("_going*"))
    with pytest.raises(Exception, match="appended"):
        df.write.format("packet_dump").mode("overwrite").save(str(tmp_path / "a"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.createDataFrame([("s", T0, 1, b"z", 1)], packets.PACKETS).withColumn("data", F.when(F.col("ts_us") > 0, F.raise_error("no").cast("binary")).otherwise(F.col("data")))
    with pytest.raises(Exception, match="no"):
        dumps.dump(bad, str(tmp_path))
    assert not list(tmp_path.rglob("*.pcap*")) and not list(tmp_path.rglob("_going*"))


def test_extract_gives_a_capture_in_order(spark, tmp_path):
    rows = _rows(random.Random(3), 300)
    dumps.dump(spark.createDataFrame([*rows, ("probe/1", T0 + 5, 1, b"not tcp", 7)], packets.PACKETS).repartition(4), str(tmp_path))
    lo, hi = T0 + 30 * S, T0 + 150 * S
    for client, server in ((("10.0.0.1", 4000), ("10.0.0.2", 80)), (("10.0.0.3", None), (None, None)), ((None, None), ("10.0.0.2", 80)), ((None, None), (None, None))):
        got = dumps.extract(spark, str(tmp_path), "probe/1", lo, hi, client, server)
        chunks = sorted((r.part, r.n, bytes(r.data)) for r in dumps.pcap_chunks(got).collect())
        whole = list(packets.records(b"".join(c[2] for c in chunks)))
        seen = []
        for r in rows:
            s = packets.segment(1, r[3])
            ways = (s[:2], s[2:4]), (s[2:4], s[:2])
            fits = lambda want, have: all(w is None or w == h for w, h in zip(want, have))
            if lo <= r[1] <= hi and any(fits(client, a) and fits(server, b) for a, b in ways):
                seen.append((r[1], 1, r[3], 5_000))
        assert [w[0] for w in whole] == sorted(w[0] for w in whole) and sorted(whole) == sorted(seen) and seen
    empty = dumps.pcap_chunks(dumps.extract(spark, str(tmp_path), "nobody", lo, hi)).collect()
    assert [bytes(r.data) for r in empty] == [dumps.head(1)]
    mixed = spark.createDataFrame([("s", T0, k, b"", 0) for k in (1, 101)], packets.PACKETS)
    with pytest.raises(ValueError, match="link types"):
        dumps.pcap_chunks(mixed)


def test_streams_replace_their_own_batch(spark, tmp_path):
    folder, inputs = tmp_path / "out", tmp_path / "in"
    rows = _rows(random.Random(4), 60)
    for k in range(3):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], packets.PACKETS).coalesce(1).write.mode("append").parquet(str(inputs))
    stream = spark.readStream.schema(packets.PACKETS).option("maxFilesPerTrigger", 1).parquet(str(inputs))
    dumps.dump_stream(stream, str(folder), str(tmp_path / "c"), "one", availableNow=True).awaitTermination()
    back = lambda: sorted(r.ts_us for r in dumps.read(spark, str(folder), "probe/1", T0, T0 + 3 * M).collect())
    assert back() == sorted(r[1] for r in rows)
    # the last batch again, as after a failure between its commit and the log's
    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (last, last.parent / f".{last.name}.crc"):
        if f.exists():
            f.unlink()
    dumps.dump_stream(stream, str(folder), str(tmp_path / "c"), "one", availableNow=True).awaitTermination()
    assert back() == sorted(r[1] for r in rows)


def _files(rng):
    return [(f"f/{k:03d}", rng.randrange(0, 6_000), rng.randrange(0, 50)) for k in range(300)] + [("f/other", None, 10**6)]


@pytest.mark.parametrize("hours,size", [(0, 0), (10, 0), (0, 2_000), (30, 1_000), (1, 0), (0, 1)])
def test_doomed_equals_one_walk(spark, hours, size):
    rng = random.Random(hours * 7 + size)
    own, now = _files(rng), 5_900
    seen = [f for f in own if f[1] is not None and f[1] < now - 1]
    out = {f[0] for f in seen if hours and f[1] < now - hours * 60}
    rest = sorted((f for f in seen if f[0] not in out), key=lambda f: (f[1], f[0]))
    total = sum(f[2] for f in rest)
    for f in rest:
        if not size or total <= size:
            break
        out.add(f[0])
        total -= f[2]
    got = dumps.doomed(spark.createDataFrame(own, "path string, minute long, bytes long"), now * M + 5, hours, size)
    assert {r.path for r in got.collect()} == out


def test_sweep_deletes_only_what_it_may(spark, tmp_path):
    now = datetime(2026, 5, 5, 13, 30, 30, tzinfo=timezone.utc)
    place = tmp_path / "s"
    place.mkdir()
    for name, size in (("20260505T1330.pcap", 3 << 20), ("20260505T1329-x-1.pcap.snappy", 3 << 20), ("20260505T1328.pcap", 1 << 20), ("20260505T1200-b-000001.pcap", 1 << 20), ("20260504T1000.pcap", 9), ("20260504T1000.txt", 9), ("20260230T1000.pcap", 9)):
        (place / name).write_bytes(b"\0" * size)
    at = int(now.timestamp()) * S
    assert dumps.sweep(spark, str(tmp_path), at) == (0, 0, 0)
    assert dumps.sweep(spark, str(tmp_path), at, max_age_hours=24) == (1, 9, 0)
    assert dumps.sweep(spark, str(tmp_path), at, max_size_mb=1) == (1, 1 << 20, 0)
    assert dumps.sweep(spark, str(tmp_path), at, 24, 1) == (0, 0, 0)
    assert sorted(p.name for p in place.iterdir() if not p.name.startswith(".")) == ["20260230T1000.pcap", "20260504T1000.txt", "20260505T1328.pcap", "20260505T1329-x-1.pcap.snappy", "20260505T1330.pcap"]


def test_a_range_reads_the_files_of_its_minutes_only(spark, tmp_path):
    assert dumps.sweep(spark, str(tmp_path / "none"), T0, 1, 1) == (0, 0, 0)
    dumps.dump(spark.createDataFrame([("s", T0 + k * M, 1, b"y", 1) for k in range(20)], packets.PACKETS).coalesce(1), str(tmp_path))
    own = dumps.read(spark, str(tmp_path), "s", T0 + 3 * M, T0 + 4 * M)
    assert own.count() == 2 and len(list((tmp_path / "s").glob("*.pcap.snappy"))) == 20
    plan = own._jdf.queryExecution().executedPlan()
    own._jdf.queryExecution().toRdd().count()
    scans = [plan]
    while scans[-1].children().size():
        scans.append(scans[-1].children().head())
    assert scans[-1].metrics().apply("numFiles").value() == 2
