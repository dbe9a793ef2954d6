"""Rollups by source clock, calls under way over batches, and percentiles from sketches."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weir.operators import gauge, metrics, predicates, sketches
from weir.sources import bridge
from weir.store import Store
from weir.streaming import clocks

SF_DIR = "/root/testdata/sf0.001"
MINUTE = 60_000_000
COLUMNS = [c.split()[0] for c in clocks.EVENT.split(", ")]
ACTIVE = ["source_id", "wire_api", "model", "server_ip", "granularity", "window_us"]


def _files(spark, frames, folder):
    """A stream that reads one file after another."""
    for k, rows in enumerate(frames):
        rows.coalesce(1).write.parquet(f"{folder}-{k}")
    os.makedirs(folder)
    for k in range(len(frames)):
        part = next(f for f in os.listdir(f"{folder}-{k}") if f.startswith("part-"))
        os.rename(f"{folder}-{k}/{part}", f"{folder}/{k}.parquet")
        os.utime(f"{folder}/{k}.parquet", (1_000_000 + k * 100, 1_000_000 + k * 100))
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _event(kind, source, at, call=None, request=None, **more):
    return {"kind": kind, "source_id": source, "ts_us": at, "id": call, "request_us": at if request is None else request, "model": "m", "wire_api": "a", "server_ip": "s"} | more


def _frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in rows], clocks.EVENT)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_windows_go_out_by_the_clock_of_their_own_source(rocks, spark, tmp_path):
    hours = 5 * 60 * MINUTE
    # source b is hours behind a; its windows go out by its own clock, and a late event opens a window again
    files = [
        [_event("start", "a", hours, "a1"), _event("start", "b", 0, "b1"), _event("complete", "a", hours + 1_000_000, "a1", hours)],
        [_event("start", "a", hours + 5 * MINUTE, "a2"), _event("heartbeat", "b", 5_000_000)],
        [_event("heartbeat", "b", 12_000_000), _event("start", "b", 11_000_000, "b2")],
        [_event("start", "b", 2_000_000, "b3"), _event("heartbeat", "b", 24_000_000)],
        [_event("heartbeat", "b", 25_000_000)],
    ]
    given = []
    rows = clocks.by_clock(_files(spark, [_frame(spark, f) for f in files], str(tmp_path / "in")), shards=3)
    rows.writeStream.foreachBatch(lambda df, k: given.append((k, sorted((r.source_id, r.id, r.kind) for r in df.collect())))).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert [rows for _, rows in sorted(given)] == [[], [("a", "a1", "complete"), ("a", "a1", "start")], [("b", "b1", "start")], [("b", "b2", "start"), ("b", "b3", "start")], []]


def test_a_stream_of_starts_and_ends_adds_up_to_the_batch(rocks, spark, tmp_path):
    events = clocks.call_events(bridge.spans(spark, SF_DIR))
    cuts = [r[0] for r in events.selectExpr("explode(percentile_approx(ts_us, array(0.3, 0.6), 1000))").collect()]
    frames = [events.where(F.col("ts_us") < cuts[0]), events.where((F.col("ts_us") >= cuts[0]) & (F.col("ts_us") < cuts[1])), events.where(F.col("ts_us") >= cuts[1])]
    frames.append(_frame(spark, [_event("end", s, 10**15) for s in ("src-0", "src-1")]))
    store = Store(spark, str(tmp_path / "store"))
    for query in clocks.start(_files(spark, [f.select(*COLUMNS) for f in frames], str(tmp_path / "in")), store, str(tmp_path / "check"), once=True, shards=2):
        query.awaitTermination()
    store.refresh()
    sums = ["call_count", "stream_count", "error_count", "input_tokens_sum", "output_tokens_count", "e2e_count"]
    keys = ["window_us", "source_id", "granularity", "wire_api", "model", "server_ip"]
    add = lambda df: sorted(map(str, df.groupBy(*keys).agg(*(F.sum(c) for c in sums)).collect()))
    # what the batch counts of calls that have no end is their start alone
    ended, own = events.where("kind = 'complete'"), events.where("kind = 'start'")
    want = metrics.rollup(own).select(*keys, *sums).unionByName(metrics.rollup(ended).withColumns({"call_count": F.lit(0), "stream_count": F.lit(0)}).select(*keys, *sums))
    assert add(store.read("llm_metrics")) == add(want)
    counted, _ = gauge.run(gauge.event_steps(events))
    stored = Counter()
    for r in store.read("llm_active").select(*ACTIVE, "active_calls_max").collect():
        stored[tuple(r)[:-1]] = max(stored[tuple(r)[:-1]], r.active_calls_max)
    assert stored == {tuple(r)[:-1]: r.active_calls_max for r in counted.select(*ACTIVE, "active_calls_max").collect()}
    assert store.timeseries(["active_calls_max"], "1h", 0, 4_000 * 3600).columns == ["ts", "active_calls_max"]


def _under_way(rows):
    """The largest count by source, model and minute, call by call."""
    steps = sorted([(at, 1, i, s, m) for i, s, m, at, _ in rows] + [(max(end, at + 1), -1, i, s, m) for i, s, m, at, end in rows if end is not None])
    count, most = Counter(), Counter()
    for at, delta, _, s, m in sorted(steps, key=lambda x: (x[0], x[1], x[2])):
        for key in ((s, m), (s, "*")):
            count[key] = max(0, count[key] + delta)
            if delta > 0:
                most[(*key, at // MINUTE * MINUTE)] = max(most[(*key, at // MINUTE * MINUTE)], count[key])
    return most


def test_one_ingest_and_ten_count_the_same_calls_under_way(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"c{k}", rng.choice("ab"), rng.choice("xy"), (at := rng.randrange(0, 200 * MINUTE)), rng.choice([None, at, at + rng.randrange(100 * MINUTE), at + 10])) for k in range(300)]
    rows.sort(key=lambda r: r[3])
    rows = [r if k % 4 else (*r[:4], r[3] + 30 * MINUTE) for k, r in enumerate(rows)]
    spans = spark.createDataFrame([("api", "ip", *r) for r in rows], "wire_api string, server_ip string, id string, source_id string, model string, request_us long, complete_us long")
    want = _under_way(rows)
    for name, parts in (("one", 1), ("ten", 10)):
        store, size = Store(spark, str(tmp_path / name)), len(rows) // parts
        for k in range(parts):
            own = spans.where(F.col("id").isin([r[0] for r in rows[k * size : (k + 1) * size]]))
            waiting = store.state("pending", k + 1)
            steps = gauge.steps(own) if waiting is None else gauge.steps(own).unionByName(waiting)
            now, later, clocks_ = gauge.due(steps, store.state("clocks", k + 1))
            store.keep("pending", later, k + 1)
            store.keep("clocks", clocks_, k + 1)
            store.ingest_active(now, k + 1)
            if k == 4:
                store.ingest_active(now, k + 1)  # done again
        got = store.read("llm_active").where("granularity = '1m' and wire_api = 'api' and server_ip = 'ip' or wire_api = '*' and server_ip = '*'").where("granularity = '1m'")
        got = got.groupBy("source_id", "model", "window_us").agg(F.max("active_calls_max").alias("n")).collect()
        assert {(r.source_id, r.model, r.window_us): r.n for r in got} == want, name


def test_calls_under_way_go_on_with_the_next_ingest(spark, tmp_path):
    spans = bridge.spans(spark, SF_DIR).limit(4).withColumns({"complete_us": F.lit(None).cast("long"), "source_id": F.lit("s")}).persist()
    store = Store(spark, str(tmp_path))
    ids = [r.id for r in spans.orderBy("request_us").collect()]
    for part in (ids[:2], ids[2:]):
        store.ingest(spans.where(F.col("id").isin(part)))
    first = spans.agg(F.min("request_us")).first()[0] // 1_000_000
    assert store.timeseries(["active_calls_max"], "1h", first - 3600, first + 3600 * 10_000).agg(F.max("active_calls_max")).first()[0] == 4
    spans.unpersist()


def test_merged_percentiles_lie_within_the_rank_error(spark):
    rows = spark.range(50_000).selectExpr("'s' as source_id", "'api' as wire_api", "concat('m', id % 3) as model", "'ip' as server_ip", "cast(null as string) as tool_surface", "id * 70000 as request_us", "id * 70000 + 5 as response_us", "id * 70000 + 9 as complete_us", "true as is_stream", "200 as status_code", "1L as input_tokens", "1L as output_tokens", "1L as cache_read_input_tokens", "1L as cache_creation_input_tokens", "cast(pmod(id * 7919, 50000) as double) as e2e_latency_ms", "1.0D as ttft_ms")
    stored = sketches.rollup(rows)
    got = stored.where("granularity = '10s'").agg(*(sketches.field(f"e2e_p{p}") for p in (50, 95, 99))).first()
    assert all(abs(x / 50_000 - p / 100) < 0.0165 * 1.5 for x, p in zip(got, (50, 95, 99)))
    hour = stored.where("granularity = '1h'").groupBy("window_us").agg(F.sum("call_count").alias("n"), sketches.field("e2e_p50")).collect()
    assert sum(r.n for r in hour) == 50_000 and all(abs(r.e2e_p50 / 50_000 - 0.5) < 0.05 for r in hour)
    empty = sketches.finest(rows.withColumn("e2e_latency_ms", F.lit(None).cast("double"))).agg(sketches.field("e2e_p95"), sketches.field("e2e_avg")).first()
    assert tuple(empty) == (None, None)


@pytest.mark.parametrize("start,end", [(0, 86_400), (3_599, 7_261), (10, 20), (5, 5), (3_600, 7_200), (59, 3_601), (7, 100_003)])
def test_a_range_is_covered_just_once(spark, start, end):
    windows = [(n, w * 1_000_000) for n, size in predicates.GRANULARITIES.items() for w in range(0, 110_000, size)]
    got = spark.createDataFrame(windows, "granularity string, window_us long").where(sketches.cover(start * 1_000_000, end * 1_000_000)).collect()
    tens = sorted(r.window_us // 10_000_000 + k for r in got for k in range(predicates.GRANULARITIES[r.granularity] // 10))
    assert tens == list(range(-(-start // 10), -(-end // 10)))
