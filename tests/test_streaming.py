"""Streams give what batches give."""

import os

from pyspark.sql import functions as F

from tests.test_clocks import _files
from weir.operators import exchanges, metrics
from weir.sources import bridge
from weir.store import Store
from weir.streaming import pairing, rollup

SF_DIR = "/root/testdata/sf0.001"


def _streamed(spark, rows, path, files=3):
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_rollup_of_a_stream_adds_up_to_that_of_the_batch(spark, tmp_path):
    spans = bridge.spans(spark, SF_DIR)
    store = Store(spark, str(tmp_path / "store"))
    rollup.start(_streamed(spark, spans, str(tmp_path / "in")), store, str(tmp_path / "check"), once=True).awaitTermination()
    keys, sums = ["window_us", "granularity", "wire_api", "model", "server_ip"], ["call_count", "error_count", "input_tokens_sum"]
    add = lambda df: sorted(map(tuple, df.groupBy(*keys).agg(*(F.sum(c) for c in sums)).collect()))
    assert add(store.read("llm_metrics")) == add(metrics.rollup(spans, exact=False))


def test_pairs_of_a_stream(spark, tmp_path):
    rows = bridge.http_events(spark, SF_DIR).where("flow < 20").withColumn("time", F.timestamp_micros("ts_us"))
    query = pairing.pair_stream(_streamed(spark, rows, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = {(r.flow, r.request, r.response) for r in exchanges.pair(rows.drop("time")).where("response is not null").collect()}
    assert {(r.flow, r.request, r.response) for r in spark.table("pairs").collect()} == want


def _turns(spark, calls, tmp_path, name, files):
    """The turns of calls that come in several files, in the order of their time or not."""
    for k, rows in enumerate(files):
        calls.where(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / f"{name}-{k}"))
    folder = tmp_path / name
    folder.mkdir()
    for k in range(len(files)):
        part = next((tmp_path / f"{name}-{k}").glob("part-*"))
        part.rename(folder / f"{k}.parquet")
        os.utime(folder / f"{k}.parquet", (1_000_000 + k * 100, 1_000_000 + k * 100))
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    pairing.turn_stream(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start().awaitTermination()
    return {(r.session_id, r.start_us, r.end_us, r.call_count, r.status) for r in spark.table(name).collect()}


def test_turns_of_a_stream(spark, tmp_path):
    """The longest session over three files, so that state is carried over micro-batches; a far later call lets the watermark pass it."""
    from weir.operators import turns

    rows = bridge.read(spark, SF_DIR, "conversations")
    longest = rows.groupBy("conv_id").count().orderBy(F.col("count").desc(), "conv_id").first()
    calls = turns.conversation_calls(rows).where(F.col("session_id") == str(longest.conv_id))
    beat = calls.limit(1).select(*(F.lit("beat").alias(c) if c in ("session_id", "id") else F.lit(10**15).alias(c) if c in ("request_us", "end_us") else c for c in calls.columns)).withColumns({"is_terminal": F.lit(False), "is_user_start": F.lit(False)})
    both = calls.unionByName(beat).withColumn("time", F.timestamp_micros("request_us"))
    turn, third = "cast(split(id, '-')[1] as int)", longest["count"] // 3
    got = _turns(spark, both, tmp_path, "turns", [f"id <> 'beat' and {turn} < {third}", f"id <> 'beat' and {turn} >= {third} and {turn} < {2 * third}", f"id <> 'beat' and {turn} >= {2 * third}", "id = 'beat'"])
    want = {(r.session_id, r.start_us, r.end_us, r.call_count, r.status) for r in turns.assemble(calls).collect()}
    assert got == want and len(want) > 1


def test_calls_tied_with_a_terminal_one_and_late_ones_count(spark, tmp_path):
    def call(name, at, terminal=False, start=False):
        return ("s", "a", name, at, at + 10, terminal, start, False)

    rows = [call("c1", 1_000_000, start=True), call("c3", 2_000_000, terminal=True), call("c2", 2_000_000), call("c4", 1_500_000), call("c5", 2_400_000, start=True), call("z", 10**13)]
    calls = spark.createDataFrame(rows, "source_id string, session_id string, id string, request_us long, end_us long, is_terminal boolean, is_user_start boolean, is_auxiliary boolean").withColumn("time", F.timestamp_micros("request_us"))
    calls = calls.withColumn("session_id", F.when(F.col("id") == "z", "z").otherwise(F.col("session_id")))
    got = _turns(spark, calls, tmp_path, "late", ["id in ('c1', 'c3')", "id in ('c2', 'c4', 'c5')", "id = 'z'"])
    # c4 comes a file after the terminal call, c2 is of its microsecond; c5 is the open tail
    assert got == {("a", 1_000_000, 2_000_010, 4, "complete"), ("a", 2_400_000, 2_400_010, 1, "incomplete")}


def test_many_batches_leave_few_folders_and_the_same_rows(spark, tmp_path):
    spans = bridge.spans(spark, SF_DIR).where("id < '2'")
    store = Store(spark, str(tmp_path))
    for number in range(4):
        store.write("spans", spans.where(F.col("id").cast("long") % 4 == number), number)
    store.write("spans", spans.where(F.col("id").cast("long") % 4 == 3), 3)  # done again
    want, before = spans.count(), len(list(store._folders("spans")))
    assert store.read("spans").count() == want and store.compact("spans") == before
    days = {day for _, day, _, _ in store._folders("spans")}
    assert store.read("spans").count() == want and len(list(store._folders("spans"))) == len(days)
    store.write("spans", spans.limit(5), 2)  # a batch that is compacted already adds nothing
    store.refresh()
    assert store.read("spans").count() == want


def test_retention_deletes_old_days_and_keeps_young_rows(spark, tmp_path):
    day = 86_400_000_000
    store = Store(spark, str(tmp_path))
    store.write("traces", spark.createDataFrame([("a", day, day + 5), ("b", day, 40 * day), ("c", 39 * day, 39 * day)], "turn_id string, start_us long, end_us long"))
    store.write("llm_metrics", spark.createDataFrame([("10s", 38 * day), ("1h", 38 * day), ("10s", 40 * day)], "granularity string, window_us long"))
    store.expire(41 * day)
    store.refresh()
    assert {r.turn_id for r in store.read("traces").collect()} == {"b", "c"}
    assert {(r.granularity, r.window_us // day) for r in store.read("llm_metrics").collect()} == {("1h", 38), ("10s", 40)}


AGENT = "source_id string, session_id string, id string, request_us long, end_us long, is_terminal boolean, is_user_start boolean, is_auxiliary boolean, model string, subagent string, tool_surface string, input_tokens long, output_tokens long, user_input string, assistant_text string, finish_reason string, process string"


def _agent(session, name, at, terminal=False, start=False, source="s", process=None, aux=False):
    return (source, session, name, at, at + 10, terminal, start, aux, "m", None, None, 1, 2, name if start else None, name, None, process)


def test_turns_by_source_clock_and_those_under_way(spark, tmp_path):
    from weir.streaming import tracker

    S = 1_000_000
    batches = [
        [_agent("a", "a1", 1 * S, start=True), _agent("a", "a2", 2 * S, terminal=True), _agent("b", "b1", 10**6 * S, start=True, source="far")],
        # c is a late call of the turn that waits, a3 starts the next one; the other source, days ahead, moves no clock but its own
        [_agent("a", "c", int(1.5 * S)), _agent("a", "a3", int(2.5 * S), start=True), _agent("b", "b2", 10**6 * S + 5, terminal=True, source="far")],
        [_agent("a", "a4", 4 * S), _agent("a", "aux", 4 * S, terminal=True, aux=True), _agent("p", "p1", 4 * S, process="42"), _agent("q", "q1", 4 * S)],
        [_agent("a", "old", 1 * S)],  # from before what went out
        [(("s", None, None, 10**4 * S, 10**4 * S) + (False,) * 3 + (None,) * 9)],  # a heartbeat, idle for all
        [_agent("a", "a5", 10**4 * S + 7, start=True)],
    ]
    store, ids = Store(spark, str(tmp_path)), []
    for k, rows in enumerate(batches):
        tracker.step(spark.createDataFrame(rows, AGENT), store, k)
        if k == 1:
            tracker.step(spark.createDataFrame(rows, AGENT), store, k)  # done again
        ids.append({(r.turn_id, tuple(r.span_ids), r.status) for r in tracker.snapshot(store).collect()})
    assert ids[0] == {("s:a:0", ("a1", "a2"), "in_progress"), ("far:b:0", ("b1",), "in_progress")}
    assert ids[1] == {("s:a:0", ("a1", "c", "a2"), "in_progress"), ("far:b:0", ("b1", "b2"), "in_progress")}
    # p goes without a user's start, by its process; q does not
    assert ids[2] == ids[3] == {("far:b:0", ("b1", "b2"), "in_progress"), ("s:a:1", ("a3", "a4"), "in_progress"), ("s:p:0", ("p1",), "in_progress")}
    assert ids[4] == {("far:b:0", ("b1", "b2"), "in_progress")} and ids[5] == ids[4] | {(f"s:a:{8 * tracker.EPOCH}", ("a5",), "in_progress")}  # forgotten, so no number is used twice
    store.refresh()
    assert {(r.turn_id, tuple(r.span_ids), r.status) for r in store.read("traces").collect()} == {("s:a:0", ("a1", "c", "a2"), "complete"), ("s:a:1", ("a3", "a4"), "incomplete"), ("s:p:0", ("p1",), "incomplete")}
    page = store.live_traces(0, 2 * 10**6).collect()
    assert [r.turn_id for r in page] == ["far:b:0", f"s:a:{8 * tracker.EPOCH}", "s:p:0", "s:a:1", "s:a:0"] and [r.in_progress for r in page] == [True] * 2 + [False] * 3


def test_written_turns_and_those_under_way_are_the_batchs(spark, tmp_path):
    from weir.operators import turns
    from weir.streaming import tracker

    rows = bridge.read(spark, SF_DIR, "conversations")
    calls = turns.conversation_calls(rows).withColumn("process", F.lit(None).cast("string")).where("cast(session_id as int) < 12")
    cut = "cast(split(id, '-')[1] as int)"
    beats = calls.limit(2).select(*(F.lit(10**12).cast("long").alias(c) if c == "end_us" else F.concat(F.lit("src-"), (F.monotonically_increasing_id() % 2).cast("string")).alias(c) if c == "source_id" else F.lit(None).cast(t).alias(c) for c, t in calls.dtypes))
    frames = [calls.where(f"{cut} < 2"), calls.where(f"{cut} = 2"), calls.where(f"{cut} > 2"), beats]
    store = Store(spark, str(tmp_path / "store"))
    tracker.start(_files(spark, frames, str(tmp_path / "in")), store, str(tmp_path / "check"), once=True, idle_us=10**15).awaitTermination()
    store.refresh()
    columns = ["turn_id", "start_us", "end_us", "call_count", "span_ids", "models_used", "total_input_tokens", "final_answer_preview"]
    written, going = store.read("traces").select(*columns), tracker.snapshot(store).select(*columns)
    want = turns.assemble(calls)
    assert sorted(map(str, written.unionByName(going).collect())) == sorted(map(str, want.select(*columns).collect())) and written.count() > 0
    assert {r.status for r in store.read("traces").select("status").distinct().collect()} == {"complete"}
