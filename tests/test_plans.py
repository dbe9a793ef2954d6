"""Steps that must not be done more often than once, told from the plans of the registered queries."""

from pyspark.sql import functions as F

from weir.functions import wire
from weir.operators import proxy
from weir.plans import registry

SF_DIR = "/root/testdata/sf0.001"


def _plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_a_stream_is_cut_into_events_once(spark):
    plan = _plan(registry.QUERIES["sse_folds"](spark, SF_DIR))
    # blocks and lines
    assert plan.count("split(") == 2
    assert plan.count("get_json_object(") == 6


def test_chat_streams_of_odd_events(spark):
    streams = {
        'data: {"id": 7, "choices": [{"delta": {"content": "a"}}]}\n\ndata: {"i\\u0064": "x", "mod\\u0065l": "m", "choices": [{"delta": {"con\\u0074ent": "b\\n"}}]}\n\ndata: [DONE]\n\n': ("7", "m", "ab\n", None, None, None),
        'data: {"id": null}\n\ndata: {"id": "y", "usage": {"prompt_tokens": "z", "completion_tokens": 3}}\n\ndata: {"usage": {"prompt_tokens": 5}, "choices": [{"finish_reason": "stop"}]}\n\n': ("y", None, "", "stop", None, 3),
        "data: id content\n\n: no data\n\ndata:  [1]\n\n": (None, None, "", None, None, None),
        "": (None, None, "", None, None, None),
    }
    rows = spark.createDataFrame([(s,) for s in streams], "s string")
    for r in rows.select("s", wire.bound(wire.sse_events(F.col("s")), wire.fold_chat).alias("r")).collect():
        assert tuple(r.r) == streams[r.s], r.s


def test_headers_are_compared_in_one_shuffle(spark):
    plan = _plan(registry.QUERIES["header_diff"](spark, SF_DIR), "executedPlan")
    assert plan.count("Exchange hashpartitioning") == 1 and "Expand" not in plan and plan.count("Sort [") == 1


def test_headers_of_odd_legs(spark):
    rows = [
        (1, 0, [("A", "x"), ("B", None), ("b", "y"), (None, "z")]), (1, 1, [("a", "x"), ("B", "y")]), (1, 2, None), (1, 2, [("A", "x")]),
        (2, 5, [("a", "x"), ("A", "w")]), (3, 0, []), (None, 0, [("A", "x")]),
    ]
    legs = spark.createDataFrame(rows, "pair_id long, leg int, headers array<struct<name:string,value:string>>")
    got = {tuple(r) for r in proxy.header_diff(legs).collect()}
    # a leg without headers counts; one leg twice is one; legs of no pair are a group
    assert got == {(1, "A", "common"), (1, "B", "per_leg"), (1, None, "per_leg"), (2, "a", "modified"), (None, "A", "common")}


def test_rows_of_tiers_are_dealt_out_before_they_are_grouped(spark):
    steps = [x.strip(" :+-") for x in _plan(registry.QUERIES["rollup_sketches"](spark, SF_DIR), "executedPlan").split("\n")]
    made = next(k for k, x in enumerate(steps) if x.startswith("Generate explode(array(struct(wire_api"))
    above = [x.split("(")[0].split()[0] for x in steps[:made]]
    # no table of groups in the task that makes the rows
    assert "Exchange" in above[max(k for k, x in enumerate(above) if x == "HashAggregate") :]
