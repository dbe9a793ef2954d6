"""The sweep that tells proxies' legs and mirrors among stored turns."""

import json

from weir.store import Store

TRACES = "turn_id string, session_id string, agent_kind string, call_count long, total_input_tokens long, total_output_tokens long, start_us long, end_us long, client_ip string, server_ip string"
BASE = 10**12


def _leg(name, start, end, view, session="S"):
    return (name, session, "openclaw", 1, 11345, 128, BASE + start, BASE + end, *view.split(">"))


def _told(store):
    return {r.turn_id: (p["role"], p["pair_id"], p["peer_turn_ids"], p["peer_turn_id"]) for r in store.read("traces").collect() if r.metadata and (p := json.loads(r.metadata["proxy"])) is not None}


def test_sweeps_patch_once_and_late_legs_join(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("traces", spark.createDataFrame([_leg("outer", 0, 90_000, "c>p"), _leg("inner", 2_000, 89_000, "p>u"), _leg("alone", 0, 90_000, "c>p", "T"), _leg("same", 300_000, 400_000, "c>p"), _leg("view", 301_000, 399_000, "c>p")], TRACES))
    assert store.sweep_proxies(BASE + 10**6) == 2 and store.sweep_proxies(BASE + 10**6) == 0
    assert _told(store) == {"outer": ("proxy_in", "outer", ["inner"], "inner"), "inner": ("proxy_out", "outer", ["outer"], "outer")}
    # a mirror of the outer leg comes late, then one that spans them all and becomes the leader
    store.write("traces", spark.createDataFrame([_leg("mirror", 100, 90_100, "h>p")], TRACES))
    assert store.sweep_proxies(BASE + 10**6) == 3 and store.sweep_proxies(BASE + 10**6) == 0
    assert _told(store)["mirror"] == ("mirror_secondary", "outer", ["inner", "outer"], "inner")
    store.write("traces", spark.createDataFrame([_leg("wide", -5_000, 95_000, "x>y")], TRACES))
    assert store.sweep_proxies(BASE + 10**6) == 4
    assert {n: t[:2] for n, t in _told(store).items()} == {"wide": ("proxy_in", "wide"), "outer": ("proxy_out", "wide"), "inner": ("proxy_out", "wide"), "mirror": ("proxy_out", "wide")}
    # what began before the range stays as it is
    assert store.sweep_proxies(BASE + 2 * 1_800_000_000) == 0 and store.traces_page(0, 10**7).count() == 7


def test_a_turn_that_leaves_its_group_loses_the_mark(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("traces", spark.createDataFrame([_leg("a", 0, 50_000, "c>p"), _leg("b", 1_000, 49_000, "p>u")], TRACES))
    assert store.sweep_proxies(BASE + 10**6) == 2
    # the new leader has b's own view, so only a is its leg
    store.write("traces", spark.createDataFrame([_leg("z", -100_000 + 1, 60_000, "p>u")], TRACES))
    assert store.sweep_proxies(BASE + 10**6) == 3
    assert {n: t[0] for n, t in _told(store).items()} == {"z": "proxy_in", "a": "proxy_out"}
    assert [r.metadata for r in store.read("traces").where("turn_id = 'b'").collect()] == [{}]
