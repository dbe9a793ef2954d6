"""Requests and responses paired, and turns assembled, with state kept by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAIRS = "flow long, request long, request_us long, response long, response_us long, response_label string"
STATE = "request long, request_us long, label string"


def pair_stream(events: DataFrame, stale_ms: int = 600_000) -> DataFrame:
    """Pairs of a stream of events (flow, ts_us, kind, seq, label, time): one request of a flow waits; the next one replaces it, a response
    takes it. A request without an answer for ``stale_ms`` of event time is dropped. ``time`` is the event time as TIMESTAMP."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = state.get if state.exists else None
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        rows = pd.concat(list(frames)).sort_values(["ts_us", "kind", "seq"], kind="stable")
        for r in rows.itertuples(index=False):
            if r.kind == 0:
                waiting = (int(r.seq), int(r.ts_us), r.label)
            elif waiting is not None:
                out.append((key[0], waiting[0], waiting[1], int(r.seq), int(r.ts_us), r.label))
                waiting = None
        if waiting is not None:
            state.update(waiting)
            state.setTimeoutTimestamp(max(waiting[1] // 1000, state.getCurrentWatermarkMs()) + stale_ms)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in PAIRS.split(", ")])

    return events.withWatermark("time", "10 minutes").groupBy("flow").applyInPandasWithState(step, PAIRS, STATE, "append", GroupStateTimeout.EventTimeTimeout)


TURNS = "source_id string, session_id string, start_us long, end_us long, call_count long, status string"
TURN_STATE = "calls string, done_us long"


def turn_stream(calls: DataFrame, idle_ms: int = 600_000, grace_ms: int = 1_000) -> DataFrame:
    """Turns of a stream of calls (as in ``operators.turns``, with ``time``): a session's calls wait in order; a terminal one ends the turn of all calls up to it.

    A turn that has ended is held until the watermark is ``grace_ms`` past its terminal call, so calls of it that come late, or in another order, still
    count. Calls strictly before the last turn given out are dropped. A session without calls for ``idle_ms`` of event time gives up its open turn
    as incomplete. Turns without a user's start are dropped, auxiliary calls belong to none. A session's waiting calls are its state: those of its open turn.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packed, done = state.get if state.exists else ("[]", -1)
        waiting = [tuple(c) for c in json.loads(packed)]
        if not state.hasTimedOut:
            for rows in frames:
                waiting += [(int(r.request_us), str(r.id), int(r.end_us), bool(r.is_terminal), bool(r.is_user_start)) for r in rows.itertuples(index=False) if not r.is_auxiliary and r.request_us >= done]
        waiting.sort()
        clock = state.getCurrentWatermarkMs()
        out = []

        def give(turn: list[tuple], status: str) -> None:
            if any(c[4] for c in turn):
                out.append((*key, turn[0][0], max(c[2] for c in turn), len(turn), status))

        while terminal := next((c for c in waiting if c[3]), None):
            if clock < terminal[0] // 1000 + grace_ms:
                break
            # all calls up to the terminal one, those of its own microsecond too
            turn = [c for c in waiting if c[0] <= terminal[0]]
            waiting, done = waiting[len(turn) :], terminal[0]
            give(turn, "complete")
        last = max([c[0] // 1000 for c in waiting], default=done // 1000)
        if waiting and state.hasTimedOut and clock >= last + idle_ms:
            give(waiting, "incomplete")
            waiting = []
        if waiting or done >= 0 and clock < done // 1000 + idle_ms:
            state.update((json.dumps(waiting), done))
            ends = min([c[0] // 1000 + grace_ms for c in waiting if c[3]], default=last + idle_ms)
            state.setTimeoutTimestamp(max(ends, clock + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TURNS.split(", ")])

    return calls.withWatermark("time", "1 second").groupBy("source_id", "session_id").applyInPandasWithState(step, TURNS, TURN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
