"""The limits of operators.reports on a stream, with state a user that goes once it decides nothing any more."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexilake.operators import reports as O


def _decided(events: DataFrame, name: str, delay: str, decide: O.Decide, end: Callable[[dict], int | None]) -> DataFrame:
    """event_id and the decision on it, once the watermark has passed the event.

    Until then the event waits in its user's state, so events that come out of order within the delay are decided in
    order, as on a table. Later ones are left out and change no decision. end: microsecond from which a state decides
    nothing, None for never. A user's state holds the events of one delay and what `decide` remembers.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(group.get[0]) if group.exists else {"waiting": [], "state": {}}
        state = {k: deque(v) if isinstance(v, list) else v for k, v in held["state"].items()}
        waiting = [tuple(w) for w in held["waiting"]]
        for f in frames:
            waiting += zip(f["_at"].tolist(), f["event_id"].tolist(), f["_kind"].tolist(), strict=True)
        passed = group.getCurrentWatermarkMs()
        waiting.sort()
        due = next((i for i, w in enumerate(waiting) if w[0] > passed * 1000), len(waiting))
        out = [(event, decide(state, at, kind)) for at, event, kind in waiting[:due]]
        waiting = waiting[due:]
        until = waiting[0][0] if waiting else end(state) if state else 0
        if not waiting and until is not None and until <= passed * 1000:
            group.remove()
        else:
            group.update((json.dumps({"waiting": waiting, "state": {k: list(v) if isinstance(v, deque) else v for k, v in state.items()}}),))
            if until is not None:
                group.setTimeoutTimestamp(max(-(-until // 1000) - 1, passed + 1))  # fires when the watermark is beyond it
        if out:
            yield pd.DataFrame(out, columns=["event_id", name])

    timed = O.by_user(events).withColumn("_time", F.timestamp_micros("_at")).withWatermark("_time", delay)
    return timed.groupBy("_user").applyInPandasWithState(run, f"event_id long, {name} boolean", "held string", "append", GroupStateTimeout.EventTimeTimeout)


def rate_limited(events: DataFrame, most: int = 10, seconds: int = 60, delay: str = "10 minutes") -> DataFrame:
    """reports.rate_limited on a stream. A user's state goes `seconds` after the last allowed hit."""
    return _decided(events, "allowed", delay, O.limiter(most, seconds), lambda state: state["hits"][-1] + seconds * 1_000_000 if state["hits"] else 0)


def locked_out(events: DataFrame, failure: str = "error", success: str = "signup", most: int = 5, minutes: int = 15, delay: str = "10 minutes") -> DataFrame:
    """reports.locked_out on a stream. A user's count of failures stays until a success, as there; users without one have no state."""
    return _decided(events, "locked", delay, O.lockout(failure, success, most, minutes), lambda state: None)
