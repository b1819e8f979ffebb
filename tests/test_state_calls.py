"""Stateful processors ask for state once for many keys: a call for each key cost more than all else."""

from __future__ import annotations

import pandas as pd

from tidemark.streaming import guards, monitors


class Handle:
    """State and timers of one group, with a count of the calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name == "get":
                return self.value
            if name == "update":
                self.value = given[0]
            if name == "listTimers":
                return sorted(self.timers)
            if name in ("registerTimer", "deleteTimer"):
                (self.timers.add if name == "registerTimer" else self.timers.discard)(given[0])
            return self

        return call

    getCurrentWatermarkInMs = lambda self: 170_000
    getExpiryTimeInMs = lambda self: 160_000


def test_expiries_of_many_orders_take_few_calls():
    handle, made = Handle(), monitors.Expiries(60_000)
    made.init(handle)
    rows = pd.DataFrame({"order_id": [f"o{i}" for i in range(1000)], "us": [(100 + i % 20) * 10**6 for i in range(1000)], "seq": 1, "status": "PENDING"})
    assert sum(map(len, made.handleInputRows((3,), iter([rows[:600], rows[600:]]), handle))) == 0
    assert handle.timers == {160_000}
    out = pd.concat(list(made.handleExpiredTimer((3,), handle, handle)))
    assert sorted(out["order_id"]) == sorted(o for o, us in zip(rows["order_id"], rows["us"], strict=True) if us < 110 * 10**6)
    assert 170_000 in handle.timers and handle.calls < 20


def test_guards_of_many_keys_take_few_calls():
    handle, made = Handle(), guards.Guard("k", "bigint")
    made.init(handle)
    rows = pd.DataFrame({"bucket": 3, "key": [i % 500 for i in range(2000)], "seq": range(2000), "stale": False, "violated": [i == 700 for i in range(2000)], "enabled": True})
    out = pd.concat(list(made.handleInputRows((3,), iter([rows[:600], rows[600:]]), handle)))
    assert len(out) == 2000 and out[out["disabled"]][["k", "seq"]].values.tolist() == [[200, 700]]
    assert sorted(out[~out["can_trade"]]["seq"]) == [700, 1200, 1700]
    assert out["seq"].is_unique and handle.calls < 10
    again = pd.concat([pd.DataFrame(), *made.handleInputRows((3,), iter([rows[1990:]]), handle)])
    assert again.empty
