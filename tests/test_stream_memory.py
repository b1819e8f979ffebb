"""What a symbol's trades of a micro-batch hold in memory at once."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tests.test_state_calls import Handle
from tidemark.operators.setups import SetupParams
from tidemark.streaming.bars import ArrivalBars
from tidemark.streaming.detector import Detector

N, PART = 400_000, 10_000


class Empty(Handle):
    def __getattr__(self, name):
        return (lambda *_: False) if name in ("exists", "containsKey") else super().__getattr__(name)


@pytest.mark.parametrize("make", [lambda: ArrivalBars({"1h": 3600}), lambda: Detector(SetupParams())], ids=["bars", "detector"])
def test_a_trade_takes_few_bytes(make):
    def parts():
        for at in range(N - PART, -1, -PART):  # in no order of arrival
            seq = np.arange(at, at + PART)
            yield pd.DataFrame({"symbol": "A", "price": seq % 97 + 1.0, "size": 1.0, "seq": seq, "sec": seq // 50})

    handle, made = Empty(), make()
    made.init(handle)
    tracemalloc.start()
    out = pd.concat(list(made.handleInputRows(("A",), parts(), handle)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 * N
    if "timeframe" in out:
        assert out["ts_open"].tolist() == [0, 3600] and out["volume"].tolist() == [180_000.0, 180_000.0]
