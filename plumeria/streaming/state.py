"""Keyed state with timers for streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def clip(values: np.ndarray, k: float, passes: int) -> np.ndarray:
    """What is left after dropping, ``passes`` times, what lies over k population deviations from the mean."""
    for _ in range(passes):
        values = values[np.abs(values - values.mean()) <= k * values.std()] if len(values) else values
    return values


class ClippedStack(StatefulProcessor):
    """Values of one key and window; see :func:`plumeria.streaming.live.clipped_stack`. The last part of the key is the window's start."""

    def __init__(self, n_keys: int, width_ms: int, k: float, passes: int, revised: bool):
        self.n_keys, self.width_ms, self.k, self.passes, self.revised = n_keys, width_ms, k, passes, revised

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "v double")
        self.due = handle.getValueState("due", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            self.values.appendList([(float(v),) for v in df["v"]])
        if not self.due.exists():
            end = int(pd.Timestamp(key[self.n_keys]).timestamp() * 1000) + self.width_ms
            self.handle.registerTimer(end)
            self.due.update((end,))
        if self.revised:
            yield self._stack(key, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._stack(key, True)
        self.values.clear()
        self.due.clear()
        yield out

    def close(self) -> None:
        pass

    def _stack(self, key, final: bool) -> pd.DataFrame:
        held = np.array([row[0] for row in self.values.get()])
        left = clip(held, self.k, self.passes)
        return pd.DataFrame([[*key, len(held), len(left), float(left.mean()) if len(left) else None, final]])
