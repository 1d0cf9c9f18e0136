"""The step of the queue's stream against its fold, with a count of the calls it makes to its stores."""

from __future__ import annotations

import pandas as pd

from tallyforge.streaming import requeue


class Handle:
    """Stores and timers of a key, with a count of the calls."""

    def __init__(self):
        self.calls, self.value, self.items, self.timers = 0, None, [], set()

    def getValueState(self, *_):
        return self

    getListState = getValueState

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def appendList(self, values):
        self.calls, self.items = self.calls + 1, self.items + values

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


def test_step_keeps_state_and_timers():
    queue, handle = requeue.Queue(3600), Handle()
    queue.init(handle)

    def feed(*events):
        frame = pd.DataFrame([(i, pd.Timestamp(t, unit="s"), k) for i, (t, k) in enumerate(events)], columns=["event_id", "ts", "kind"])
        return [tuple(r)[1:4] for f in queue.handleInputRows((7,), iter([frame.iloc[::-1]]), None) for r in f.itertuples(index=False)]

    assert feed((100, "evidence")) == [] and handle.calls == 1  # nothing changed, nothing written
    assert feed((200, "claim")) == [] and handle.timers == {3_800_000}
    assert feed((300, "claim"), (250, "evidence")) == [] and handle.timers == {3_800_000}
    assert feed((400, "finish"), (500, "evidence"), (600, "claim")) == [(0, "completed", 1), (1, "requeued", 1)] and handle.timers == {4_200_000}
    said = [tuple(r)[1:4] for f in queue.handleExpiredTimer((7,), None, None) for r in f.itertuples(index=False)]
    assert said == [(1, "expired", 2)] and handle.value == (1, None, False, 2) and handle.timers == set()
    assert handle.items == [(0, "completed", 400), (1, "expired", 4200)]
