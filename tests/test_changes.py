"""What a key's changes cost in calls and items of the state."""

from types import SimpleNamespace

from pyspark.sql import Row

from tempora.streaming.changes import PACK, Changes


class Items:
    def __init__(self):
        self.items, self.calls = [], 0

    def appendList(self, more):
        self.calls += 1
        self.items += more

    def get(self):
        return iter(self.items)

    def put(self, items):
        self.items = items

    def clear(self):
        self.items = []


class One:
    now = None

    def get(self):
        return self.now

    def update(self, now):
        self.now = now

    def clear(self):
        self.now = None


def test_rows_wait_packed_and_are_told_in_order():
    handle = SimpleNamespace(items=Items(), one=One(), timers=[])
    handle.getListState, handle.getValueState, handle.registerTimer = lambda *_: handle.items, lambda *_: handle.one, handle.timers.append
    told = Changes(5.0)
    told.init(handle)
    n, second = 2 * PACK + 500, 1_000_000
    rows = [Row(us=k * second, event_id=k, body=None if k % 1000 == 7 else "a\n\"é") for k in range(n)]
    assert list(told.handleInputRows((3,), iter(rows[::-1]), None)) == []
    assert len(handle.items.items) == handle.items.calls == 3 and handle.timers == [0]
    at = lambda s: (SimpleNamespace(getCurrentWatermarkInMs=lambda: s * 1000), None)
    first = [(r.kind, r.us // second, r.body) for r in told.handleExpiredTimer((3,), *at(10))]
    assert first == [("Rise", 0, "a\n\"é"), ("Shift", 7, None), ("Shift", 8, "a\n\"é")] and len(handle.items.items) == 3
    rest = [(r.kind, r.us // second) for r in told.handleExpiredTimer((3,), *at(n + 10))]
    assert rest == [("Shift", k) for k in range(11, n) if k % 1000 in (7, 8)] + [("Fall", n + 4)] and not handle.items.items and handle.one.now is None
