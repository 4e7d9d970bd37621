"""Rows cross to and from Python many at a time, and few bytes at a time."""

from tessella.sources import pages


def test_rendered_pages_go_on_together(spark, monkeypatch):
    batches = []

    def kept(rows, make=pages._rendered):
        batches.append(len(rows))
        return make(rows)

    monkeypatch.setattr(pages, "_rendered", kept)
    monkeypatch.setattr(pages, "PAGES", 50)

    class Uploads:
        """Runs the function that Spark would run in its workers."""

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            import pyarrow as pa

            content = [b"\n".join([b"x%d" % i] * (i % 30 + 1)) for i in range(100)]
            batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(100)]), pa.array(content)], names=["path", "content"])
            return [r for b in run([batch, batch]) for r in b.to_pylist()]

    got = pages.render_pages(Uploads(), lambda content, dpi: content.split(b"\n"))
    want = [{"path": str(i), "page": n, "image": b"x%d" % i} for _ in range(2) for i in range(100) for n in range(min(i % 30 + 1, 20))]
    assert got == want and len(batches) == -(-len(want) // 50)
    batches.clear()
    monkeypatch.setattr(pages, "PAGE_BYTES", 8)
    assert pages.render_pages(Uploads(), lambda content, dpi: content.split(b"\n")) == want and max(batches) <= 4


class States:
    """States in memory that count calls; each call is a round trip in Spark."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def getMapState(self, name, *_):  # noqa: N802
        return One(self, name, {})

    getValueState = getListState = getMapState  # noqa: N815

    def registerTimer(self, *_):  # noqa: N802
        self.calls += 1

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return 10_000_000


class One:
    def __init__(self, states, name, empty):
        self.s, self.name = states, name
        self.s.held.setdefault(name, empty)

    def _put(self, v):
        self.s.held[self.name] = v
        self.s.calls += 1

    def exists(self):
        self.s.calls += 1
        return bool(self.s.held[self.name])

    def get(self):
        self.s.calls += 1
        return self.s.held[self.name] or ()

    def clear(self):
        self._put({})

    update = put = _put

    def updateValue(self, k, v):  # noqa: N802
        self.s.calls += 1
        self.s.held[self.name][k] = v

    def removeKey(self, k):  # noqa: N802
        self.s.calls += 1
        del self.s.held[self.name][k]

    def containsKey(self, k):  # noqa: N802
        self.s.calls += 1
        return k in self.s.held[self.name]

    def iterator(self):
        for x in list(self.s.held[self.name].items()):
            self.s.calls += 1
            yield x


def test_states_of_streams_are_called_rarely():
    import pandas as pd

    from tessella.streaming import dispatch

    n = 5000
    d, states = dispatch.Dispatcher(1800, 3), States()
    d.init(states)
    f = pd.DataFrame({"micros": range(n), "seq": range(n), "event": ["SUBMIT", "ASK"] * (n // 2), "job": [i if i % 2 == 0 else None for i in range(n)], "worker": [None if i % 2 == 0 else f"w{i}" for i in range(n)]})
    assert list(d.handleInputRows((1,), iter([f, f[:0], f]), states)) == []  # the same events again count once
    got = pd.concat(d.handleExpiredTimer((1,), states, None))
    # all are queued, given out, and queued again when their leases end
    assert got["status"].value_counts().to_dict() == {"QUEUED": n, "RUNNING": n // 2} and list(got["place"]) == list(range(len(got)))
    assert not states.held["events"] and states.calls < 100

    a, states = dispatch.Announcer(1000), States()
    a.init(states)
    f = pd.DataFrame({"poll": [i % 20 for i in range(n)], "id": range(n), "type": "FAILED", "micros": range(n)})
    assert sum(map(len, a.handleInputRows((1,), iter([f]), states))) == n - n // 20 and states.calls < 100
    assert sum(map(len, a.handleInputRows((1,), iter([f.assign(poll=f["poll"] + 20)]), states))) == 0
