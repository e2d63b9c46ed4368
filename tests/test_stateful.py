"""Streams whose state leaves by timers, over several micro-batches."""
from pressgrid import session
from pressgrid.streaming import jobs as J, stateful as S

from collections import Counter

from pyspark.sql import Row

from test_jobs import click, stream_of


def shown(t, *articles, name="s"):
    items = ", ".join(f'{{"article_id": "{a}", "position": {k}}}' for k, a in enumerate(articles))
    return (name, "u", "impression", None, f'{{"source": "main", "articles": [{items}]}}', f"2024-01-01T{t}")


def state_of(spark, name, variable):
    path = next(p for p in session._written if f"/{name}-" in p)
    return spark.read.format("statestore").option("stateVarName", variable).load(path + "-cp")


def run(spark, stream, name):
    with S.rocksdb_state(spark):
        return J.run_update(stream, name)


def test_batches_close_by_timer_and_take_late_items(spark, tmp_path):
    files = [[shown("10:00:00.000", "a", "b"), shown("10:00:00.600", "c"), shown("10:00:00.000", "q", name="other")],
             [shown("10:00:00.300", "d")],  # late: it joins both batches to one
             [shown("10:05:00.000", "e")], [shown("10:05:00.100", "x")],  # the watermark passes the first ones, a batch later
             [shown("10:00:00.100", "too late"), shown("10:05:00.349", "f"), shown("10:05:00.699", "g")]]
    updates = run(spark, S.impression_batches(J.impression_items(stream_of(spark, tmp_path, files))), "timed")
    got = {(r.session_id, str(r.opened_at)[11:], str(r.closed_at)[17:], "".join(i.article_id for i in r.articles), r.is_open) for r in S.settled(updates).collect()}
    assert got == {("s", "10:00:00", "00.950000", "abcd", False), ("other", "10:00:00", "00.350000", "q", False),
                   ("s", "10:05:00", "00.699000", "efx", True), ("s", "10:05:00.699000", "01.049000", "g", True)}
    left = state_of(spark, "timed", "items").select("key.session_id", "list_element.article_id").collect()
    assert sorted((r.session_id, r.article_id) for r in left) == [("s", "e"), ("s", "f"), ("s", "g"), ("s", "x")]


def test_quiet_subjects_leave_the_state(spark, tmp_path):
    day = lambda d, user, article: (*click("10:00:00", article, user)[:-1], f"2024-{d}T10:00:00")
    files = [[day("01-01", "old", "a1"), day("01-02", "old", "a2"), day("01-02", "new", "b1")], [day("01-20", "new", "b2")], [day("02-15", "new", "b3")], [day("02-16", "new", "b4")], [day("02-17", "old", "a3")]]
    updates = run(spark, S.history_state(stream_of(spark, tmp_path, files), keep_days=30, delay="2 days"), "quiet")
    rows = sorted((r.subject, r.pos, r.article_id) for r in J.latest_state(updates).collect())
    assert rows == [("user:new", 1, "b4"), ("user:new", 2, "b3"), ("user:new", 3, "b2"), ("user:new", 4, "b1"), ("user:old", 1, "a3")]  # its list starts again
    left = state_of(spark, "quiet", "reads").select("key.subject", "list_element.article_id").collect()
    assert sorted((r.subject, r.article_id) for r in left) == [("user:new", "b1"), ("user:new", "b2"), ("user:new", "b3"), ("user:new", "b4"), ("user:old", "a3")]
    newest = state_of(spark, "quiet", "newest").count()
    assert newest == 2


def test_settings_come_back(spark):
    before = spark.conf.get(S._PROVIDER, None)
    with S.rocksdb_state(spark):
        assert spark.conf.get(S._PROVIDER) == S._ROCKSDB
    assert spark.conf.get(S._PROVIDER, None) == before


class Calls:
    """A state handle that counts its calls: each is a trip to the state store."""

    def __init__(self):
        self.n, self.values, self.timers = Counter(), {}, set()

    def getListState(self, name, schema):
        return State(self, name, [])

    def getValueState(self, name, schema):
        return State(self, name, None)

    def registerTimer(self, t):
        self.n["timer"] += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.n["timer"] += 1
        self.timers.discard(t)

    def listTimers(self):
        self.n["list"] += 1
        return iter(list(self.timers))


class State:
    def __init__(self, calls, name, empty):
        self.calls, self.name, self.empty = calls, name, empty

    def get(self):
        self.calls.n["get"] += 1
        return self.calls.values.get(self.name, self.empty)

    def exists(self):
        self.calls.n["get"] += 1
        return self.name in self.calls.values

    def put(self, value):
        self.calls.n["put"] += 1
        self.calls.values[self.name] = value

    update = put

    def clear(self):
        self.calls.n["put"] += 1
        self.calls.values.pop(self.name, None)


class Times:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_new_subject_takes_few_trips_to_the_state():
    calls, work = Calls(), S._History(2, 1000)
    work.init(calls)
    rows = [Row(created_at=c, article_id=a, ms=ms) for c, a, ms in (("t1", "a", 1), ("t3", "b", 3), ("t2", "c", 2))]
    got = [(r.pos, r.article_id, r.created_at) for r in work.handleInputRows(("s",), iter(rows), Times(0))]
    assert got == [(1, "b", "t3"), (2, "c", "t2")] and calls.timers == {1003}
    assert not calls.n["list"] and sum(calls.n.values()) <= 4
    list(work.handleInputRows(("s",), iter([Row(created_at="t9", article_id="d", ms=900)]), Times(500)))
    assert calls.timers == {1003}
    calls.timers.clear()  # it fires, and Spark deletes it
    list(work.handleExpiredTimer(("s",), Times(1004), None))
    assert calls.timers == {1900} and calls.values["newest"] == (900,)
    list(work.handleExpiredTimer(("s",), Times(1900), None))
    assert not calls.values


def test_a_new_impression_takes_few_trips_to_the_state():
    calls, work = Calls(), S._Batches(350)
    work.init(calls)
    rows = [Row(t=1000, article_id="a", position=0), Row(t=2000, article_id="b", position=None)]
    got = list(work.handleInputRows(("s", "c"), iter(rows), Times(0)))
    assert [(r.opened_us, r.closed_us, len(r.articles), r.is_open) for r in got] == [(1000, 352000, 2, True)]
    assert calls.timers == {352} and not calls.n["list"] and sum(calls.n.values()) <= 3
    got = list(work.handleExpiredTimer(("s", "c"), Times(352), None))
    assert [r.is_open for r in got] == [False] and not calls.values and not calls.n["list"] and sum(calls.n.values()) <= 5
