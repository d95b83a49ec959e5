import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from echoloom.operators import limits as L
from echoloom.operators.ordering import global_rank, rolling
from echoloom.streaming.admission import admit_ordered, admit_stream
from echoloom.streaming.runs import run_available, stream_parquet

START = datetime(2024, 1, 1)


def sequential(rows, rule):
    """One plain pass per key."""
    out, logs, last, caps = {}, {}, {}, {}
    for i, key, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if isinstance(rule, L.Cooldown):
            ok = key not in last or (t - last[key]).total_seconds() >= rule.seconds
            if ok:
                last[key] = t
        elif isinstance(rule, L.SlidingLog):
            log = [x for x in logs.get(key, []) if x > t - timedelta(seconds=rule.seconds)]
            ok = len(log) < rule.limit
            logs[key] = log + [t] if ok else log
        else:
            count, until = caps.get(key, (0, None))
            if until is None or t >= until:
                count, until = 0, t + timedelta(seconds=rule.seconds)
            ok = count < rule.limit
            caps[key] = (count + ok, until)
        out[i] = ok
    return out


def events(n=600, seed=2):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c"]  # one key holds most rows
    return [(i, rng.choice(keys), START + timedelta(seconds=rng.choice([rng.randrange(20000), 60 * rng.randrange(200)]))) for i in range(n)]


@pytest.mark.parametrize("rule", [L.Cooldown(300), L.SlidingLog(3, 900), L.SlidingLog(20, 5000), L.HourlyCap(4, 1200)], ids=str)
def test_admission_equals_a_sequential_pass(spark, rule):
    rows = events()
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many small partitions
    try:
        got = {r["id"]: r["admitted"] for r in L.admit(df, "key", "ts", "id", rule).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == sequential(rows, rule)


@pytest.mark.parametrize("rule", [L.Cooldown(300), L.SlidingLog(3, 900), L.HourlyCap(4, 1200)], ids=str)
def test_stream_equals_batch_over_ordered_batches(spark, tmp_path, rule):
    rows = sorted(events(300, 4), key=lambda r: (r[2], r[0]))
    for part in range(3):
        piece = spark.createDataFrame(rows[part * 100 : part * 100 + 100], "id int, key string, ts timestamp_ntz").coalesce(1)
        piece.write.parquet(str(tmp_path / "in" / f"p{part}.parquet"))
    # one landed file per micro-batch, in time order
    import os
    import shutil

    landed = tmp_path / "landed"
    landed.mkdir()
    for part in range(3):
        folder = tmp_path / "in" / f"p{part}.parquet"
        source = next(f for f in folder.iterdir() if f.name.startswith("part-"))
        shutil.copy(source, landed / f"{part}.parquet")
        os.utime(landed / f"{part}.parquet", (1_700_000_000 + part, 1_700_000_000 + part))
    schema = spark.read.parquet(str(landed)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(landed))
    got = {r["id"]: r["admitted"] for r in run_available(admit_stream(stream, "key", "ts", "id", rule)).collect()}
    assert got == sequential(rows, rule)


def test_rank_and_rolling(spark):
    rng = random.Random(8)
    values = [rng.random() for _ in range(500)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(5)
    ranked = global_rank(df, ["v", "id"])
    assert [r["v"] for r in ranked.orderBy("rank").collect()] == sorted(values)
    from pyspark.sql import functions as F

    by_id = global_rank(df, ["id"])
    got = {r["rank"]: r["s"] for r in rolling(by_id, 4, "s", F.sum("v"), block=10).collect()}
    assert got == {i + 1: pytest.approx(sum(values[i - 3 : i + 1])) for i in range(3, 500)}


def test_events_without_a_time_are_not_admitted(spark):
    rows = [(1, "a", None), (2, "a", START), (3, None, START)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz")
    assert {r["id"]: r["admitted"] for r in L.admit(df, "key", "ts", "id", L.Cooldown(300)).collect()} == {1: False, 2: True, 3: True}


@pytest.mark.parametrize("rule", [L.Cooldown(120), L.HourlyCap(3, 500), L.HourlyCap(5, 0)], ids=str)
def test_a_key_of_64_partitions_takes_logarithmic_rounds(spark, monkeypatch, rule):
    rng = random.Random(6)
    rows = [(i, "hot" if i < 3900 else "z", START + timedelta(seconds=rng.choice([rng.randrange(60_000), 100 * rng.randrange(600)]))) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz")
    rounds, chains, found = [], [], L.window_starts

    def counted(functions, order, chain, known):
        chains.append(len(chain))
        out = found(functions, order, chain, known)
        rounds.append(out[1])
        return out

    monkeypatch.setattr(L, "window_starts", counted)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "66")
    try:
        got = {r["id"]: r["admitted"] for r in L.admit(df, "key", "ts", "id", rule).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == sequential(rows, rule)
    assert chains[0] > 50 and rounds[0] <= 7


def test_rules_step_by_step():
    """Any split of the events into pieces gives the flags of one pass, and functions of pieces give their states."""
    import numpy as np

    rng = np.random.default_rng(4)
    for rule in (L.Cooldown(5), L.HourlyCap(3, 7), L.HourlyCap(2, 0), L.SlidingLog(1, 9), L.SlidingLog(4, 6), L.SlidingLog(7, 40)):
        for _ in range(40):
            times = np.sort(rng.integers(0, 120, 60)) * L.SECOND
            flags, end = rule.step([], times)
            plain = sequential([(i, "k", START + timedelta(microseconds=int(t))) for i, t in enumerate(times)], rule)
            assert [bool(f) for f in flags] == [plain[i] for i in range(60)]
            cuts = sorted(rng.integers(0, 61, 3).tolist())
            state, joined = [], []
            for a, b in zip([0, *cuts], [*cuts, 60]):
                if hasattr(rule, "steps") and state and b > a:
                    after = L._after(*rule.steps(times[a:b]), b - a, (np.array([state[0]]), np.array([state[1]])))
                    assert [int(after[0][0]), int(after[1][0])] == rule.step(state, times[a:b])[1]
                part, state = rule.step(state, times[a:b])
                joined += part.tolist()
            assert joined == flags.tolist()
            if hasattr(rule, "settled") and rule.settled(times[20:]):
                late = [rule.step(s, times[20:])[1] for s in ([], times[:20][-rule.limit :].tolist(), [int(times[20])] * rule.limit)]
                seen = [[t for t in s if t > times[-1] - rule.seconds * L.SECOND] for s in late]
                assert seen[0] == seen[1] == seen[2]


def test_recent_requests_of_one_key(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, rng.choice(["hot"] * 5 + ["b", None]), START + timedelta(seconds=rng.randrange(3000))) for i in range(700)] + [(900, "hot", None)]
    df = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz").repartition(5)
    monkeypatch.setattr(L, "COUNT_ROWS", 20)
    got = {r["id"]: r["current_requests"] for r in L.recent_requests(df, "key", "ts", 300).collect()}
    want = {i: sum(k2 == k and t2 is not None and t - timedelta(seconds=300) < t2 <= t for _, k2, t2 in rows) for i, k, t in rows if t is not None}
    assert got == want


@pytest.mark.parametrize("rule", [L.Cooldown(300), L.SlidingLog(3, 900), L.HourlyCap(4, 1200)], ids=str)
def test_events_out_of_order_get_the_answers_of_the_batch(spark, tmp_path, rule):
    import os

    rows = sorted(events(240, 5), key=lambda r: (r[2], r[0]))
    late = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[2] + timedelta(seconds=late.randrange(3000)))  # up to 50 minutes late
    ends = [(9000, "end", START + timedelta(days=30)), (9001, "end", START + timedelta(days=60))]
    landed = tmp_path / "landed"
    for part, piece in enumerate([mixed[:80], mixed[80:160], mixed[160:], ends[:1], ends[1:]]):
        spark.createDataFrame(piece, "id int, key string, ts timestamp_ntz").coalesce(1).write.parquet(str(landed / f"{part}"))
        for f in (landed / f"{part}").iterdir():
            os.utime(f, (1_700_000_000 + part, 1_700_000_000 + part))
    stream = spark.readStream.schema("id int, key string, ts timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(landed))
    got = {r["id"]: r["admitted"] for r in run_available(admit_ordered(stream, "key", "ts", "id", rule, "60 minutes")).collect()}
    assert {i: a for i, a in got.items() if i < 9000} == sequential(rows, rule) and 9001 not in got


class _Handle:
    """The state of one key, as a stateful processor sees it; counts how often the waiting list is read."""

    def __init__(self):
        self.rows, self.values, self.reads, self.timers = [], {}, 0, set()

    def getListState(self, name, schema):
        self.appendValue, self.clear = self.rows.append, self.rows.clear
        return self

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows[:] = rows

    def get(self):
        self.reads += 1
        return iter(list(self.rows))

    def getValueState(self, name, schema):
        held = self.values

        class Value:
            exists = staticmethod(lambda: name in held)
            get = staticmethod(lambda: held[name])
            update = staticmethod(lambda value: held.__setitem__(name, value))
            clear = staticmethod(lambda: held.pop(name, None))

        return Value

    def registerTimer(self, at):
        self.timers.add(at)


def test_ordered_admission_reads_its_waiting_list_when_events_are_due():
    import types

    import pandas as pd

    from echoloom.streaming import admission

    rng, rule = np.random.default_rng(5), L.Cooldown(300)
    times = rng.integers(0, 40_000, 600) * L.SECOND
    handle, judge = _Handle(), admission._Ordered(rule, "bigint")
    judge.init(handle)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    for lo in range(0, 600, 20):  # 30 frames while the watermark stands still
        assert not list(judge.handleInputRows(("k",), iter([pd.DataFrame({"time": times[lo : lo + 20], "id": np.arange(lo, lo + 20)})]), at(0)))
    assert handle.reads == 0
    got = pd.concat([f for ms in (10_000_000, 10_000_000, 40_000_000) for f in judge.handleExpiredTimer(("k",), at(ms), None)])
    assert handle.reads == 2 and handle.timers
    order = np.lexsort((np.arange(600), times))
    flags, _ = rule.step([], times[order])
    assert got["id"].tolist() == order.tolist() and got["admitted"].tolist() == flags.tolist()


@pytest.mark.parametrize("rule", [L.Cooldown(300), L.HourlyCap(2), L.SlidingLog(2, 3600)], ids=str)
def test_stream_in_pieces_and_without_times(spark, tmp_path, monkeypatch, rule):
    """A key's rows of a batch are judged piece by piece as at once; events without a time are not admitted."""
    from echoloom.streaming import admission

    monkeypatch.setattr(admission, "PIECE", 7)
    rng = np.random.default_rng(3)
    moments = (np.datetime64("2024-01-01T00:00:00", "us") + rng.integers(0, 90_000, 100).astype("timedelta64[s]")).tolist()
    rows = [(i, "k", None if i % 10 == 9 else t) for i, t in enumerate(moments)]
    events = spark.createDataFrame(rows, "id int, key string, ts timestamp_ntz")
    events.coalesce(1).write.parquet(str(tmp_path / "landed"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "landed"))
    got = {r["id"]: r["admitted"] for r in run_available(admit_stream(stream, "key", "ts", "id", rule)).collect()}
    want = {r["id"]: r["admitted"] for r in L.admit(events, "key", "ts", "id", rule).collect()}
    assert got == want and len(got) == 100


@pytest.mark.parametrize("ids", [list(range(300)), [f"id {i} \u00e4" for i in range(300)]], ids=["numbers", "texts"])
def test_waiting_events_are_held_as_bytes_in_large_elements(ids, monkeypatch):
    """30 frames of one call make few elements of the waiting list, and a value of one is not a list of events."""
    import types

    import pandas as pd

    from echoloom.streaming import admission

    monkeypatch.setattr(admission, "PIECE", 100)
    rng, rule = np.random.default_rng(6), L.Cooldown(300)
    times = rng.integers(0, 30_000, 300) * L.SECOND
    handle, judge = _Handle(), admission._Ordered(rule, "bigint")
    judge.init(handle)
    at = lambda ms: types.SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
    frames = [pd.DataFrame({"time": times[lo : lo + 10], "id": ids[lo : lo + 10]}) for lo in range(0, 300, 10)]
    assert not list(judge.handleInputRows(("k",), iter(frames), at(0)))
    assert len(handle.rows) == 3 and all(isinstance(v, bytes) for row in handle.rows for v in row)
    got = pd.concat([f for ms in (10_000_000, 30_000_000) for f in judge.handleExpiredTimer(("k",), at(ms), None)])
    order = sorted(range(300), key=lambda i: (times[i], ids[i]))
    flags, _ = rule.step([], times[order])
    assert got["id"].tolist() == [ids[i] for i in order] and got["admitted"].tolist() == flags.tolist()
