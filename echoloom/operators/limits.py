"""Limits whose next answer depends on earlier answers, exact and in parallel.

Cooldowns, hourly caps and sliding request logs admit an event depending on the events
admitted before it. Rows are range-partitioned by (key, time), so a hot key lies in many
partitions.

Cooldowns and caps work by windows: the window after one that opened at time t opens at the first event
at or after t + seconds. In a partition these steps are pointers from event to event and are followed by
doubling. A partition that one key fills is a function from the window in force before it to the one in
force after it; it has a step for each window that may be open at its end. Functions of neighbours are
combined, then those of neighbouring pairs, and so on, and each round doubles the number of
partitions whose start is known: a key of 64 partitions takes 6 rounds.

Sliding logs run in all partitions with an empty start; a partition runs again only if its start was
wrong and may matter to its end. It cannot if somewhere in it a whole window of events is
admitted for certain (after a gap, or wherever requests stay below the limit), since from there on the log
is known. So the rounds are as many as a key has partitions in a row without such a place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from echoloom.operators.ordering import range_sorted
from echoloom.session import ensure_checkpoint_dir

SECOND = 1_000_000
#: Moments of a key that are summed in one task; one row for each such block is summed by key.
COUNT_ROWS = 100_000
_NEVER = np.iinfo(np.int64).min


def _openers(times: np.ndarray, start: int, wait: int) -> np.ndarray:
    """Which sorted events open a window, the first of them being `start`: pointers followed by doubling."""
    n = len(times)
    marked = np.zeros(n + 1, dtype=bool)
    marked[min(start, n)] = True
    jump = np.append(np.maximum(np.searchsorted(times, times + wait), np.arange(1, n + 1)), n)
    while True:
        reached = marked.copy()
        reached[jump[marked]] = True
        if (reached == marked).all():
            return marked[:n]
        marked, jump = reached, jump[jump]


@dataclass(frozen=True)
class HourlyCap:
    """At most `limit` events per window; a window opens at its first event. State: window end, events in it."""

    limit: int = 10
    seconds: int = 3600

    def over(self, state: list[int]) -> int:
        """From when on the state says nothing any more."""
        return state[0]

    def step(self, state: list[int], times: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """Flags of sorted events, and the state after them."""
        until, count = state if state else (_NEVER, 0)
        wait, n = self.seconds * SECOND, len(times)
        start = int(np.searchsorted(times, until))
        opened = np.flatnonzero(_openers(times, start, wait))
        place = np.arange(n)
        before = np.searchsorted(opened, place, side="right") - 1
        rank = np.where(before >= 0, place - (opened[before] if len(opened) else 0), place + count)
        if not len(opened):
            return rank < self.limit, [until, count + n] if state else []
        return rank < self.limit, [int(times[opened[-1]]) + wait, n - int(opened[-1])]

    def steps(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The end state by start state: a window end up to upto[i] leads to (until[i], count[i]); a later one stays."""
        wait, n = self.seconds * SECOND, len(times)
        jump = np.append(np.maximum(np.searchsorted(times, times + wait), np.arange(1, n + 1)), n)
        last, ahead = np.arange(n + 1), jump
        while (ahead[:n] < n).any():  # the last opener from each event on
            last = np.where(ahead < n, last[np.minimum(ahead, n)], last)
            ahead = ahead[ahead]
        last = last[:n]
        ends = np.append(np.flatnonzero(last[1:] != last[:-1]), n - 1) if n else np.zeros(0, int)
        return times[ends], times[last[ends]] + wait, n - last[ends]


@dataclass(frozen=True)
class Cooldown:
    """Admit when the last admitted event is at least `seconds` old: a cap of one event per window."""

    seconds: int = 300

    def over(self, state: list[int]) -> int:
        return state[0]

    def step(self, state: list[int], times: np.ndarray) -> tuple[np.ndarray, list[int]]:
        return HourlyCap(1, self.seconds).step(state, times)

    def steps(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return HourlyCap(1, self.seconds).steps(times)


@dataclass(frozen=True)
class SlidingLog:
    """Admit when fewer than `limit` events were admitted in the last `seconds`. State: the times of the last `limit` admitted."""

    limit: int = 100
    seconds: int = 3600

    def over(self, state: list[int]) -> int:
        return state[-1] + self.seconds * SECOND

    def step(self, state: list[int], times: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """The k-th admission comes at the first event after the one before it that is `seconds` after the
        (k - limit)-th, so `limit` of them follow at once from the last `limit`."""
        n, wait = len(times), self.seconds * SECOND
        admitted = np.zeros(n, dtype=bool)
        if self.limit <= 0 or not n:
            return admitted, list(state)
        log = np.full(self.limit, _NEVER // 2)
        if state:
            log[-len(state) :] = state[-self.limit :]
        order, at = np.arange(self.limit), -1
        while True:
            places = np.maximum.accumulate(np.maximum(np.searchsorted(times, log + wait), at + 1) - order) + order
            good = places[places < n]
            admitted[good] = True
            if len(good) < self.limit:
                log = np.concatenate([log[len(good) :], times[good]])
                return admitted, [int(t) for t in log if t > _NEVER // 2]
            log, at = times[good], int(good[-1])

    def settled(self, times: np.ndarray) -> bool:
        """Whether the state after these events is the same from whatever start."""
        n, wait = len(times), self.seconds * SECOND
        if self.limit <= 0:
            return True
        place = np.arange(n)
        first = np.searchsorted(times, times - wait, side="right")
        sure = (place - first < self.limit) & (times - wait >= times[0]) if n else np.zeros(0, bool)
        unsure = np.maximum.accumulate(np.where(sure, -1, place)) if n else place
        return bool((unsure < first).any())


def _runs(keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    if len(keys) == 0:
        return []
    cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
    edges = [0, *cuts.tolist(), len(keys)]
    return list(zip(edges[:-1], edges[1:]))


def _walk(batches: Iterator[pd.DataFrame], rule, starts: dict[int, list[int]]):
    """Run the rule over one sorted partition, batch by batch; yields (batch, flags, key, state)."""
    key, state, fresh = None, [], True
    for batch in batches:
        if len(batch) == 0:
            continue
        keys, times = batch["__key"].to_numpy(), batch["__time"].to_numpy()
        flags = np.zeros(len(batch), dtype=bool)
        if fresh:
            key, state, fresh = keys[0], list(starts.get(int(batch["__pid"].iloc[0]), [])), False
        for lo, hi in _runs(keys):
            if keys[lo] != key:
                key, state = keys[lo], []
            flags[lo:hi], state = rule.step(state, times[lo:hi])
        yield batch, flags, key, state


_ENDS = "pid int, first string, last string, n bigint, state array<bigint>, settled boolean, upto array<bigint>, until array<bigint>, count array<bigint>"


def _ends(rule, starts: dict[int, list[int]]):
    """One row for a partition: its keys, the state after it, and, if one key fills it, what the state depends on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = first = last = None
        state: list[int] = []
        held: list[np.ndarray] = []
        for batch, _, last, state in _walk(batches, rule, starts):
            if pid is None:
                pid, first = int(batch["__pid"].iloc[0]), batch["__key"].iloc[0]
            held = [*held, batch["__time"].to_numpy()] if first == last else []
        if pid is None:
            return
        times = np.concatenate(held) if held else np.zeros(0, np.int64)
        whole = first == last
        upto, until, count = rule.steps(times) if whole and hasattr(rule, "steps") else [np.zeros(0, np.int64)] * 3
        settled = not whole or (hasattr(rule, "settled") and rule.settled(times))
        yield pd.DataFrame({"pid": [pid], "first": [first], "last": [last], "n": [len(times)], "state": [state], "settled": [settled], "upto": [upto], "until": [until], "count": [count]})

    return run


def _after(upto: np.ndarray, until: np.ndarray, count: np.ndarray, n: int, state: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Window ends and counts after a partition, from those before it."""
    at = np.searchsorted(upto, state[0])
    inside = at < len(upto)
    safe = np.minimum(at, max(len(upto) - 1, 0))
    if not len(upto):
        return state[0], state[1] + n
    return np.where(inside, until[safe], state[0]), np.where(inside, count[safe], state[1] + n)


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Functions of a partition and what follows it, one after the other, as one function."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            until, count = _after(r.upto2, r.until2, r.count2, r.n2, (r.until, r.count))
            # window ends past the first partition meet the second one as they are
            more = r.upto2 > (r.upto[-1] if len(r.upto) else _NEVER)
            rows.append((r.pid, r.n + r.n2, np.append(r.upto, r.upto2[more]), np.append(until, r.until2[more]), np.append(count, r.count2[more])))
        yield pd.DataFrame(rows, columns=["pid", "n", "upto", "until", "count"])


def _evaluated(known: dict[int, list[int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                until, count = known[r.pid]
                after = _after(r.upto, r.until, r.count, r.n, (np.array([until]), np.array([count])))
                rows.append((r.pid, int(after[0][0]), int(after[1][0])))
            yield pd.DataFrame(rows, columns=["pid", "until", "count"])

    return run


def window_starts(functions: DataFrame, order: list[int], chain: dict[int, int], known: dict[int, list[int]]) -> tuple[dict[int, list[int]], int]:
    """({partition: state before it}, rounds) from the states before each key's second partition.

    `order` lists the partitions, `chain` says which key's chain a partition belongs to, beginning with the one
    in `known`. Every round looks up, in one job, as many states as are known, and combines the functions.
    """
    place = {pid: i for i, pid in enumerate(order)}
    span, rounds = 1, 0
    step_type = "pid int, n bigint, upto array<bigint>, until array<bigint>, count array<bigint>"
    functions = functions.select("pid", "n", "upto", "until", "count")
    while len(known) < len(chain):
        ahead = {}  # partition -> the one `span` further in its chain
        for pid in chain:
            to = place[pid] + span
            if to < len(order) and chain.get(order[to]) == chain[pid]:
                ahead[pid] = order[to]
        ask = {pid: known[pid] for pid in known if pid in ahead and ahead[pid] not in known}
        # one small row a partition, never a row an event
        found = functions.where(F.col("pid").isin(sorted(ask))).mapInPandas(_evaluated(ask), "pid int, until bigint, count bigint").collect()
        known |= {ahead[r["pid"]]: [r["until"], r["count"]] for r in found}
        rounds += 1
        if len(known) < len(chain):
            pairs = functions.sparkSession.createDataFrame(sorted(ahead.items()), "pid int, pid2 int")
            other = functions.select(*[F.col(c).alias(f"{c}2") for c in ("pid", "n", "upto", "until", "count")])
            both = functions.join(F.broadcast(pairs), "pid").join(other, "pid2")  # pairs: one row a partition
            functions = both.mapInPandas(_combined, step_type).checkpoint()
        span *= 2
    return known, rounds


def _window_starts(placed: DataFrame, rule) -> dict[int, list[int]]:
    table = placed.mapInPandas(_ends(rule, {}), _ENDS).checkpoint()
    rows = {r["pid"]: r for r in table.select("pid", "first", "last", "n", "state").collect()}  # one small row a partition
    order = sorted(rows)
    chain: dict[int, int] = {}
    known: dict[int, list[int]] = {}
    for before, pid in zip(order[:-1], order[1:]):
        if rows[before]["last"] != rows[pid]["first"]:
            continue
        if before in chain and rows[before]["first"] == rows[before]["last"]:
            chain[pid] = chain[before]
        else:  # the key begins in `before`, so the state after it is right
            chain[pid], known[pid] = pid, list(rows[before]["state"])
    return window_starts(table, order, chain, known)[0] if chain else {}


def _log_starts(placed: DataFrame, rule) -> dict[int, list[int]]:
    starts: dict[int, list[int]] = {}

    def ends(only: set[int] | None) -> dict:
        source = placed if only is None else placed.where(F.col("__pid").isin(sorted(only)))
        found = source.mapInPandas(_ends(rule, starts), _ENDS).collect()  # one row a partition with `limit` times
        return {r["pid"]: r for r in found}

    done = ends(None)
    while True:
        changed = set()
        order = sorted(done)
        for before, pid in zip(order[:-1], order[1:]):
            want = list(done[before]["state"]) if done[before]["last"] == done[pid]["first"] else []
            if want != starts.get(pid, []):
                starts[pid] = want
                changed.add(pid)
        again = {pid for pid in changed if not done[pid]["settled"]}
        if not again:
            return starts
        done.update(ends(again))


def admit(events: DataFrame, key: str, time: str, id_col: str, rule) -> DataFrame:
    """Events with an `admitted` flag; equal times are taken in id order, events without a time are not admitted."""
    ensure_checkpoint_dir(events.sparkSession)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(F.col(key).cast("string").alias("__key"), micros.alias("__time"), F.col(id_col).alias("__id"))
    untimed = rows.where("__time is null").select(F.col("__id").alias(id_col), F.lit(False).alias("admitted"))
    placed = range_sorted(rows.where("__time is not null"), ["__key", "__time", "__id"])
    starts = (_window_starts if hasattr(rule, "steps") else _log_starts)(placed, rule)

    def flag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch, flags, _, _ in _walk(batches, rule, starts):
            yield pd.DataFrame({"__id": batch["__id"], "admitted": flags})

    kind = rows.schema["__id"].dataType.simpleString()
    return placed.mapInPandas(flag, f"__id {kind}, admitted boolean").withColumnRenamed("__id", id_col).unionByName(untimed)


def admit_by_class(events: DataFrame, key: str, kind: str, time: str, id_col: str, limits: dict[str, int], seconds: int = 3600) -> DataFrame:
    """(id, admitted, limit, remaining) of requests under the limit of their class; a class without one has that of `default`.

    Every key has a log for each class. remaining is what the class leaves after the request's moment: nothing
    for a rejected one. Requests without a time are rejected. One pass for each of the few limits.
    """
    named = F.when(F.col(kind).isin(sorted(limits)), F.col(kind)).otherwise("default")
    rows = events.select(F.col(id_col).alias("__id"), F.col(time).alias("__moment"), named.alias("__class"), F.to_json(F.struct(F.col(key).cast("string").alias("k"), named.alias("c"))).alias("__log"))
    flags = [admit(rows.where(F.col("__class") == c), "__log", "__moment", "__id", SlidingLog(limit, seconds)) for c, limit in sorted(limits.items())]
    judged = rows.join(reduce(DataFrame.unionByName, flags), "__id")
    limit = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])[F.col("__class")]
    taken = recent_requests(judged.where("admitted"), "__log", "__moment", seconds).select("__id", (limit - F.col("current_requests")).alias("left"))
    out = judged.join(taken, "__id", "left")
    return out.select(F.col("__id").alias(id_col), "admitted", limit.alias("limit"), F.greatest(F.lit(0), F.coalesce("left", F.lit(0))).alias("remaining"))


def recent_requests(events: DataFrame, key: str, time: str, seconds: int = 3600) -> DataFrame:
    """Requests in the last `seconds` up to each request, rejected ones and those of the same moment included.

    The number of a key's requests up to some moment is its rows in earlier range partitions plus its
    rows before that moment in one partition. So the count is the rank of the last request of the moment less
    the rank of the last one `seconds` earlier, and both come from distinct moments: counts combine on the map side,
    and a key that fills many partitions is spread over all of them.
    """
    rows = events.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("__k", F.col(key).cast("string"))
    # a moment adds its requests, and takes them away again when they are `seconds` old
    moments = rows.where("__t is not null").groupBy("__k", "__t").agg(F.count("*").alias("n"))
    old = moments.select("__k", (F.col("__t") + seconds * SECOND).alias("__t"), (-F.col("n")).alias("n"))
    changes = moments.unionByName(old).groupBy("__k", "__t").agg(F.sum("n").alias("n"))
    placed = range_sorted(changes, ["__k", "__t"])
    inside = W.partitionBy("__k", "__block").orderBy("__t")
    placed = placed.withColumn("__block", F.struct("__pid", F.floor(F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) / COUNT_ROWS).alias("part")))
    sums = placed.groupBy("__k", "__block").agg(F.sum("n").alias("n"))
    before = W.partitionBy("__k").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select(F.col("__k").alias("__key"), F.col("__block").alias("__of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    running = placed.withColumn("running", F.sum("n").over(inside))
    same = F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__block") == F.col("__of"))
    counts = running.join(offsets, same).select(F.col("__k").alias("__key"), F.col("__t").alias("__at"), (F.col("running") + F.col("offset")).alias("current_requests"))
    met = rows.join(counts, F.col("__k").eqNullSafe(F.col("__key")) & (F.col("__t") == F.col("__at")))
    return met.drop("__t", "__k", "__key", "__at")


def rate_info(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("limit", F.lit(limit)).withColumn("remaining", F.greatest(F.lit(0), F.lit(limit) - F.col("current_requests")))
