"""Admission rules on a stream, with the rule's small state kept per key.

`admit_stream` answers at once and takes time order inside a micro-batch only. `admit_ordered` answers when the
watermark has passed an event, so events that come out of order, within the delay, get the batch operator's answer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Events that a rule takes at a step, and that one element of a waiting list holds.
PIECE = 50_000


def _gathered(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Times of the timed rows, and ids of the timed rows followed by those of the others; nothing else of a batch is held."""
    times, ids, untimed = [], [], []
    for batch in batches:
        known = batch["time"].notna().to_numpy()
        times.append(batch["time"].to_numpy()[known].astype(np.int64))
        ids.append(batch["id"].to_numpy()[known])
        if not known.all():
            untimed.append(batch["id"].to_numpy()[~known])
    return (np.concatenate(times) if times else np.zeros(0, np.int64)), np.concatenate([*ids, *untimed]) if ids else np.zeros(0)


def _pieces(times: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the events in order of time and id, PIECE at a time."""
    ids = ids[: len(times)]
    plain = ids.dtype != object
    order = np.lexsort((ids, times)) if plain else pd.DataFrame({"time": times, "id": ids}).sort_values(["time", "id"]).index.to_numpy()
    for lo in range(0, len(order), PIECE):
        yield order[lo : lo + PIECE]


def admit_stream(events: DataFrame, key: str, time: str, id_col: str, rule) -> DataFrame:
    """(key, id, admitted) per event, the same rules as the batch operator.

    Between micro-batches only the rule's state is kept (at most `limit` times per key).
    Within one, a key's rows are taken in time order: a task holds the time and id of each and goes through them
    in pieces; the source's trigger size bounds them. Events without a time are not admitted.
    """
    rows = events.select(
        F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("time"), F.col(id_col).alias("id")
    )

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        end = list(state.get[0]) if state.exists else []
        times, ids = _gathered(batches)
        timed = len(times)
        for part in _pieces(times, ids):
            flags, end = rule.step(end, times[part])
            yield pd.DataFrame({"key": group[0], "id": ids[part], "admitted": flags})
        for lo in range(timed, len(ids), PIECE):  # events without a time
            yield pd.DataFrame({"key": group[0], "id": ids[lo : lo + PIECE], "admitted": False})
        state.update((end,))

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("key").applyInPandasWithState(
        step, f"key string, id {kind}, admitted boolean", "state array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
    return out.withColumnRenamed("id", id_col)


def _packed(times: np.ndarray, ids: np.ndarray) -> tuple[bytes, bytes]:
    """Events as two values of bytes, which a state store takes without a look at each event; no code is run to read them."""
    if ids.dtype.kind in "iuf":
        return times.astype("<i8").tobytes(), b"n" + ids.dtype.str.encode() + b"|" + ids.tobytes()
    return times.astype("<i8").tobytes(), b"j" + json.dumps(ids.tolist()).encode()


def _unpacked(times: bytes, ids: bytes) -> pd.DataFrame:
    times, ids = np.frombuffer(bytes(times), dtype="<i8"), bytes(ids)
    if ids[:1] == b"n":
        kind, _, held = ids[1:].partition(b"|")
        return pd.DataFrame({"time": times, "id": np.frombuffer(held, dtype=kind.decode())})
    return pd.DataFrame({"time": times, "id": pd.Series(json.loads(ids[1:]), dtype=object)})


class _Ordered(StatefulProcessor):
    """Events wait in a list until the watermark has passed them; then the rule takes them in order of time and id.

    The list holds what came in the last `delay` of event time, up to PIECE events an element as bytes, the values the time
    of the earliest and the rule's state. The list is read only when the watermark has passed the earliest. A timer there
    wakes the key, and one at the end of its state clears it.
    """

    def __init__(self, rule, kind: str):
        self.rule, self.kind = rule, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "time binary, id binary")
        self.earliest = handle.getValueState("earliest", "time bigint")
        self.held = handle.getValueState("held", "state array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        least = self.earliest.get()[0] if self.earliest.exists() else None
        came, held = None, []
        for frame in chain(rows, [None]):
            if frame is not None and len(frame):
                held.append((frame["time"].to_numpy(dtype=np.int64), frame["id"].to_numpy()))
                came = min(int(held[-1][0].min()), came) if came is not None else int(held[-1][0].min())
            if held and (frame is None or sum(len(t) for t, _ in held) >= PIECE):
                self.waiting.appendValue(_packed(*(np.concatenate(part) for part in zip(*held))))
                held = []
        if came is not None and (least is None or came < least):
            self.earliest.update((came,))
            yield from self._judged(key, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._judged(key, timerValues)

    def _judged(self, key, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        least = self.earliest.get()[0] if self.earliest.exists() else None
        state = list(self.held.get()[0]) if self.held.exists() else []
        if least is not None and least < passed:
            times, ids = _gathered(_unpacked(*element) for element in self.waiting.get())
            due = times < passed
            later, late_ids, times, ids = times[~due], ids[~due], times[due], ids[due]
            for part in _pieces(times, ids):
                flags, state = self.rule.step(state, times[part])
                yield pd.DataFrame({"key": key[0], "id": ids[part], "admitted": flags})
            least = int(later.min()) if len(later) else None
            if least is None:
                self.waiting.clear()
                self.earliest.clear()
            else:
                self.waiting.put([_packed(later[lo : lo + PIECE], late_ids[lo : lo + PIECE]) for lo in range(0, len(later), PIECE)])
                self.earliest.update((least,))
            self.held.update((state,))
        if state and least is None and self.rule.over(state) < passed:
            self.held.clear()
            return
        # a timer is over when the watermark is past it, in whole milliseconds
        wake = least if least is not None else self.rule.over(state) if state else None
        if wake is not None:
            self.handle.registerTimer(max(wake // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def close(self) -> None:
        pass


def admit_ordered(events: DataFrame, key: str, time: str, id_col: str, rule, delay: str = "10 minutes") -> DataFrame:
    """(key, id, admitted) of every event that the watermark, `delay` behind the newest event, has passed.

    Events older than the watermark at their arrival are dropped, as by any watermark; events without a time are, too.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    moment = F.col(time).cast("timestamp")
    rows = events.select(F.col(key).cast("string").alias("key"), moment.alias("moment"), F.unix_micros(moment).alias("time"), F.col(id_col).alias("id"))
    rows = rows.where("moment is not null").withWatermark("moment", delay)
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.groupBy("key").transformWithStateInPandas(
        statefulProcessor=_Ordered(rule, kind), outputStructType=f"key string, id {kind}, admitted boolean", outputMode="append", timeMode="eventTime",
    )
    return out.withColumnRenamed("id", id_col)
