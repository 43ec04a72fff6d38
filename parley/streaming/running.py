"""Running accuracy over a stream: rows may arrive in any order, results come in the order of their times."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The store that keyed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class RunningShare(StatefulProcessor):
    """For each key: rows wait until the watermark has passed their time, then the sums go on over them in order.

    State is what waits, the sums so far and the time of the one timer that is set.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ms long, pos long, hit boolean")
        self.sums = handle.getValueState("sums", "hits long, n long")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        """Have the earliest waiting row looked at when its time is over."""
        if self.timer.exists():
            if self.timer.get()[0] <= ms:
                return
            self.handle.deleteTimer(self.timer.get()[0])
        self.handle.registerTimer(ms)
        self.timer.update((ms,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendList(list(zip(new["ms"].tolist(), new["pos"].tolist(), new["hit"].tolist())))
        self._wake(int(new["ms"].min()))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        over = timerValues.getCurrentWatermarkInMs()
        rows = sorted(tuple(x) for x in self.waiting.get())
        ready, rest = [x for x in rows if x[0] <= over], [x for x in rows if x[0] > over]
        self.timer.clear()
        if rest:
            self.waiting.put(rest)
            self._wake(rest[0][0])
        else:
            self.waiting.clear()
        hits, n = self.sums.get() if self.sums.exists() else (0, 0)
        out = []
        for ms, pos, hit in ready:
            hits, n = hits + bool(hit), n + 1
            out.append((*key, pos, hits, n, hits / n))
        if out:
            self.sums.update((hits, n))
            yield pd.DataFrame(out, columns=self.columns)

    def __init__(self, columns: list[str]):
        self.columns = columns

    def close(self) -> None:
        pass


def running_share(rows: DataFrame, by: str, time: str, position: str, hit: str, late: str = "10 minutes", name: str = "share") -> DataFrame:
    """by, position, hits, n and the share of rows with a true `hit` up to this one, by time and then position, within `by`.

    rows is a stream with a timestamp `time`. A row is given out when no earlier one is expected any more: `late` after the
    latest time that was seen; what comes after that isn't counted, nor is anything up to the start of 1970, where the watermark begins. The session needs the settings of STORE.
    """
    taken = rows.withWatermark(time, late).select(
        F.col(by), F.col(time), F.unix_millis(time).alias("ms"), F.col(position).cast("long").alias("pos"), F.coalesce(F.col(hit), F.lit(False)).alias("hit"),
    )
    columns = [by, position, "hits", "n", name]
    kinds = [rows.schema[by].dataType, T.LongType(), T.LongType(), T.LongType(), T.DoubleType()]
    schema = T.StructType([T.StructField(*x) for x in zip(columns, kinds)])
    return taken.groupBy(by).transformWithStateInPandas(RunningShare(columns), schema, "append", "EventTime")
