"""Live status of jobs: a stream of partial updates, merged field by field."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructField, StructType

from corpusq.operators.evaluation import TERMINAL

#: The state store that keeps such state; the session must name it before it starts a query.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Merge(StatefulProcessor):
    """For each job and field the value of the greatest order so far, and that order. State goes `keep` ms after the last
    update of a job whose state is terminal."""

    def __init__(self, key: str, fields: list[str], order: list[str], state: str, schema: StructType, keep: int) -> None:
        self.key, self.fields, self.order, self.state, self.schema, self.keep = key, fields, order, state, schema, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        own = [StructField(f, self.schema[f].dataType) for f in self.fields]
        ages = [StructField(f"{f}__{o}", self.schema[o].dataType) for f in self.fields for o in self.order]
        self.now = handle.getValueState("now", StructType([*own, *ages]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = dict(zip([*self.fields, *(f"{f}__{o}" for f in self.fields for o in self.order)], self.now.get() if self.now.exists() else [None] * (len(self.fields) * (1 + len(self.order)))))
        for b in rows:
            for f in self.fields:
                given = b[b[f].notna()].sort_values(self.order, kind="stable")
                if len(given):
                    last = given.iloc[-1]
                    age, before = tuple(last[o] for o in self.order), tuple(held[f"{f}__{o}"] for o in self.order)
                    if None in before or pd.isna(before[0]) or age >= before:
                        held |= {f: plain(last[f], self.schema[f].dataType)} | {f"{f}__{o}": plain(a, self.schema[o].dataType) for o, a in zip(self.order, age)}
        self.now.update(tuple(held.values()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held[self.state] in TERMINAL:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep)
        yield pd.DataFrame([[*key, *(held[f] for f in self.fields)]], columns=[self.key, *self.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        yield from ()

    def close(self) -> None:
        pass


def plain(x, kind):
    """The Python value of a cell, which pandas may have made a float for its column's nulls."""
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime()
    return int(x) if isinstance(kind, IntegralType) else x.item() if hasattr(x, "item") else x


def live_status(updates: DataFrame, key: str, order: list[str], fields: list[str], state: str, keep_seconds: float = 3600) -> DataFrame:
    """A stream of updates -> a row for each job that a batch updates, with its fields so far.

    As in `latest_status`, later values overwrite earlier ones field by field, by `order` and not by arrival, and nulls
    overwrite nothing. A job in a terminal state is forgotten `keep_seconds` after its last update, so state holds running
    jobs and those that ended lately. Run it in update mode with a
    trigger of some seconds: the timers keep it running. The session's state store must be PROVIDER.
    """
    s = updates.schema
    out = StructType([StructField(key, s[key].dataType), *(StructField(f, s[f].dataType) for f in fields)])
    merge = Merge(key, fields, order, state, s, int(keep_seconds * 1000))
    return updates.groupBy(key).transformWithStateInPandas(merge, out, "update", "processingTime")
