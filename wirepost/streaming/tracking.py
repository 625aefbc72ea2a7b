"""Flows of segments that arrive in any order: state by key, timers for the order of frames, the steps of functions/tracking.py.

Rows wait in state until the watermark has passed them; then they are taken in the order of frames, as a batch would. State
is in the state store, so a query that starts again goes on where it stopped. Needs the RocksDB state store provider.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.tracking import Budget, Held, Pair, Recency, follow
from ..operators import flows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
GENERATIONS = "capture string, ip1 string, port1 int, ip2 string, port2 int, frame long, at timestamp, from_second boolean, generation int"
WAITING = "at long, frame long, syn boolean, ack boolean, rst boolean, seq long, size long, from_second boolean"
EVENTS = "capture string, flow string, first long, frame long, event string"


class Ordered(StatefulProcessor):
    """Keeps rows until the watermark has passed their time, then hands them to taken() in the order of frames."""

    waiting_schema = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in self.waiting_schema.split(", ")]
        earliest = None
        for part in rows:
            ms = part["at"].astype("datetime64[ms]").astype("int64")
            self.waiting.appendList([tuple(r) for r in part.assign(at=ms)[columns].astype(object).itertuples(index=False)])
            earliest = int(ms.min()) if earliest is None else min(earliest, int(ms.min()))
        if earliest is not None:
            self.handle.registerTimer(max(earliest + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in rows if r[0] < mark), key=lambda r: r[1])
        later = [r for r in rows if r[0] >= mark]
        if due:
            self.waiting.clear()
            if later:
                self.waiting.put(later)
        if later:
            self.handle.registerTimer(min(r[0] for r in later) + 1)
        if due:
            yield self.taken(key, due)

    def taken(self, key, rows: list[tuple]) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None:
        pass


class Generations(Ordered):
    waiting_schema = WAITING

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.pair = handle.getValueState("pair", "generation int, stands long, ended boolean, due1 long, due2 long")

    def taken(self, key, rows: list[tuple]) -> pd.DataFrame:
        pair = Pair(*self.pair.get()) if self.pair.exists() else Pair()
        out = []
        for at, frame, syn, ack, rst, seq, size, second in rows:
            pair = follow(pair, syn, ack, rst, seq, size, second)
            out.append((*key, frame, pd.Timestamp(at, unit="ms"), second, pair.generation))
        self.pair.update(tuple(pair))
        return pd.DataFrame(out, columns=[c.split()[0] for c in GENERATIONS.split(", ")])


class Table(Ordered):
    waiting_schema = "at long, frame long, flow string, size long"

    def __init__(self, budget: Budget) -> None:
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getMapState("held", "flow string", "first long, last long, size long, segments long, incomplete boolean")

    def taken(self, key, rows: list[tuple]) -> pd.DataFrame:
        before = {k[0]: Held(*v) for k, v in self.held.iterator()} if self.held.exists() else {}
        table = Recency(self.budget, before)
        out = [(key[0], f, first, frame, event) for _, frame, flow, size in rows for f, first, event in table.touch(flow, frame, size)]
        for flow in before.keys() - table.flows.keys():
            self.held.removeKey((flow,))
        for flow, held in table.flows.items():
            if before.get(flow) != held:
                self.held.updateValue((flow,), tuple(held))
        return pd.DataFrame(out, columns=[c.split()[0] for c in EVENTS.split(", ")])


def timed(segments: DataFrame, late: str) -> DataFrame:
    return segments.withColumn("at", F.timestamp_millis((F.col("ts") * 1000).cast("long"))).withWatermark("at", late)


def generations(segments: DataFrame, late: str = "1 hour") -> DataFrame:
    """A stream of GENERATIONS from a stream of segments (as sources.captures gives them) in any order within `late`.

    The state of an endpoint pair is its generation and four numbers, beside the rows that wait for the watermark; rows that
    come later than `late` aren't counted. The same generations as operators.flows.generations() gives a batch.
    """
    rows = timed(flows.paired(segments), late).withColumn("size", F.octet_length("payload").cast("long"))
    rows = rows.select(*flows.PAIR, "at", "frame", "syn", "ack", "rst", "seq", "size", "from_second")
    return rows.groupBy(*flows.PAIR).transformWithStateInPandas(Generations(), GENERATIONS, "Append", "EventTime")


def recency(segments: DataFrame, budget: Budget = Budget(), late: str = "1 hour") -> DataFrame:
    """A stream of EVENTS from a stream of segments (capture, flow, frame, size, ts), as operators.tracking.recency() gives a batch.

    The state of a capture is its table of flows, no larger than the budget, beside the rows that wait for the watermark.
    """
    rows = timed(segments, late).select(F.col("capture").cast("string").alias("capture"), "at", "frame", F.col("flow").cast("string").alias("flow"), F.col("size").cast("long").alias("size"))
    return rows.groupBy("capture").transformWithStateInPandas(Table(budget), EVENTS, "Append", "EventTime")
