"""Runs over a stream of their events: a state for each run, and a timer for those that never finish."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from papertide.operators.runs import PATHS

FIELDS = ["week_id", "focus_raw", "focus_key", "source", *PATHS]
#: For each field when it was told last and what, beside the run's begin and end.
STATE = "begin_at timestamp, begin_seq long, finished_at timestamp, week_id string, focus_raw string, focus_key string, source string, " + ", ".join(f"{p}_at timestamp, {p}_seq long, {p} string" for p in PATHS)
OUT = "run_id long, week_id string, focus_raw string, focus_key string, source string, started_at timestamp, finished_at timestamp, gap_report_path string, hotspot_week_id string, proposal_report_path string, abandoned boolean"
#: The provider of state that this needs; set it on the session.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def none_of(value) -> bool:
    return value is None or value is pd.NaT or (isinstance(value, float) and value != value)


class Runs(StatefulProcessor):
    """One run's life cycle, as run_states folds it: each path keeps the last thing that was told, with its time, so that
    events may come in any order. Every batch with events of a begun run tells its state; a run that hasn't finished
    when the watermark passes its begin by `patience` is told once more, as abandoned."""

    def __init__(self, patience: timedelta):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.run = handle, handle.getValueState("run", STATE)
        self.names = [part.split()[0] for part in STATE.split(", ")]

    def read(self) -> dict:
        found = self.run.get() if self.run.exists() else None
        return dict(zip(self.names, found, strict=True)) if found else dict.fromkeys(self.names)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, had_begun = self.read(), False
        had_begun = state["begin_at"] is not None
        for batch in rows:
            for event in batch.to_dict("records"):
                self.take(state, {k: None if none_of(v) else v for k, v in event.items()})
        self.run.update(tuple(state[n] for n in self.names))
        if state["begin_at"] is None:
            return
        if not had_begun:
            due = state["begin_at"] + self.patience
            self.handle.registerTimer(int(pd.Timestamp(due).tz_localize("UTC").timestamp() * 1000) if pd.Timestamp(due).tz is None else int(pd.Timestamp(due).timestamp() * 1000))
        yield self.told(key[0], state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.read()
        if state["begin_at"] is not None and state["finished_at"] is None:
            yield self.told(key[0], state, True)

    def take(self, state: dict, event: dict) -> None:
        at, seq, kind = event["at"].to_pydatetime(), event["seq"], event["kind"]
        if kind == "insert":
            if state["begin_at"] is None or (at, seq) < (state["begin_at"], state["begin_seq"]):
                state.update({"begin_at": at, "begin_seq": seq, **{f: event[f] for f in ("week_id", "focus_raw", "focus_key", "source")}})
            return
        if kind == "finalize":
            state["finished_at"] = max(at, state["finished_at"] or at)
        tells = {"finalize": PATHS, "proposal": ("proposal_report_path",), "hotspot": ("hotspot_week_id",)}.get(kind, ())
        for path in tells:
            if (event[path] or kind == "hotspot") and (state[f"{path}_at"] is None or (at, seq) >= (state[f"{path}_at"], state[f"{path}_seq"])):
                state.update({path: event[path], f"{path}_at": at, f"{path}_seq": seq})

    def told(self, run_id: int, state: dict, abandoned: bool) -> pd.DataFrame:
        begin = (state["begin_at"], state["begin_seq"])
        late = lambda p: state[f"{p}_at"] is not None and (state[f"{p}_at"], state[f"{p}_seq"]) >= begin
        finished = state["finished_at"] if state["finished_at"] is not None and state["finished_at"] >= begin[0] else None
        row = {"run_id": run_id, **{f: state[f] for f in ("week_id", "focus_raw", "focus_key", "source")}, "started_at": begin[0], "finished_at": finished, **{p: state[p] if late(p) else None for p in PATHS}, "abandoned": abandoned}
        frame = pd.DataFrame([row])
        for column in ("started_at", "finished_at"):
            frame[column] = pd.to_datetime(frame[column])
        return frame


def run_updates(events: DataFrame, patience: timedelta = timedelta(days=7), late: str = "1 day") -> DataFrame:
    """The states of runs (OUT) as their events (EVENTS) arrive; the last one told of each run is its state.

    Events are those of run_states, with distinct (at, seq) in a run. The session's state store must be
    PROVIDER. State grows with the runs, by a row of fixed width each.
    """
    return events.withWatermark("at", late).groupBy("run_id").transformWithStateInPandas(statefulProcessor=Runs(patience), outputStructType=OUT, outputMode="Update", timeMode="EventTime")
