"""Cooldown of event streams: a source's first event opens a window, later ones merge into it, one event leaves when it ends."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import EVENT, GENERATE


def _list(value) -> list:
    return [] if value is None else list(value)


def merge(held: dict | None, event: dict) -> dict:
    """What two events of a source are together, the earlier one first."""
    if held is None:
        return {**event, "affected_zooms": sorted(set(_list(event["affected_zooms"]))), "layers_affected": sorted(set(_list(event["layers_affected"])))}
    if event["event"] == GENERATE:
        return {**event, "affected_zooms": [], "layers_affected": []}
    if held["event"] == GENERATE:
        return held
    union = lambda k: sorted({*held[k], *_list(event[k])})
    return {**held, "tiles_updated": held["tiles_updated"] + event["tiles_updated"], "affected_zooms": union("affected_zooms"), "layers_affected": union("layers_affected")}


class Cooldown(StatefulProcessor):
    """Holds one merged event for each source until its window ends."""

    def __init__(self, seconds: float):
        self.milliseconds = int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", EVENT)

    def _read(self) -> dict | None:
        if not self.held.exists():
            return None
        return dict(zip([f.split()[0] for f in EVENT.split(", ")], self.held.get(), strict=True))

    def _frame(self, event: dict) -> pd.DataFrame:
        return pd.DataFrame({k: [event[k]] for k in (f.split()[0] for f in EVENT.split(", "))})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._read()
        if held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.milliseconds)
        for frame in rows:
            for event in frame.to_dict("records"):
                event = {k: None if not isinstance(v, (list, tuple)) and not hasattr(v, "tolist") and pd.isna(v) else v for k, v in event.items()}
                for k in ("duration_ms", "tiles_updated", "max_zoom"):
                    event[k] = None if event[k] is None else int(event[k])
                held = merge(held, {k: event.get(k) for k in (f.split()[0] for f in EVENT.split(", "))})
        self.held.update(tuple(held.values()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._read()
        if held is not None:
            self.held.clear()
            yield self._frame(held)

    def close(self) -> None:
        pass


def cooled(events: DataFrame, seconds: float | None) -> DataFrame:
    """The stream of merged events; without a cooldown, the events as they are. Needs the RocksDB state store."""
    if not seconds:
        return events
    return events.groupBy("source").transformWithStateInPandas(statefulProcessor=Cooldown(seconds), outputStructType=EVENT, outputMode="Update", timeMode="processingTime")
