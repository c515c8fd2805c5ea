"""Editor documents as a stream: keyed state, debounce, saved changes (L.1-L.3, L.7-L.9)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "path string, seq long, op string, version int, text_hash string"
STATE = "version int, saved_hash string, live_hash string"
OUTPUT = "path string, version int, is_tracked boolean, is_dirty boolean, accepted int, dropped int"


def step(state: tuple | None, event: tuple) -> tuple[tuple | None, bool]:
    """One event on (version, saved hash, live hash) or None; whether it was accepted.

    open takes all; change loses to a newer version, and without text makes the document dirty without a snapshot; save
    has no version and marks the live text as saved, so an edit that came after the saved text stays dirty; close forgets.
    """
    op, version, text = event
    if op == "open":
        if state and version is not None and state[0] is not None and version < state[0]:
            return state, False
        return (version, text, text), True
    if state is None:
        return None, False
    if op == "change":
        if version is not None and state[0] is not None and version < state[0]:
            return state, False
        return (version, state[1], text), True
    if op == "save":
        return (state[0], state[2] if text is None else text, state[2]), True
    if op == "close":
        return None, True
    return state, False


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else None
    accepted = dropped = 0
    rows = pd.concat(frames).sort_values("seq")
    for op, version, text in zip(rows.op, rows.version, rows.text_hash, strict=True):
        clean = (op, None if pd.isna(version) else int(version), None if pd.isna(text) else text)
        now, ok = step(now, clean)
        accepted, dropped = accepted + ok, dropped + (not ok)
    if now is None:
        if state.exists:
            state.remove()
    else:
        state.update(now)
    dirty = now is not None and (now[2] is None or now[1] != now[2])
    yield pd.DataFrame({"path": [key[0]], "version": pd.array([now[0] if now else None], "Int32"), "is_tracked": [now is not None], "is_dirty": [dirty], "accepted": [accepted], "dropped": [dropped]})


def document_states(events: DataFrame) -> DataFrame:
    """L.1-L.3: the state of each path after every micro-batch that touched it; events in order of seq inside a batch."""
    return events.groupBy("path").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def debounced(triggers: DataFrame, quiet: str = "150 milliseconds", late: str = "10 seconds") -> DataFrame:
    """L.7: the last trigger of each quiet-bounded session of a path: session windows, so state ends with the watermark."""
    session = F.session_window("ts", quiet)
    return triggers.withWatermark("ts", late).groupBy("path", session).agg(F.max("ts").alias("ts"), F.count(F.lit(1)).alias("triggers")).select("path", "ts", "triggers")


def saved_packages(saves: DataFrame, files: DataFrame, reverse: DataFrame) -> DataFrame:
    """L.9: a stream of saved paths to the packages that each micro-batch must rebuild: stream-static joins.

    files: path, package_slot; reverse: root, package_slot (the closure of dependents, each its own root too).
    """
    return saves.join(files, "path").select(F.col("package_slot").alias("root")).join(reverse, "root").select("root", "package_slot")
