"""Consultations as a stream: state for each user, closed lazily by the next turn."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CLOSED = "user_id string, session_no bigint, turns bigint, user_turns bigint, started timestamp, ended timestamp"


class Sessions(StatefulProcessor):
    """Keeps number, counts, begin and end of a user's open session; a turn after the gap emits it as closed."""

    def __init__(self, gap_hours: float):
        self.gap = pd.Timedelta(hours=gap_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "no bigint, turns bigint, user_turns bigint, started timestamp, ended timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(rows).sort_values(["ts", "turn_id"])
        no, n, users, started, ended = self.open.get() if self.open.exists() else (0, 0, 0, None, None)
        closed = []
        for role, ts in zip(turns["role"], turns["ts"]):
            if n and ts - pd.Timestamp(ended) >= self.gap:
                closed.append((key[0], no, n, users, started, ended))
                n = 0
            if not n:
                no, users, started = no + 1, 0, ts
            n, users, ended = n + 1, users + (role == "user"), ts
        self.open.update((no, n, users, pd.Timestamp(started).to_pydatetime(), pd.Timestamp(ended).to_pydatetime()))
        yield pd.DataFrame(closed, columns=["user_id", "session_no", "turns", "user_turns", "started", "ended"])

    def close(self) -> None:
        pass


def closed_sessions(turns: DataFrame, gap_hours: float = 6.0) -> DataFrame:
    """Closed sessions of a stream of turns (turn_id, user_id, role, ts); a user's last session stays in state.

    Turns of a user must reach the stream in order of time but within a batch; there is no timer, so who never returns is
    never closed. The session must use the RocksDB state store.
    """
    from pyspark.sql.types import _parse_datatype_string

    return turns.select("turn_id", "user_id", "role", "ts").groupBy("user_id").transformWithStateInPandas(Sessions(gap_hours), _parse_datatype_string(CLOSED), "append", "none")
