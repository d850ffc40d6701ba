"""Episodes of sessions as their events arrive: the rules of ``operators.episodes.segment`` as a stateful stream.

One session's state is a row: its last time, the number of its open episode and what
that holds so far.  Each event is given its episode as it comes; an episode is told
as closed when the next one opens or when the watermark has passed a break after
its last event.  Events of a session must arrive in order, as an append-only log has
them; how they are cut into batches changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palimpsest.operators.episodes import BREAK_US

PROGRESS = ("tool-input", "tool-output", "error", "outcome")
#: what: ``event`` (its episode), ``opened`` or ``closed`` (bounds and counts of an episode).
OUTPUT = "session_id long, episode_no int, what string, event_id long, first_id long, last_id long, start_us long, end_us long, events long"
_STATE = "last_us long, episode_no int, had_goal boolean, moved boolean, first_id long, last_id long, start_us long, end_us long, events long, closed boolean"
_BLANK = (None, 0, False, None, None, None, None, None, 0, True)


class EpisodeState(StatefulProcessor):
    def __init__(self, break_us: int = BREAK_US) -> None:
        self.break_us = break_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("episode", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        session, out = int(key[0]), []
        last_us, number, had_goal, moved, first_id, last_id, start_us, end_us, events, closed = self.state.get() if self.state.exists() else _BLANK
        batch = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        for event, kind, us in zip(batch["event_id"].tolist(), batch["kind"].tolist(), batch["us"].tolist(), strict=True):
            us = None if us is None or us != us else int(us)
            goal, progress = kind == "goal", kind in PROGRESS
            gap = last_us is not None and us is not None and us - last_us >= self.break_us
            cut = number == 0 or (gap and (goal or progress))
            if cut or (goal and moved and had_goal):
                if number and not closed:
                    out.append((session, number, "closed", None, first_id, last_id, start_us, end_us, events))
                number, first_id, start_us, end_us, events, closed = number + 1, event, us, us, 0, False
            if cut:
                had_goal, moved = False, None
            had_goal = had_goal or goal
            moved = progress if goal or progress else moved
            last_us = last_us if us is None else us
            start_us = us if start_us is None or us is not None and us < start_us else start_us
            end_us = us if end_us is None or us is not None and us > end_us else end_us
            last_id, events, closed = event, events + 1, False
            out.append((session, number, "event", event, None, None, None, None, None))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if last_us is not None and not closed:
            self.handle.registerTimer((last_us + self.break_us) // 1000 + 1)
        self.state.update((last_us, number, had_goal, moved, first_id, last_id, start_us, end_us, events, closed))
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            *kept, closed = self.state.get()
            if not closed:
                _, number, _, _, first_id, last_id, start_us, end_us, events = kept
                self.state.update((*kept, True))
                yield _frame([(int(key[0]), number, "closed", None, first_id, last_id, start_us, end_us, events)])

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({c: "Int64" for c in names if c not in ("what", "episode_no")} | {"episode_no": "Int32"})


def episodes(stream: DataFrame, *, break_us: int = BREAK_US, late: str = "1 hour") -> DataFrame:
    """Events (session_id, event_id, kind, us) to ``OUTPUT`` rows; times may be null.

    Events later than the watermark are dropped, so ``late`` must cover how far sessions
    lie apart in the log.  An episode that a timer has closed goes on under its number if an event follows
    that opens no other, and is then told as closed again.
    """
    timed = stream.selectExpr("session_id", "event_id", "kind", "us", "timestamp_micros(us) AS _time").withWatermark("_time", late)
    return timed.groupBy("session_id").transformWithStateInPandas(EpisodeState(break_us), OUTPUT, "Append", "EventTime")
