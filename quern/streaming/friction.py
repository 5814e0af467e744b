"""Friction of sessions while their events arrive (an extension; batch results are the reference).

A stream cannot look back with windows, so here, and only here, a session is a state machine:
what a group holds is the few values that the next event needs and the counters of its skills.
Rows are updates: the latest row of a session and skill stands. A session whose events stay away
for longer than the watermark and ``idle`` allow is dropped from the state.

Within a batch events are put in order; an event that arrives in a later batch than its
successors counts where it arrives.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.operators.friction import NEAR_TURNS

OUTPUT = "store string, sid string, skill string, invocations bigint, retries bigint, corrections bigint, folded bigint"
STATE = "held string"


class Session:
    """State of one session: turns so far, the last detection, the open firing with its utterances, counters."""

    def __init__(self, held: str | None = None):
        v = json.loads(held) if held else {}
        self.turn, self.last, self.open, self.said, self.skills = v.get("turn", 0), v.get("last"), v.get("open"), v.get("said", 0), v.get("skills", {})

    def dump(self) -> str:
        return json.dumps({"turn": self.turn, "last": self.last, "open": self.open, "said": self.said, "skills": self.skills})

    def take(self, kind: str, skill: str | None, route: str | None) -> None:
        if kind == "turn":
            self.turn += 1
        elif kind == "text":
            self.said += self.open is not None
        elif kind == "fire":
            near = self.last is not None and self.last[0] == skill and self.turn - self.last[2] <= NEAR_TURNS
            folded = near and self.last[1] == "text" and route == "structural"
            self.last = [skill, route, self.turn]
            if folded:
                self.skills[self.open]["folded"] += 1
                return
            if self.open is not None and not near:
                self.skills[self.open]["corrections"] += max(self.said - (route == "text"), 0)
            row = self.skills.setdefault(skill, {"invocations": 0, "repeats": 0, "corrections": 0, "folded": 0})
            row["invocations"] += 1
            row["repeats"] += near
            self.open, self.said = skill, 0

    def rows(self) -> list[tuple]:
        """Counters as if the session ended now: utterances since the open firing go to its skill."""
        return [(s, r["invocations"], r["repeats"] + 1 if r["repeats"] else 0, r["corrections"] + (self.said if s == self.open else 0), r["folded"]) for s, r in sorted(self.skills.items())]


def live_session_skills(events: DataFrame, late: str = "1 hour", idle_ms: int = 6 * 3600 * 1000) -> DataFrame:
    """Updates of per-session skill counters for a stream ``store, sid, at, ord, kind, skill, route``."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        session = Session(state.get[0] if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["at", "ord"], kind="stable")
        for kind, skill, route in zip(rows["kind"], rows["skill"], rows["route"]):
            session.take(kind, skill, route)
        state.update((session.dump(),))
        state.setTimeoutTimestamp(max(int(rows["at"].max().timestamp() * 1000), state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame([(*key, *r) for r in session.rows()], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    stream = events.withWatermark("at", late).select("store", "sid", "at", F.col("ord").cast("bigint").alias("ord"), "kind", "skill", "route")
    return stream.groupBy("store", "sid").applyInPandasWithState(run, OUTPUT, STATE, "update", GroupStateTimeout.EventTimeTimeout)
