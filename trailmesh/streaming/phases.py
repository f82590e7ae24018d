"""The phases of a replay as a stateful stream: hold and fade take their time, pauses stop the clock."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOLD_MS, FADE_MS = 6_000, 2_000
#: What an action needs to be more than ignored, and the phase it leads to.
TIMED = {"hold": (HOLD_MS, "fade"), "fade": (FADE_MS, "preparing")}
SCHEMA = "client string, at long, phase string, running boolean"


@dataclass
class Phases:
    """One client's machine: its phase, whether its clock runs, what has elapsed of a timed phase, and the time it was last moved to."""

    phase: str = "off"
    running: bool = False
    elapsed: int = 0
    now: int = 0

    def due(self) -> int | None:
        """When the phase ends by itself, if the clock runs."""
        return self.now + TIMED[self.phase][0] - self.elapsed if self.running and self.phase in TIMED else None

    def advance(self, at: int) -> list[tuple[int, str, bool]]:
        """Let time pass up to ``at``; what ends on its own by then."""
        made = []
        while (due := self.due()) is not None and due <= at:
            self.now, self.elapsed, self.phase = due, 0, TIMED[self.phase][1]
            made.append((due, self.phase, self.running))
        if self.running and self.phase in TIMED:
            self.elapsed += max(0, at - self.now)
        self.now = max(self.now, at)
        return made

    def act(self, at: int, action: str) -> list[tuple[int, str, bool]]:
        """Let time pass, then act: start, ready, finish, pause, resume, fail, exit. An action that doesn't fit is ignored."""
        made = self.advance(at)
        before = (self.phase, self.running)
        if action == "start":
            self.phase, self.running, self.elapsed = "preparing", True, 0
        elif action == "exit":
            self.phase, self.running, self.elapsed = "off", False, 0
        elif self.phase == "off":
            pass
        elif action == "ready" and self.phase == "preparing":
            self.phase = "replay"
        elif action == "finish" and self.phase == "replay":
            self.phase, self.elapsed = "hold", 0
        elif action == "pause":
            self.running = False
        elif action == "resume" and self.phase != "stopped":
            self.running = True
        elif action == "fail":
            self.phase, self.running = "stopped", False
        return made + ([(self.now, self.phase, self.running)] if (self.phase, self.running) != before else [])


class PhaseProcessor(StatefulProcessor):
    """Keeps a client's machine in two value states and a timer for the end of a timed phase, in event time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.phase = handle.getValueState("phase", "phase string, running boolean")
        self.clock = handle.getValueState("clock", "elapsed long, now long, timer long")

    def _load(self) -> tuple[Phases, int]:
        phase, clock = self.phase.get(), self.clock.get()
        return (Phases(phase[0], phase[1], clock[0], clock[1]), clock[2]) if phase and clock else (Phases(), -1)

    def _save(self, key: tuple, m: Phases, timer: int, fired: bool = False) -> None:
        due = m.due()
        if timer >= 0 and not fired and timer != due:
            self.handle.deleteTimer(timer)
        if due is not None and (fired or timer != due):
            self.handle.registerTimer(due)
        self.phase.update((m.phase, m.running))
        self.clock.update((m.elapsed, m.now, -1 if due is None else due))

    @staticmethod
    def _rows(key: tuple, made: list[tuple[int, str, bool]]) -> Iterator[pd.DataFrame]:
        if made:
            yield pd.DataFrame([(key[0], *x) for x in made], columns=["client", "at", "phase", "running"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        m, timer = self._load()
        batch = pd.concat(list(rows)).sort_values(["ms", "n"], kind="stable")
        made = [x for at, action in zip(batch["ms"], batch["action"], strict=True) for x in m.act(int(at), action)]
        self._save(key, m, timer)
        yield from self._rows(key, made)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        m, timer = self._load()
        # later rows are beyond the watermark, so all that is due by then happens now
        made = m.advance(max(at, timerValues.getCurrentWatermarkInMs())) if timer == at else []
        if timer == at:
            self._save(key, m, timer, fired=True)
        yield from self._rows(key, made)

    def close(self) -> None:
        pass


def phase_log(actions: DataFrame, late: str = "0 seconds") -> DataFrame:
    """Transitions (client, at, phase, running) of a stream of actions (client, ts, n, action).

    ``at`` is in milliseconds. A client's actions apply in the order of time and n; actions that are later than
    the watermark ``late`` are dropped, others that arrive after a later one apply at that one's time. Hold and fade end by
    event-time timers once the watermark has passed them, at the time they were due. A null client is a client; null actions are ignored.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). A client's actions of one batch are one task's.
    """
    from pyspark.sql import functions as F

    known = actions.where("ts IS NOT NULL AND action IS NOT NULL").select("client", "ts", "n", "action", F.unix_millis("ts").alias("ms"))
    return known.withWatermark("ts", late).groupBy("client").transformWithStateInPandas(PhaseProcessor(), SCHEMA, "append", "eventTime")
