"""Live meetings as keyed state with timers: idle tracks, marks that settle, the meeting's voices.

Each processor keeps typed state for a recording and is used by transformWithStateInPandas; what it decides is in plain
functions over ordered rows, which the batch queries call too.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from talkspark.operators import live

#: A track without rows for IDLE_AFTER_MS counts as covered up to IDLE_MS behind what the growing ones have.
IDLE_AFTER_MS, IDLE_MS = 1_500, 1_000
#: A mark is settled this long after it; given up that long after it.
SETTLE_MS, GIVE_UP_MS = 5_000, 15_000
#: The state store that typed state and timers need; changes go to the shared folder as a log, and no disk is allocated ahead, as there
#: is a store for each partition.
STORE = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.changelogCheckpointing.enabled": "true",
    "rocksdb.allowFAllocate": "false",
}


@contextmanager
def typed_state(spark: SparkSession) -> Iterator[None]:
    """Streams started within have typed state."""
    keys = {f"spark.sql.streaming.stateStore.{k}": v for k, v in STORE.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def in_order(frames: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


# ---- idle tracks -------------------------------------------------------------------------------------------------


@dataclass
class Covers:
    """How far each track is covered, has grown by rows of its own, and when it was heard last; began: the first hearing of all."""

    covered: dict[str, int] = field(default_factory=dict)
    grown: dict[str, int] = field(default_factory=dict)
    heard: dict[str, int] = field(default_factory=dict)
    began: int = 0

    def row(self, track: str, covered: int, now: int) -> None:
        self.heard[track] = now
        self.grown[track] = max(self.grown.get(track, covered), covered)
        self.covered[track] = max(self.covered.get(track, covered), covered)

    def follow_idle(self, now: int, tracks: tuple[str, ...]) -> None:
        idle = [t for t in tracks if now - self.heard.get(t, self.began) >= IDLE_AFTER_MS]
        growing = [self.grown[t] for t in tracks if t in self.grown and t not in idle]
        for t in idle if growing else []:
            self.covered[t] = max(self.covered.get(t, -1), max(growing) - IDLE_MS)

    def level(self, tracks: tuple[str, ...]) -> int:
        return min(self.covered.get(t, -1) for t in tracks)


class ReleaseWithIdle(StatefulProcessor):
    """Rows (recording, track, seq, start_ms, end_ms, covered_ms, heard_ms) to lines that are final: every track is covered past
    their start, or is idle. heard_ms is the clock of who reads the tracks; where that stands still, processing-time timers go on.
    Without idle, a track that is behind holds lines back as long as it is, and heard_ms isn't needed."""

    OUT = "recording bigint, track string, seq bigint, start_ms bigint, end_ms bigint, released_at bigint"

    def __init__(self, tracks: tuple[str, ...] = ("mic", "system"), idle: bool = True):
        self.tracks, self.idle = tracks, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.covers = handle.getMapState("covers", "track string", "covered_ms bigint, grown_ms bigint, heard_ms bigint")
        self.began = handle.getValueState("began", "ms bigint")
        self.pending = handle.getListState("pending", "track string, seq bigint, start_ms bigint, end_ms bigint")

    def load(self) -> Covers:
        c = Covers()
        if self.began.exists():
            c.began = self.began.get()[0]
            for (track,), (covered, grown, heard) in self.covers.iterator():
                c.covered[track] = covered
                if grown is not None:
                    c.grown[track], c.heard[track] = grown, heard
        return c

    def save(self, c: Covers) -> None:
        self.began.update((c.began,))
        for t, covered in c.covered.items():
            self.covers.updateValue((t,), (covered, c.grown.get(t), c.heard.get(t)))

    def hand_out(self, key: tuple, waiting: pd.DataFrame, levels: np.ndarray, at: np.ndarray) -> Iterator[pd.DataFrame]:
        """waiting (track, seq, start_ms, end_ms, since: place of its row); levels rise; at: what stands at each place."""
        place = np.maximum(np.searchsorted(levels, waiting["start_ms"].to_numpy(), side="right"), waiting["since"].to_numpy())
        done = place < len(levels)
        rest = waiting[~done]
        if len(rest):
            self.pending.put([tuple(r) for r in rest[["track", "seq", "start_ms", "end_ms"]].itertuples(index=False)])
        else:
            self.pending.clear()
        out = waiting[done].assign(released_at=at[place[done]], recording=key[0]).sort_values(["released_at", "start_ms", "end_ms"], kind="stable")
        yield out[["recording", "track", "seq", "start_ms", "end_ms", "released_at"]]

    def old(self) -> pd.DataFrame:
        return pd.DataFrame(list(self.pending.get()), columns=["track", "seq", "start_ms", "end_ms"]).assign(since=0)

    def wake(self, c: Covers, now: int) -> None:
        """A timer for when the first of the tracks that aren't covered as far as others may be idle."""
        if not self.idle:
            return
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        due = [c.heard.get(t, c.began) + IDLE_AFTER_MS for t in self.tracks if now - c.heard.get(t, c.began) < IDLE_AFTER_MS]
        if due:
            self.handle.registerTimer(max(min(due), now + 1))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["seq"])
        if not self.idle:
            new["heard_ms"] = 0
        c = self.load()
        if not self.began.exists():
            c.began = int(new["heard_ms"].iloc[0])
        levels = np.zeros(len(new), np.int64)
        for i, (track, covered, now) in enumerate(zip(new["track"], new["covered_ms"], new["heard_ms"], strict=True)):
            c.row(track, int(covered), int(now))
            if self.idle:
                c.follow_idle(int(now), self.tracks)
            levels[i] = c.level(self.tracks)
        waiting = pd.concat([self.old(), new[["track", "seq", "start_ms", "end_ms"]].assign(since=np.arange(len(new)))], ignore_index=True)
        yield from self.hand_out(key, waiting, levels, new["seq"].to_numpy())
        self.save(c)
        self.wake(c, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, c = timerValues.getCurrentProcessingTimeInMs(), self.load()
        c.follow_idle(now, self.tracks)
        last = self.old()
        yield from self.hand_out(key, last, np.array([c.level(self.tracks)]), np.array([last["seq"].max() if len(last) else 0]))
        self.save(c)
        self.wake(c, now)

    def close(self) -> None:
        pass


def released_stream(lines: DataFrame, tracks: tuple[str, ...] = ("mic", "system")) -> DataFrame:
    """Final lines of a stream of lines (recording, track, seq, start_ms, end_ms, covered_ms)."""
    return lines.groupBy("recording").transformWithStateInPandas(ReleaseWithIdle(tracks, False), ReleaseWithIdle.OUT, "append", "none")


def released_with_idle(lines: DataFrame, tracks: tuple[str, ...] = ("mic", "system")) -> DataFrame:
    return lines.groupBy("recording").transformWithStateInPandas(ReleaseWithIdle(tracks), ReleaseWithIdle.OUT, "append", "processingTime")


# ---- step batches ------------------------------------------------------------------------------------------------


class StepBatches(StatefulProcessor):
    """Lines (recording, seq, start_ms, end_ms) to batches of about `step`: a batch goes out with the line that makes it long enough, or
    `stale` after its first line came, so that a quiet meeting is worked on too."""

    OUT = "recording bigint, number bigint, seq bigint, start_ms bigint, end_ms bigint"

    def __init__(self, step: int = live.STEP_MS, stale: int = 60_000):
        self.step, self.stale = step, stale

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq bigint, start_ms bigint, end_ms bigint")
        self.number = handle.getValueState("number", "number bigint")

    def out(self, key: tuple, gone: list[tuple], number: int, rest: list[tuple]) -> pd.DataFrame:
        if rest:
            self.held.put(rest)
        else:
            self.held.clear()
        self.number.update((number,))
        return pd.DataFrame([(key[0], *x) for x in gone], columns=["recording", "number", "seq", "start_ms", "end_ms"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["start_ms", "seq"])
        number = self.number.get()[0] if self.number.exists() else 0
        rest, gone, waits = [tuple(x) for x in self.held.get()], [], self.held.exists()
        for line in zip(new["seq"].tolist(), new["start_ms"].tolist(), new["end_ms"].tolist(), strict=True):
            rest.append(line)
            if line[2] - rest[0][1] >= self.step:
                gone += [(number, *x) for x in rest]
                number, rest = number + 1, []
        if gone or not waits:  # another first line waits now, or none
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            if rest:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale)
        yield self.out(key, gone, number, rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number = self.number.get()[0]
        gone = [(number, *x) for x in self.held.get()]
        yield self.out(key, gone, number + bool(gone), [])

    def close(self) -> None:
        pass


def step_batches(lines: DataFrame, step: int = live.STEP_MS, stale: int = 60_000) -> DataFrame:
    return lines.groupBy("recording").transformWithStateInPandas(StepBatches(step, stale), StepBatches.OUT, "append", "processingTime")


# ---- marks -------------------------------------------------------------------------------------------------------


@dataclass
class Mark:
    mark: int
    at: int
    heard: dict[str, int] = field(default_factory=dict)

    def hear(self, voice: str, start: int, end: int) -> None:
        shared = min(self.at + live.REACH_AFTER, end) - max(self.at - live.REACH_BEFORE, start)
        if shared > 0:
            self.heard[voice] = max(self.heard.get(voice, 0), shared)

    def best(self) -> str | None:
        return max(self.heard, key=lambda v: self.heard[v]) if self.heard else None


def settle(waiting: list[Mark], reached: int, over: bool) -> tuple[list[tuple[int, str, str | None]], list[Mark]]:
    """(mark, state, voice) of marks that are settled now, and the rest. over: no more rows come up to `reached`, so that what was heard must do."""
    out, rest = [], []
    for m in waiting:
        if m.heard and (reached >= m.at + GIVE_UP_MS if over else reached >= m.at + SETTLE_MS):
            out.append((m.mark, "named", m.best()))
        elif reached >= m.at + GIVE_UP_MS:
            out.append((m.mark, "nobody", None))
        else:
            rest.append(m)
    return out, rest


def after_rows(waiting: list[Mark], rows: Iterable[tuple]) -> tuple[list[tuple[int, str, str | None]], list[Mark]]:
    """settle() along rows in order of time: marks (time, None, mark, ...) and windows (time, voice, start, end)."""
    out = []
    for time, voice, a, b in rows:
        done, waiting = settle(waiting, time - 1, True)  # what ran out before this row
        out += done
        if voice is None:
            waiting.append(Mark(a, time))
            continue
        for m in waiting:
            m.hear(voice, a, b)
        done, waiting = settle(waiting, time, False)
        out += done
    return out, waiting


class SettleMarks(StatefulProcessor):
    """Rows (recording, time_ms, voice, a, b, at): a mark has no voice and its number in a; a window that reaches time_ms has the
    voice's span in a and b. Each mark gets the voice heard most around it, at the first window SETTLE_MS after it or later; an
    event-time timer settles or gives up what has no such window by GIVE_UP_MS, so that no mark is kept for ever."""

    OUT = "recording bigint, mark bigint, state string, voice string"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "mark bigint, at_ms bigint, heard array<struct<voice:string,ms:bigint>>")

    def load(self) -> list[Mark]:
        return [Mark(m, at, {h[0]: h[1] for h in heard}) for m, at, heard in self.waiting.get()]

    def save(self, waiting: list[Mark]) -> None:
        if waiting:
            self.waiting.put([(m.mark, m.at, list(m.heard.items())) for m in waiting])
        else:
            self.waiting.clear()

    def told(self, key: tuple, done: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *d) for d in done], columns=["recording", "mark", "state", "voice"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["time_ms", "is_window", "a"])
        given = ((int(t), v if w else None, int(a), int(b)) for t, w, v, a, b in zip(new["time_ms"], new["is_window"], new["voice"], new["a"], new["b"], strict=True))
        done, waiting = after_rows(self.load(), given)
        self.save(waiting)
        self.wake(waiting)
        yield self.told(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # one timer for the first mark that runs out; the clock may have passed others since
        done, waiting = settle(self.load(), timerValues.getCurrentWatermarkInMs(), True)
        self.save(waiting)
        self.wake(waiting)
        yield self.told(key, done)

    def wake(self, waiting: list[Mark]) -> None:
        due, timers = min((m.at for m in waiting), default=-1) + GIVE_UP_MS, list(self.handle.listTimers())
        for t in timers:
            if not waiting or t != due:
                self.handle.deleteTimer(t)
        if waiting and due not in timers:
            self.handle.registerTimer(due)

    def close(self) -> None:
        pass


def settled_marks(rows: DataFrame) -> DataFrame:
    """rows: recording, at (event time), time_ms, is_window, voice, a, b, as SettleMarks takes them."""
    return rows.withWatermark("at", "0 seconds").groupBy("recording").transformWithStateInPandas(SettleMarks(), SettleMarks.OUT, "append", "eventTime")


# ---- voices ------------------------------------------------------------------------------------------------------


class PlaceVoices(StatefulProcessor):
    """Windows (recording, window_ix, track, speaker, embedding, talk, fresh) to the meeting's voices, which are typed list state: their
    prints grow over all batches. Rows out: placed windows, and each voice that grew as it is after the batch (kind)."""

    OUT = "recording bigint, kind string, window_ix bigint, track string, speaker string, voice string, score double, seconds double, print array<double>"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.voices = handle.getListState("voices", "track string, total array<double>, seconds double, window_ix bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = in_order(rows, ["window_ix", "track"])
        voices = [live.Voice(track, np.array(total, dtype=float), seconds, last) for track, total, seconds, last in self.voices.get()]
        before = [(v.seconds, v.last) for v in voices]
        given = zip(new["window_ix"], new["track"], new["speaker"], new["embedding"], new["talk"], new["fresh"], strict=True)
        placed = list(live.each_placed_voice(given, voices=voices))
        self.voices.put([(v.track, v.total.tolist(), v.seconds, v.last) for v in voices]) if voices else self.voices.clear()
        out = [(key[0], "placed", int(ix), track, speaker, voice, score, None, None) for ix, track, speaker, voice, score in placed]
        for i, v in enumerate(voices):
            if i >= len(before) or before[i] != (v.seconds, v.last):
                out.append((key[0], "voice", v.last, v.track, None, f"S{i + 1}", None, v.seconds, v.print.tolist()))
        yield pd.DataFrame(out, columns=["recording", "kind", "window_ix", "track", "speaker", "voice", "score", "seconds", "print"])

    def close(self) -> None:
        pass


def placed_voices(windows: DataFrame) -> DataFrame:
    return windows.groupBy("recording").transformWithStateInPandas(PlaceVoices(), PlaceVoices.OUT, "update", "none")
