"""Beats of running records: the adaptive threshold walk as a stateful stream, a record's state being a second of samples.

A record's state is its last samples, as far back as a later candidate's surroundings reach, and the walk's levels, last
interval, last beat and missed candidate. A beat is emitted once, when its surroundings are complete; at the record's
last sample they end there. So the beats are those of the walk over the whole record, however the stream is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.sources.staging import share_package

STATE = "first long, tail array<double>, learned boolean, next long, signal double, noise double, interval double, missed long, height double, beat long"


@dataclass
class Walk:
    """The state of one record, and the walk's next steps. first: the place of tail's first sample."""

    first: int = 0
    tail: list[float] = field(default_factory=list)
    learned: bool = False
    next: int = 0
    signal: float = 0.0
    noise: float = 0.0
    interval: float = 0.0
    missed: int = -1
    height: float = 0.0
    beat: int = -1

    def feed(self, values: list[float], last: bool, fs: int) -> list[int]:
        """Places of the beats that these samples settle."""
        self.tail.extend(values)
        half, apart, learn = round(0.06 * fs), round(0.2 * fs), round(2.0 * fs)
        end = self.first + len(self.tail)
        # The first place whose envelope isn't complete yet: of slopes with a sample on both sides, unless the record ends.
        ready = end if last else end - 1 - half
        if (last and end < fs // 2) or (not self.learned and not last and ready < learn):
            return []
        start = max(self.next - apart, 0)
        envelope = self._envelope(start, ready, half, end, fs)
        if not self.learned:
            head = envelope[:learn]
            total = 0.0
            for v in head:
                total += v
            self.noise = total / len(head) * 0.5
            self.signal, self.learned = max(max(head) * 0.25, self.noise + 1e-12), True
        out: list[int] = []
        while self.next < (ready if last else ready - apart):
            i = self.next - start
            v = envelope[i]
            if v > 0 and v > max(envelope[max(i - apart, 0) : i], default=-1.0) and v >= max(envelope[i + 1 : i + 1 + apart], default=-1.0):
                self._candidate(self.next, v, fs, out)
            self.next += 1
        keep = max(self.next - apart - half - 1, self.first)
        del self.tail[: keep - self.first]
        self.first = keep
        return out

    def _envelope(self, start: int, ready: int, half: int, end: int, fs: int) -> list[float]:
        """The smoothed slope energy at places from start on."""
        x, first = self.tail, self.first

        def slope(i: int) -> float:
            return ((x[i + 1 - first] - x[i - 1 - first]) * (fs / 2.0)) ** 2 if 0 < i < end - 1 else 0.0

        low = max(start - half, 0)
        slopes, out = [slope(i) for i in range(low, min(ready + half, end))], []
        for i in range(start, ready):
            near, total = slopes[max(i - half, 0) - low : min(i + half, end - 1) - low + 1], 0.0
            for v in near:
                total += v
            out.append(total / len(near))
        return out

    def _candidate(self, at: int, height: float, fs: int, out: list[int]) -> None:
        limit, apart = self.noise + 0.25 * (self.signal - self.noise), 0.2 * fs
        last = self.beat
        late = self.missed >= 0 and last >= 0 and self.interval > 0 and at - last > 1.66 * self.interval and self.height > limit / 2 and self.missed - last > apart
        if late:
            out.append(self.missed)
            self.beat = self.missed
        taken = height > limit and (self.beat < 0 or at - self.beat > apart)
        if taken:
            if last >= 0 and not late:
                self.interval = 0.875 * self.interval + 0.125 * (at - last) if self.interval > 0 else float(at - last)
            self.signal = 0.125 * height + 0.875 * self.signal
            out.append(at)
            self.beat = at
        else:
            self.noise = 0.125 * height + 0.875 * self.noise
        if taken or late:
            self.missed, self.height = -1, 0.0
        elif height > self.height:
            self.missed, self.height = at, height


def beat_stream(samples: DataFrame, key: str, place: str, value: str, last: str, fs: int) -> DataFrame:
    """key, at: the beats of a stream of samples, which for each record arrive in order of their place.

    last: true on a record's last sample, whose state goes then. A record that never ends keeps its state of a second.
    """
    share_package(samples.sparkSession)
    kind = samples.schema[key].dataType.simpleString()

    def step(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        walk = Walk(*state.get) if state.exists else Walk()
        walk.tail = list(walk.tail)
        rows = pd.concat(list(parts)).sort_values(place)
        ended = bool(rows[last].any())
        found = walk.feed([float(v) for v in rows[value]], ended, fs)
        if ended:
            state.remove()
        else:
            state.update(astuple(walk))
        yield pd.DataFrame({key: [own[0]] * len(found), "at": found})

    return samples.select(key, place, value, last).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at long", STATE, "append", GroupStateTimeout.NoTimeout)
