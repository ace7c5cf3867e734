"""Frames of many cameras, of which a detector takes the latest whenever it is free.

A camera has one frame in flight: a frame starts when it arrives, if the detector of its
camera is free, and keeps it busy for a time. Frames that arrive meanwhile wait, of which
only the latest is kept; the others are dropped, and counted. When the detector is free
again, the waiting frame starts. Each started frame tells how many were dropped so far and the
rate of starts over the last n. All of it goes by the frames' own times, so a stream gives
what a table does, whatever its batches are.

Frames of a camera count in order of time, then number. A stream takes a camera's frames as
they come in order; those that are older than one that was taken already are dropped and
counted. Null cameras, times or numbers are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What a started frame has, behind its camera: times are in microseconds.
OUT = "frame long, arrived long, started long, dropped long, rate double"


@dataclass
class Camera:
    """What is kept of a camera: as much as n starts."""

    free: int | None = None  # when the detector is free again
    waiting: tuple[int, int] | None = None  # time and number of the frame that waits
    last: tuple[int, int] | None = None  # the last frame that was taken
    dropped: int = 0
    starts: list[int] = field(default_factory=list)

    def _start(self, frame: tuple[int, int], at: int, busy: int, n: int) -> tuple:
        self.starts = [*self.starts, at][-n:]
        self.free = at + busy
        span = at - self.starts[0]
        rate = (n - 1) * 1e6 / span if len(self.starts) == n and span > 0 else None
        return frame[1], frame[0], at, self.dropped, rate

    def take(self, frame: tuple[int, int], busy: int, n: int) -> list[tuple]:
        """The frames that start before or by the arrival of this one (time and number)."""
        out = []
        if self.last is not None and frame < self.last:
            self.dropped += 1
            return out
        self.last = frame
        if self.waiting is not None and frame[0] > self.free:
            waiting, self.waiting = self.waiting, None
            out.append(self._start(waiting, self.free, busy, n))
        if self.free is None or (self.waiting is None and frame[0] >= self.free):
            out.append(self._start(frame, frame[0], busy, n))
        else:
            self.dropped += self.waiting is not None
            self.waiting = frame
        return out

    def finish(self, busy: int, n: int) -> list[tuple]:
        """The frame that still waits, which starts when the detector is free."""
        if self.waiting is None:
            return []
        waiting, self.waiting = self.waiting, None
        return [self._start(waiting, self.free, busy, n)]


def _lean(frames: DataFrame, camera: str, time: str, frame: str) -> DataFrame:
    lean = frames.select(F.col(camera).alias("camera"), F.unix_micros(F.col(time).cast("timestamp")).alias("arrived"), F.col(frame).cast("long").alias("frame"))
    return lean.where("camera IS NOT NULL AND arrived IS NOT NULL AND frame IS NOT NULL")


def _schema(frames: DataFrame, camera: str) -> T.StructType:
    return T.StructType([T.StructField("camera", frames.schema[camera].dataType), *T.StructType.fromDDL(OUT).fields])


def taken(frames: DataFrame, camera: str, time: str, frame: str, busy: int, n: int) -> DataFrame:
    """camera, frame, arrived, started, dropped and rate of the frames of a table that a detector takes.

    A task walks its cameras in order of time and holds one batch of rows, not a camera.
    """
    schema = _schema(frames, camera)
    ordered = _lean(frames, camera, time, frame).repartition("camera").sortWithinPartitions("camera", "arrived", "frame")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, Camera()
        for pdf in batches:
            out = []
            for c, at, number in pdf.itertuples(index=False):
                if c != name:
                    out += [(name, *r) for r in state.finish(busy, n)]
                    name, state = c, Camera()
                out += [(c, *r) for r in state.take((at, number), busy, n)]
            yield _frame(out, schema)
        yield _frame([(name, *r) for r in state.finish(busy, n)], schema)

    return ordered.mapInPandas(walk, schema)


def _frame(rows: list[tuple], schema: T.StructType) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=schema.names).astype({"rate": "float64"} | ({c: "int64" for c in ("frame", "arrived", "started", "dropped")} if rows else {}))


class _Taker(StatefulProcessor):
    """Keeps a Camera of each key in the state store."""

    def __init__(self, busy: int, n: int, schema: T.StructType) -> None:
        self.busy, self.n, self.schema = busy, n, schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("camera", "free long, waiting_at long, waiting long, last_at long, last long, dropped long, starts array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        camera = Camera()
        if self.state.exists():
            free, waiting_at, waiting, last_at, last, dropped, starts = self.state.get()
            camera = Camera(free, None if waiting is None else (waiting_at, waiting), None if last is None else (last_at, last), dropped, list(starts))
        out = []
        frames = pd.concat(list(rows)).sort_values(["arrived", "frame"])  # of one camera and one batch of the stream
        for at, number in zip(frames["arrived"].tolist(), frames["frame"].tolist(), strict=True):
            out += [(*key, *r) for r in camera.take((at, number), self.busy, self.n)]
        self.state.update((camera.free, *(camera.waiting or (None, None)), *(camera.last or (None, None)), camera.dropped, camera.starts))
        yield _frame(out, self.schema)

    def close(self) -> None:
        pass


def taken_live(frames: DataFrame, camera: str, time: str, frame: str, busy: int, n: int) -> DataFrame:
    """The same of a stream: frames come out once they have started, so one that waits comes with a later one.

    State is a few numbers and the last n starts of a camera. The session must keep it in
    RocksDB (spark.sql.streaming.stateStore.providerClass).
    """
    schema = _schema(frames, camera)
    return _lean(frames, camera, time, frame).groupBy("camera").transformWithStateInPandas(_Taker(busy, n, schema), schema, "Append", "None")
