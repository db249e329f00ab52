"""Tracking on a stream: boxes wait for their frame to be complete, open tracks of a video live in the state store."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfgrid.config import TrackConfig
from shelfgrid.functions import geometry as g
from shelfgrid.functions.scores import track_gate
from shelfgrid.operators.tracking import FrameLinker, Track
from shelfgrid.streaming.frames import event_time

OUTPUT = "video_id string, track_id int, frame_index int, candidate_index int, x_min int, y_min int, x_max int, y_max int"
SIDES = ["x_min", "y_min", "x_max", "y_max"]
_COLUMNS = [part.strip().split()[0] for part in OUTPUT.split(",")]
#: The state store that timers and map state need; set it on the session before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


SLICE_MS = 60_000  # video time of the boxes that wait under one key of the state


class TrackProcessor(StatefulProcessor):
    """One video. Boxes are kept by time slice until the watermark passes their frame; then the frame is linked.

    A slice has one timer, at its first waiting frame; when it fires, all frames that the watermark has passed are linked.
    State: waiting boxes by slice, the last three boxes of each open track, the next id. A video that was idle for
    ``idle_ms`` keeps its next id only: its frames may begin anew, its track ids go on.
    """

    def __init__(self, cfg: TrackConfig, idle_ms: int):
        self.cfg, self.idle_ms = cfg, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slice long", "boxes string")
        self.tracks = handle.getValueState("tracks", "last int, next_id int, idle_at long, open string")

    def held(self, part: int) -> list:
        return json.loads(self.waiting.getValue((part,))[0]) if self.waiting.containsKey((part,)) else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for part, some in batch.groupby(batch["at"] // SLICE_MS):
                held = self.held(int(part))
                held += some[["at", "frame_index", "quality", "candidate_index", *SIDES]].to_numpy(dtype=object).tolist()
                self.waiting.updateValue((int(part),), (json.dumps(held, default=float),))
                self.handle.registerTimer(int(some["at"].min()))
        yield pd.DataFrame(columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = expiredTimerInfo.getExpiryTimeInMs()
        part, passed = fired // SLICE_MS, max(timerValues.getCurrentWatermarkInMs(), fired + 1)
        held = self.held(part)
        ready = sorted((r for r in held if r[0] < passed), key=lambda r: (r[0], r[1], -r[2], r[3]))
        last, next_id, idle_at, packed = self.tracks.get() if self.tracks.exists() else (-1, 1, -1, "[]")
        if not ready:
            if fired == idle_at:
                self.tracks.update((-1, next_id, -1, "[]"))
            yield pd.DataFrame(columns=_COLUMNS)
            return
        linker, out, idle_before = FrameLinker(self.cfg), [], idle_at
        linker.next_id = next_id
        for track_id, start, recent, count in json.loads(packed):
            track = Track(track_id, start, recent[0][1])
            track.recent, track.count = [(f, tuple(box)) for f, box in recent], count
            linker.open.append(track)
        frames: dict[tuple[int, int], list] = {}
        for at, frame, _, candidate, *box in ready:
            kept = frames.setdefault((int(at), int(frame)), [])
            box = tuple(int(v) for v in box)
            full = self.cfg.max_per_frame is not None and len(kept) >= self.cfg.max_per_frame
            if not full and not any(linker.motion.conflict(box, k) for k, _ in kept):
                kept.append((box, int(candidate)))
        for (at, frame), kept in frames.items():
            if 0 < idle_at < at:
                linker.open = []
            linker.expire(frame)
            owners = linker.link(frame, [box for box, _ in kept])
            out += [(key[0], owner, frame, candidate, *box) for (box, candidate), owner in zip(kept, owners)]
            last, idle_at = frame, at + self.idle_ms
        later = [r for r in held if r[0] >= passed]
        if later:
            self.waiting.updateValue((part,), (json.dumps(later),))
            self.handle.registerTimer(int(min(r[0] for r in later)))
        else:
            self.waiting.removeKey((part,))
        packed = json.dumps([(t.id, t.start, t.recent, t.count) for t in linker.open])
        self.tracks.update((last, linker.next_id, idle_at, packed))
        if idle_before > 0:
            self.handle.deleteTimer(idle_before)
        self.handle.registerTimer(idle_at)
        yield pd.DataFrame(out, columns=_COLUMNS)

    def close(self) -> None:
        pass


def stream_tracks(detections: DataFrame, cfg: TrackConfig = TrackConfig(), late: str = "1 minute", idle_ms: int = 600_000) -> DataFrame:
    """Boxes with track ids, frame by frame as the watermark passes them.

    The boxes of a frame may arrive in any micro-batches and any order up to ``late`` behind the newest frame; later ones are
    dropped by the watermark. Fragments are not merged: that needs tracks which have not been seen yet. The session's
    state store must be ``STATE_STORE``.
    """
    b = g.box()
    rows = event_time(detections.filter(track_gate(b, F.col("score"), cfg)), shift_us=1000)
    rows = rows.withColumn("quality", g.detection_quality(b, F.col("score"), F.col("source")))
    rows = rows.withWatermark("event_time", late).select(
        "video_id", "frame_index", "candidate_index", "quality", *SIDES, "event_time", F.unix_millis("event_time").alias("at")
    )
    return rows.groupBy("video_id").transformWithStateInPandas(TrackProcessor(cfg, idle_ms), OUTPUT, "Append", "EventTime")
