"""The lock on a face: a region around the last match is searched first, and what is saved keeps a distance in time.

Proposed semantics, as only the settings and their description are known. Frames of a
video are walked in order of (ts, frame_idx); rows of one frame are its faces. A box is
x1, y1, x2, y2.

- While a region is held, faces that overlap it by `gate` or more (IoU with the followed box) or whose centre lies in the padded region are asked first, within `near_locked` once `after` hits stand behind the lock, within `near` before. If none fits, all faces are asked within `near`; where a region is held, the best must then beat the next by `margin`.
- A hit moves the followed box: `momentum` of the old one, the rest of the new one. A frame without a hit in the region is a miss; with more than `misses` in a row the region goes.
- Hits within `gap` seconds of the first of a window make one save: the nearest of them (`only_best`), or the first.
- After `idle` seconds without a frame everything is forgotten, and an open window is closed.

Cases: rows without video, time or frame are left out. A face without a distance or with a
coordinate missing is no candidate, but its frame counts. Equal distances go by the smaller
id, a null id last. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FRAME = "video_id long, ts timestamp, frame_idx long, id long, fd double, x1 double, y1 double, x2 double, y2 double"
NAMES = [c.split()[0] for c in FRAME.split(", ")]
FOUND = "video_id long, frame_idx long, id long, kind string, in_region boolean, locked boolean, x1 double, y1 double, x2 double, y2 double"
STATE = "hits long, missed long, x1 double, y1 double, x2 double, y2 double, opened long, best_fd double, best_frame long, best_id long, last long"


@dataclass(frozen=True)
class LockSpec:
    near: float = 0.45
    near_locked: float = 0.28
    after: int = 1
    pad: float = 1.25
    misses: int = 8
    momentum: float = 0.7
    gate: float = 0.05
    margin: float = 0.03
    gap: float = 0.5
    only_best: bool = True
    idle: float = 60.0


def overlap(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    size = lambda r: max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])
    return both / max(size(a) + size(b) - both, 1e-6)


def padded(box, pad: float):
    w, h = box[2] - box[0], box[3] - box[1]
    return box[0] - pad * w, box[1] - pad * h, box[2] + pad * w, box[3] + pad * h


@dataclass
class Lock:
    """What is known of one video after some of its frames; times are microseconds."""

    hits: int = 0
    missed: int = 0
    x1: float | None = None
    y1: float | None = None
    x2: float | None = None
    y2: float | None = None
    opened: int | None = None
    best_fd: float | None = None
    best_frame: int | None = None
    best_id: int | None = None
    last: int | None = None

    def box(self):
        return None if self.x1 is None else (self.x1, self.y1, self.x2, self.y2)

    def close(self) -> list[tuple]:
        """The save of the open window, if any: (frame_idx, id, kind, in_region, locked, box)."""
        made = [] if self.opened is None else [(self.best_frame, self.best_id, "save", None, None, None)]
        self.opened = None
        return made

    def forget(self) -> list[tuple]:
        made = self.close()
        self.__init__()
        return made

    def step(self, spec: LockSpec, ts: int, frame: int, faces: list[tuple]) -> list[tuple]:
        """Takes one frame; faces: (distance, id, box), nearest first."""
        made = self.forget() if self.last is not None and ts - self.last >= spec.idle * 1e6 else []
        self.last = ts
        if self.opened is not None and ts - self.opened >= spec.gap * 1e6:
            made += self.close()
        held, locked, hit, inside = self.box(), self.hits >= spec.after and self.x1 is not None, None, False
        if held is not None:
            a, b, c, d = padded(held, spec.pad)
            close = lambda r: overlap(held, r) >= spec.gate or a <= (r[0] + r[2]) / 2 <= c and b <= (r[1] + r[3]) / 2 <= d
            hit = next((f for f in faces if f[0] <= (spec.near_locked if locked else spec.near) and close(f[2])), None)
            inside = hit is not None
        self.missed = 0 if inside or held is None else self.missed + 1
        if hit is None and faces and faces[0][0] <= spec.near and (held is None or len(faces) == 1 or faces[1][0] - faces[0][0] >= spec.margin):
            hit = faces[0]
        if hit is None:
            made.append((frame, None, "miss", False, locked, held))
        else:
            keep = spec.momentum if inside else 0.0  # a hit elsewhere starts anew
            self.hits = self.hits + 1 if inside or held is None else 1
            self.missed = 0 if not inside else self.missed
            self.x1, self.y1, self.x2, self.y2 = (new if held is None else keep * old + (1 - keep) * new for old, new in zip(held or hit[2], hit[2]))
            made.append((frame, hit[1], "hit", inside, locked, held))
            if self.opened is None:
                self.opened, self.best_fd, self.best_frame, self.best_id = ts, hit[0], frame, hit[1]
            elif spec.only_best and hit[0] < self.best_fd:
                self.best_fd, self.best_frame, self.best_id = hit[0], frame, hit[1]
        if self.missed > spec.misses:
            self.hits, self.missed, self.x1, self.y1, self.x2, self.y2 = 0, 0, None, None, None, None
        return made


def candidates(rows: list[tuple]) -> list[tuple]:
    """Faces of one frame, nearest first, as (distance, id, box); rows: id, fd and box."""
    whole = [(fd, i, tuple(box)) for i, fd, *box in rows if all(v is not None and v == v for v in (fd, *box))]
    return sorted(whole, key=lambda f: (f[0], f[1] is None, f[1] or 0, f[2]))


def walk(state: Lock, spec: LockSpec, rows: list[tuple]) -> list[tuple]:
    """Steps over whole frames; rows in order of (ts, frame_idx): ts, frame_idx, id, fd and box."""
    made, at = [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][:2] == rows[at][:2]:
            end += 1
        made += state.step(spec, *rows[at][:2], candidates([r[2:] for r in rows[at:end]]))
        at = end
    return made


def lines(video: int, made: list[tuple]) -> list[tuple]:
    return [(video, frame, i, kind, inside, locked, *(box or (None,) * 4)) for frame, i, kind, inside, locked, box in made]


def usable(frames: DataFrame) -> DataFrame:
    kinds = dict(c.split() for c in FRAME.split(", "))
    given = frames.select(*[F.col(c) if c == "ts" else F.col(c).cast(kinds[c]).alias(c) for c in NAMES])
    return given.where("video_id IS NOT NULL AND ts IS NOT NULL AND frame_idx IS NOT NULL")


def locked_frames(frames: DataFrame, spec: LockSpec = LockSpec()) -> DataFrame:
    """A line for each frame (hit or miss) and each save of a table of faces.

    A video's frames pass through one task in order, batch by batch, with the lock as the
    only memory; videos are dealt out by their id.
    """

    def run(batches):
        video, state, open_rows = None, Lock(), []
        for batch in batches:
            out = []
            columns = [c.cast(pa.int64()) if n == "ts" else c for n, c in zip(NAMES, batch.columns)]
            for own, *row in zip(*(c.to_pylist() for c in columns)):
                row = tuple(row)
                if open_rows and (own != video or row[:2] != open_rows[0][:2]):  # a frame is complete
                    out += lines(video, walk(state, spec, open_rows))
                    open_rows = []
                if own != video:
                    out += lines(video, state.forget()) if video is not None else []
                    video = own
                open_rows.append(row)
            yield as_batch(out)
        if video is not None:
            yield as_batch(lines(video, walk(state, spec, open_rows) + state.forget()))

    dealt = usable(frames).repartition("video_id").sortWithinPartitions("video_id", "ts", "frame_idx")
    return dealt.mapInArrow(run, FOUND)


def as_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    names, types = zip(*(c.split() for c in FOUND.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[t]) for k, t in enumerate(types)], list(names))


class LockProcessor(StatefulProcessor):
    """Rows wait in state until the watermark has passed them, so that frames are walked in order however they arrive."""

    def __init__(self, spec: LockSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lock = handle.getValueState("lock", STATE)
        self.waiting = handle.getListState("waiting", "ts long, frame_idx long, id long, fd double, x1 double, y1 double, x2 double, y2 double")

    def handleInputRows(self, key, rows, timerValues):
        latest = None
        for part in rows:
            part = part.astype({"ts": "datetime64[us]"})
            held = part[NAMES[1:]].astype({"ts": "int64"}).astype(object).where(lambda p: p.notna(), None)
            self.waiting.appendList([plain(r) for r in held.itertuples(index=False, name=None)])
            latest = max(latest or 0, int(held["ts"].max()))
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        state = Lock(*self.lock.get()) if self.lock.exists() else Lock()
        rows = [plain(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = sorted((r for r in rows if r[0] < now), key=lambda r: r[:2]), [r for r in rows if r[0] >= now]
        made = walk(state, self.spec, ready)
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
        end = None if state.last is None else state.last + int(self.spec.idle * 1e6)
        if end is not None and end <= now:
            made += state.forget()
        elif end is not None and ready:
            self.handle.registerTimer(end // 1000 + 1)
        self.lock.clear() if state.last is None else self.lock.update(astuple(state))
        yield pd.DataFrame(lines(int(key[0]), made), columns=[c.split()[0] for c in FOUND.split(", ")], dtype=object)

    def close(self) -> None:
        pass


def plain(row) -> tuple:
    """ts, frame_idx and id as whole numbers, the rest as floats, missing ones as None."""
    return tuple(None if v is None or v != v else int(v) if k < 3 else float(v) for k, v in enumerate(row))


def locked_stream(frames: DataFrame, spec: LockSpec = LockSpec(), late: str = "10 seconds") -> DataFrame:
    """The same of a stream. Rows later than `late` are dropped; frames are reported once the watermark has passed them.

    The session's state store must be RocksDB's, which transformWithState asks for.
    """
    given = usable(frames).withWatermark("ts", late)
    return given.groupBy("video_id").transformWithStateInPandas(LockProcessor(spec), FOUND, "Append", "EventTime")
