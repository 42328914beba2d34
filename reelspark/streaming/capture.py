"""Streaming counterparts of the capture queries. The original reads frames in order in one loop; state by video takes its place here."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

STREAK = "video_id long, id long, streak long, since_hit long"


def no_face_streak(frames: DataFrame) -> DataFrame:
    """For each frame, the frames without a face since the last hit. Frames of a video must arrive in order between micro-batches; inside one they are sorted."""

    def follow(key, batches, state):
        run, last = state.get if state.exists else (0, None)
        rows = pd.concat(list(batches)).sort_values("frame_idx")
        out = []
        for frame, i, fd in zip(rows["frame_idx"], rows["id"], rows["fd"]):
            run, last = (0, int(frame)) if fd < 9 else (run + 1, last)
            out.append((key[0], i, run, None if last is None else int(frame) - last))
        state.update((run, last))
        made = pd.DataFrame(out, columns=["video_id", "id", "streak", "since_hit"])
        yield made.astype({"since_hit": "Int64"})

    slim = frames.select("video_id", "id", "frame_idx", "fd")
    return slim.groupBy("video_id").applyInPandasWithState(follow, STREAK, "run long, last long", "append", GroupStateTimeout.NoTimeout)


def hit_spans(frames: DataFrame, near: float = 0.45, gap: str = "5 seconds", late: str = "10 seconds") -> DataFrame:
    """Proposed: sessions of frames near the wanted face, closed once no hit came for `gap`; rows later than `late` are dropped."""
    hits = frames.withWatermark("ts", late).where(F.col("fd") <= near)
    return hits.groupBy("video_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("hits"), F.min("fd").alias("best")).select("video_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "hits", "best")
