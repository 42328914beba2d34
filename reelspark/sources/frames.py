"""Readers of pictures and raw video frames, and writers of what was found."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

#: Bytes a pixel, doubled so that planes at quarter size stay whole numbers (fixed values).
HALF_BYTES = {"gray": 2, "rgb24": 6, "nv12": 3, "p010": 6}
PICTURES = "*.{jpg,jpeg,png,bmp,webp,JPG,JPEG,PNG,BMP,WEBP}"


class FrameRange(InputPartition):
    def __init__(self, first: int, end: int):
        self.first, self.end = first, end


class RawFrameReader(DataSourceReader):
    """Frames of one raw file; a task owns a range of them, seeks over those a stride leaves out and skips a torn last one.

    Bounds and lists of frame_idx in a query's filter are taken over: what they exclude is neither dealt out nor read.
    """

    def __init__(self, options: dict):
        self.path, self.width, self.height = options["path"], int(options["width"]), int(options["height"])
        self.size = self.width * self.height * HALF_BYTES[options.get("pixels", "nv12")] // 2
        self.stride, self.per_task = max(1, int(options.get("stride", 1))), max(1, int(options.get("framespertask", 256)))
        self.first, self.end, self.only = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_idx",):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(f.value + isinstance(f, LessThanOrEqual), f.value + 1 if self.end is None else self.end)
            elif isinstance(f, (EqualTo, In)):
                named = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.only = named if self.only is None else self.only & named
            elif not isinstance(f, IsNotNull):
                yield f

    def frames(self) -> int:
        return os.path.getsize(self.path) // self.size

    def ranges(self, first: int, end: int) -> list[FrameRange]:
        """Whole ranges of frames, of which those without a frame that is asked for are left out."""
        first, end = max(first, self.first), end if self.end is None else min(end, self.end)
        made = [FrameRange(a, min(end, a + self.per_task)) for a in range(first, end, self.per_task)]
        return made if self.only is None else [r for r in made if any(r.first <= n < r.end for n in self.only)]

    def partitions(self):
        return self.ranges(0, self.frames())

    def read(self, part: FrameRange | None):
        if part is None:  # what Spark hands over when there are no ranges
            return
        with open(self.path, "rb") as held:
            for n in range(-(-part.first // self.stride) * self.stride, part.end, self.stride):
                if self.only is None or n in self.only:
                    held.seek(n * self.size)
                    yield n, self.width, self.height, held.read(self.size)


class RawFrameStream(DataSourceStreamReader):
    """Frames of a raw file that still grows. An offset is a number of whole frames, so a torn last one waits until it is complete."""

    def __init__(self, options: dict):
        self.raw = RawFrameReader(options)

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def latestOffset(self) -> dict:
        return {"frames": self.raw.frames()}

    def partitions(self, start: dict, end: dict):
        if end["frames"] < start["frames"] or self.raw.frames() < end["frames"]:
            raise ValueError(f"{self.raw.path} has become shorter than what was read of it")
        return self.raw.ranges(start["frames"], end["frames"])

    def read(self, part: FrameRange | None):
        return self.raw.read(part)

    def commit(self, end: dict) -> None:
        """Nothing is kept besides the file, whose frames can be read again."""


class RawFrames(DataSource):
    """spark.read or spark.readStream, format "rawframes", with path (on shared storage), width, height, pixels, stride and framesPerTask."""

    @classmethod
    def name(cls):
        return "rawframes"

    def schema(self):
        return "frame_idx long, w int, h int, pixels binary"

    def reader(self, schema):
        return RawFrameReader({k.lower(): v for k, v in self.options.items()})

    def streamReader(self, schema):
        return RawFrameStream({k.lower(): v for k, v in self.options.items()})


class PipeFrameReader(DataSourceReader):
    """Frames that a command writes to its standard output; each task runs it once for a range of its own and reads frame by frame."""

    def __init__(self, options: dict):
        self.command, self.width, self.height = json.loads(options["command"]), int(options["width"]), int(options["height"])
        self.size = self.width * self.height * HALF_BYTES[options.get("pixels", "rgb24")] // 2
        self.frames, self.stride, self.per_task = int(options["frames"]), max(1, int(options.get("stride", 1))), max(1, int(options.get("framespertask", 256)))

    def partitions(self):
        return [FrameRange(a, min(self.frames, a + self.per_task)) for a in range(0, self.frames, self.per_task)]

    def read(self, part: FrameRange | None):
        if part is None:
            return
        words = [w.replace("{first}", str(part.first)).replace("{count}", str(part.end - part.first)) for w in self.command]
        with subprocess.Popen(words, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as run:
            try:
                for n in range(part.first, part.end):
                    frame = run.stdout.read(self.size)
                    if len(frame) < self.size:  # fewer frames than were announced, or a torn last one
                        if code := run.wait():
                            raise RuntimeError(f"{words[0]} ended with {code} after {n - part.first} of {part.end - part.first} frames")
                        return
                    if n % self.stride == 0:
                        yield n, self.width, self.height, frame
            finally:
                run.kill()


class PipeFrames(DataSource):
    """spark.read.format("pipeframes") with command (a JSON list in which {first} and {count} are filled in), frames, width, height, pixels, stride and framesPerTask."""

    @classmethod
    def name(cls):
        return "pipeframes"

    def schema(self):
        return "frame_idx long, w int, h int, pixels binary"

    def reader(self, schema):
        return PipeFrameReader({k.lower(): v for k, v in self.options.items()})


def read_pipe(spark: SparkSession, command: list[str], frames: int, width: int, height: int, pixels: str = "rgb24", stride: int = 1, per_task: int = 256) -> DataFrame:
    """Frames from a decoder that is installed on the executors."""
    spark.dataSource.register(PipeFrames)
    return spark.read.format("pipeframes").options(command=json.dumps(command), frames=frames, width=width, height=height, pixels=pixels, stride=stride, framesPerTask=per_task).load()


def read_frames(spark: SparkSession, path: str, width: int, height: int, pixels: str = "nv12", stride: int = 1, per_task: int = 256) -> DataFrame:
    """Frames of a raw file. Allows Python sources to take filters over in the session, which the reader asks for."""
    spark.dataSource.register(RawFrames)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    return spark.read.format("rawframes").options(path=path, width=width, height=height, pixels=pixels, stride=stride, framesPerTask=per_task).load()


def stream_frames(spark: SparkSession, path: str, width: int, height: int, pixels: str = "nv12", stride: int = 1, per_task: int = 256) -> DataFrame:
    """The same as a stream: each frame once, also over restarts from a checkpoint."""
    spark.dataSource.register(RawFrames)
    return spark.readStream.format("rawframes").options(path=path, width=width, height=height, pixels=pixels, stride=stride, framesPerTask=per_task).load()


def read_pictures(spark: SparkSession, folder: str) -> DataFrame:
    """Encoded pictures of one folder, not of those below it, each once."""
    return spark.read.format("binaryFile").option("pathGlobFilter", PICTURES).load(folder).select("path", "modificationTime", "length", "content")


def luma(frames: DataFrame) -> DataFrame:
    """The gray plane of nv12 frames, ready for the picture measures."""
    return frames.withColumn("pixels", F.substring("pixels", 1, F.col("w") * F.col("h")))


def write_hits(hits: DataFrame, path: str) -> None:
    """A hit index as CSV with a header; nulls are empty."""
    hits.write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def write_metrics(items: DataFrame, path: str, config: dict) -> None:
    """One JSON document a line: the run's settings beside each item, so that no task holds all items."""
    settings = F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())])
    items.select(settings.alias("config"), F.struct("*").alias("item")).write.mode("overwrite").json(path)


def planes(frames: DataFrame) -> DataFrame:
    """The luma plane and the interleaved chroma plane of p010 frames, two bytes a sample."""
    size = F.col("w") * F.col("h") * 2
    return frames.withColumns({"y": F.substring("pixels", F.lit(1), size), "uv": F.substring("pixels", size + 1, F.floor(size / 2).cast("int"))}).drop("pixels")


class PictureWriter(DataSourceWriter):
    """Each task writes its files under hidden names and renames them, so a task that is run again leaves no torn file."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.folder, exist_ok=True)
        for row in iterator:
            if row["content"] is not None:
                hidden = os.path.join(self.folder, f".{row['name']}.{os.getpid()}")
                with open(hidden, "wb") as held:
                    held.write(row["content"])
                os.replace(hidden, os.path.join(self.folder, row["name"]))
        return WriterCommitMessage()


class PictureFiles(DataSource):
    """df.write.format("picturefiles") with path (a folder on mounted shared storage): a file for each row of name and content."""

    @classmethod
    def name(cls):
        return "picturefiles"

    def writer(self, schema, overwrite):
        return PictureWriter(self.options["path"])


def write_pictures(pictures: DataFrame, folder: str, order: tuple[str, ...] = ()) -> None:
    """Writes name and content (encoded already); rows without content are left out, and of rows of one name the last by `order`, then by a hash of the content, stays."""
    spark = pictures.sparkSession
    spark.dataSource.register(PictureFiles)
    last = F.max_by("content", F.struct(*order, F.xxhash64("content")))
    pictures.where("name IS NOT NULL AND content IS NOT NULL").groupBy("name").agg(last.alias("content")).write.format("picturefiles").mode("append").option("path", folder).save()


def write_log(rows: DataFrame, path: str) -> None:
    """A manifest, selection log or scene log as CSV with a header; one file, as such logs are bounded by the quotas."""
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="")


def counted(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df and an observation that tells, once df has been computed, how many rows passed."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def cached(spark: SparkSession, folder: str, settings: dict, build: Callable[[], DataFrame], mode: str = "auto") -> DataFrame:
    """Proposed: a result stored as Parquet under a digest of its settings. "auto" reads it if it is there, "refresh" computes it anew, "off" stores nothing."""
    if mode == "off":
        return build()
    path = f"{folder.rstrip('/')}/{hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:32]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if mode == "refresh" or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
