"""Video sources: frames and their times from an external decoder, one video a task, through pipes and without files.

The decoder is any program that takes ffmpeg's arguments. Frames come as raw colour pixels on its standard output; its
log gives their size and times.
"""

from __future__ import annotations

import re
import shutil
import subprocess
import threading
import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The decoder's frame filters, and the seconds between frames where its log has no time for one.
KEYFRAMES, KEYFRAME_STEP = r"select=eq(pict_type\,I),showinfo", 2.0
SCENES, SCENE_STEP = "select='gt(scene,0.3)',showinfo", 5.0
SCHEMA = "video_id {kind}, seq int, timestamp double, w int, h int, rgb binary"

_time = re.compile(r"pts_time:([0-9.\-]*)")
_size = re.compile(r"\bs:(\d+)x(\d+)\b")


def available(tool: str, *args: str) -> bool:
    """Whether ``tool`` can be run with ``args`` here and ends well."""
    if not shutil.which(tool):
        return False
    return subprocess.run([tool, *args], capture_output=True, check=False).returncode == 0


class _Log(threading.Thread):
    """The decoder's log, read beside its output: the times and the size of its frames so far."""

    def __init__(self, pipe):
        super().__init__(daemon=True)
        self.pipe, self.times, self.size, self.changed = pipe, [], None, threading.Condition()
        self.over = False

    def run(self) -> None:
        for raw in self.pipe:
            line = raw.decode(errors="replace")
            time, size = _time.search(line), _size.search(line)
            with self.changed:
                if time and (value := _number(time[1])) is not None:
                    self.times.append(value)
                if time and size and self.size is None:
                    self.size = int(size[1]), int(size[2])
                self.changed.notify()
        with self.changed:
            self.over = True
            self.changed.notify()

    def wait(self, ready) -> None:
        with self.changed:
            self.changed.wait_for(lambda: self.over or ready())


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def decode(path: str, chosen: str, step: float, tool: str = "ffmpeg") -> Iterator[tuple[float, np.ndarray]]:
    """``(seconds, pixels)`` of the frames that the filter ``chosen`` lets through; ``step`` seconds a frame where the log has
    no time. Pixels have the shape (h, w, 3). A decoder that fails raises RuntimeError when its frames are out."""
    command = [tool, "-v", "info", "-i", path, "-vf", chosen, "-vsync", "vfr", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"]
    with subprocess.Popen(command, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
        log = _Log(run.stderr)
        log.start()
        log.wait(lambda: log.size)
        seq = 0
        if log.size:
            w, h = log.size
            while len(data := run.stdout.read(3 * w * h)) == 3 * w * h:
                log.wait(lambda: len(log.times) > seq)  # noqa: B023
                yield (log.times[seq] if seq < len(log.times) else seq * step), np.frombuffer(data, np.uint8).reshape(h, w, 3)
                seq += 1
        run.stdout.read()
        log.join()
        if run.wait():
            raise RuntimeError(f"{tool} ended with code {run.returncode} on {path}")


def _scan(videos: DataFrame, chosen: str, step: float, tool: str, strict: bool) -> DataFrame:
    kind = videos.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for video, path in zip(pdf.video_id, pdf.path, strict=True):
                try:
                    for seq, (seconds, pixels) in enumerate(decode(path, chosen, step, tool)):
                        h, w, _ = pixels.shape
                        yield pd.DataFrame({"video_id": [video], "seq": [seq], "timestamp": [seconds], "w": [w], "h": [h], "rgb": [pixels.tobytes()]})
                except RuntimeError as e:
                    if strict:
                        raise
                    warnings.warn(str(e), stacklevel=1)

    return videos.select("video_id", "path").mapInPandas(run, SCHEMA.format(kind=kind))


def keyframes(videos: DataFrame, tool: str = "ffmpeg") -> DataFrame:
    """``(video_id, seq, timestamp, w, h, rgb)`` of the key frames of ``videos (video_id, path)``. A decoder that fails fails
    the job."""
    return _scan(videos, KEYFRAMES, KEYFRAME_STEP, tool, True)


def scenes(videos: DataFrame, tool: str = "ffmpeg") -> DataFrame:
    """The same of frames at scene changes. A decoder that fails is a warning, and its frames so far count."""
    return _scan(videos, SCENES, SCENE_STEP, tool, False)


def luma(frames: DataFrame) -> DataFrame:
    """Frames with ``luma``, the plane of their ``rgb``."""
    from scrollweave.sources.readers import luma_of

    @F.pandas_udf("binary")
    def plane(rgb: pd.Series) -> pd.Series:
        return pd.Series([luma_of(np.frombuffer(x, np.uint8).reshape(-1, 3)) for x in rgb], dtype=object)

    return frames.withColumn("luma", plane("rgb"))


def sampled(videos: DataFrame, tool: str = "ffmpeg", least: int = 5) -> DataFrame:
    """``(video_id, seq, timestamp, w, h, rgb, luma, is_keyframe)``: key frames, and for a video with fewer than ``least``
    also scene frames at tenths of a second that no key frame has; ``seq`` counts by time."""
    from pyspark.sql import Window

    tenth = F.round(F.col("timestamp") * 10).alias("__t")
    keys = keyframes(videos, tool).withColumn("is_keyframe", F.lit(True))
    counts = keys.groupBy("video_id").agg(F.count("*").alias("__n"))
    few = videos.join(counts, "video_id", "left").filter(F.coalesce("__n", F.lit(0)) < least).select("video_id", "path")
    more = scenes(few, tool).select("*", tenth).join(keys.select("video_id", tenth), ["video_id", "__t"], "left_anti").drop("__t")
    both = keys.unionByName(more.withColumn("is_keyframe", F.lit(False)))
    order = Window.partitionBy("video_id").orderBy("timestamp", F.desc("is_keyframe"), "seq")
    return luma(both.withColumn("seq", F.row_number().over(order) - 1))


def durations(videos: DataFrame, tool: str = "ffprobe") -> DataFrame:
    """``(video_id, duration)`` in seconds; 0 with a warning where the probe fails or says no number."""
    kind = videos.schema["video_id"].dataType.simpleString()
    command = [tool, "-v", "quiet", "-show_entries", "format=duration", "-of", "csv=p=0"]

    def seconds(path: str) -> float:
        try:
            found = subprocess.run([*command, path], capture_output=True, check=True).stdout
            return float(found.decode().strip())
        except (OSError, subprocess.CalledProcessError, ValueError) as e:
            warnings.warn(f"no duration of {path}: {e}", stacklevel=1)
            return 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"video_id": pdf.video_id, "duration": [seconds(p) for p in pdf.path]})

    return videos.select("video_id", "path").mapInPandas(run, f"video_id {kind}, duration double")
