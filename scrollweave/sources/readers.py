"""Sources: frame images, text files, frame times from logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollweave.functions.text import pts_time


def frames(spark: SparkSession, folder: str, prefix: str = "kf_") -> DataFrame:
    """``(path, number, w, h, luma)`` of the PNG files of ``folder`` that begin with ``prefix``; unreadable ones have null
    planes, grey and colour ones the plane of their luma. ``number`` is the number in the name, so names of different
    lengths sort right."""
    images = spark.read.format("image").option("pathGlobFilter", f"{prefix}*.png").load(folder).select("image.*")
    number = F.regexp_extract("origin", r"(\d+)\.png$", 1).try_cast("long")
    good = F.col("nChannels").isin(1, 3, 4) & (F.col("width") > 0)

    @F.pandas_udf("binary")
    def luma(channels: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([_luma(n, x) for n, x in zip(channels, data, strict=True)], dtype=object)

    plane = F.when(F.col("nChannels") == 1, F.col("data")).otherwise(luma("nChannels", "data"))
    readable = lambda c: F.when(good, c)
    return images.select(F.col("origin").alias("path"), number.alias("number"), readable(F.col("width")).alias("w"), readable(F.col("height")).alias("h"), readable(plane).alias("luma"))


def _luma(channels: int, data: bytes) -> bytes | None:
    """The luma plane of an image whose pixels are blue, green and red, and alpha, which counts nothing: BT.709 weights,
    rounded down. Null for other images."""
    if channels not in (3, 4):
        return None
    return luma_of(np.frombuffer(data, np.uint8).reshape(-1, channels)[:, 2::-1])


def luma_of(rgb: np.ndarray) -> bytes:
    red, green, blue = (rgb[:, k].astype(np.uint32) for k in range(3))
    return ((2126 * red + 7152 * green + 722 * blue) // 10_000).astype(np.uint8).tobytes()


def timed(images: DataFrame, log: DataFrame, step: float, video: str | None = None) -> DataFrame:
    """Frames with ``timestamp``: the i-th frame by number gets the i-th ``pts_time`` of ``log (n, value)``, else
    ``i * step``. ``video`` names a column of both; frames and times are then counted within each video, which is the
    parallel axis."""
    own = [video] if video else []
    times = log.withColumn("timestamp", pts_time(F.col("value"))).filter("timestamp IS NOT NULL")
    one = lambda *order: F.row_number().over(Window.partitionBy(*own).orderBy(*order)) - 1
    times = times.select(*own, one("n").alias("__i"), "timestamp")
    placed = images.withColumn("__i", one("number", "path"))
    return placed.join(times, [*own, "__i"], "left").withColumn("timestamp", F.coalesce("timestamp", F.col("__i") * F.lit(step))).drop("__i")


def encoded(spark: SparkSession, folder: str, glob: str = "*.png") -> DataFrame:
    """``(path, base64)`` of files, without line breaks whatever the session's setting."""
    whole = F.regexp_replace(F.base64("content"), r"[\r\n]", "")
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", whole.alias("base64"))


def text_file(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, text)`` of whole files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def duration(column: str = "value"):
    """Seconds of a probe's output; 0 if it says none."""
    return F.coalesce(F.trim(F.col(column)).try_cast("double"), F.lit(0.0))
