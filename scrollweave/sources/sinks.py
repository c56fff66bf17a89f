"""Sinks: the JSON record of a run, its files, and refined texts."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollweave.operators.folds import unique_names

RECORD_NAME = "extracted.json"


def record(files: Column, duration: Column, source_video: Column) -> Column:
    """The output record as a struct; commands and annotations are always empty."""
    return F.struct(
        files.alias("files"), F.array().cast("array<struct<timestamp:double,command:string,output:string>>").alias("terminal_commands"),
        F.array().cast("array<struct<timestamp:double,text:string>>").alias("annotations"), duration.alias("duration"), source_video.alias("source_video"),
    )


def as_json(value: Column) -> Column:
    """Pretty JSON with nulls written out."""
    return F.to_json(value, {"pretty": "true", "ignoreNullFields": "false"})


def _put(folder: str, name: str, text: str) -> str:
    """Write a file under a URI or a local path; a name that is there is replaced at once, when the text is complete, so a
    task that runs twice leaves the same files."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    store.create_dir(base, recursive=True)
    with store.open_output_stream(f"{base}/.{name}.part") as out:
        out.write(text.encode())
    store.move(f"{base}/.{name}.part", f"{base}/{name}")
    return f"{folder}/{name}"


def write_output(outputs: DataFrame, folder: str) -> DataFrame:
    """Write, for each row of ``outputs (video_id, json)``, the files of its record and ``extracted.json`` into
    ``folder/<video_id>``, by the executors; ``(video_id, path, names)`` says where. ``folder`` is one that all of them share.

    Names are made safe and unique within a record; JSON stands as it is given. Rows must differ in ``video_id``.
    """
    kind = outputs.schema["video_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for video, text in zip(pdf.video_id, pdf.json, strict=True):
                files = json.loads(text)["files"]
                names = unique_names([f["filename"] for f in files])
                own = f"{folder}/{unique_names([str(video)])[0]}"
                for name, file in zip(names, files, strict=True):
                    _put(own, name, file["final_content"] or "")
                done.append((video, _put(own, RECORD_NAME, text), names))
            yield pd.DataFrame(done, columns=["video_id", "path", "names"])

    written = outputs.select("video_id", "json").mapInPandas(run, f"video_id {kind}, path string, names array<string>")
    return outputs.sparkSession.createDataFrame(written.collect(), written.schema)


def write_texts(texts: DataFrame, path: str) -> None:
    """One folder of text files, a row each; ``texts`` has one string column."""
    texts.write.mode("overwrite").option("lineSep", "\n").text(path)


def refined_name(path: Column) -> Column:
    """``x.refined.txt`` of ``x.txt``, and of any other ``x``."""
    return F.concat(F.regexp_replace(path, r"(\.txt)+$", ""), F.lit(".refined.txt"))


def write_refined(texts: DataFrame) -> DataFrame:
    """Write each row of ``texts (path, text)`` beside its source; ``(path, written)`` says where."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            places = [w.rpartition("/") for w in pdf.written]
            yield pd.DataFrame({"path": pdf.path, "written": [_put(folder or ".", name, text) for (folder, _, name), text in zip(places, pdf.text, strict=True)]})

    written = texts.withColumn("written", refined_name(F.col("path"))).mapInPandas(run, "path string, written string")
    return texts.sparkSession.createDataFrame(written.collect(), written.schema)
