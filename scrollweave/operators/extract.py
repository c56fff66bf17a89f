"""Extraction and refinement by external models: a registry of backends, applied in Arrow batches.

Only the backends are external; without one, a call fails. Task slots give the concurrency.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from scrollweave.functions import text as T
from scrollweave.operators.lines import chunks

#: A backend makes one function a task, from an image's bytes and a prompt to text.
Backend = Callable[[], Callable[[bytes, str], str]]
BACKENDS: dict[str, Backend] = {}
PREFERENCE = ("onnx", "ocr", "vlm")

PROMPT = "Write down the source code that this picture of a screen shows, with its indentation. Leave out line numbers, tabs, side bars and all else around the code. Answer with the code alone, without remarks or fences."
NARRATED = 'Words spoken at this moment: "{narration}"\n\n' + PROMPT
CONTINUED = "The frame before this one ended in this code:\n```\n{previous_tail}\n```\n\nWrite down the code of the new frame just as it stands there, and nothing else."


def backend(name: str) -> Backend:
    if name not in BACKENDS:
        raise LookupError(f"no extraction backend named {name!r} is installed")
    return BACKENDS[name]


def choose(wanted: set[str]) -> str:
    """The preferred one of the backends asked for; the last of all if none is."""
    return next((name for name in PREFERENCE if name in wanted), PREFERENCE[-1])


class Progress:
    """Counts the rows of a table while a job reads them, without a job of its own."""

    def __init__(self, name: str):
        self.seen = Observation(name)

    def watch(self, table: DataFrame) -> DataFrame:
        return table.observe(self.seen, F.count(F.lit(1)).alias("rows"))

    def rows(self) -> int:
        return int(self.seen.get["rows"])


def prompt(previous: Column, narration: Column) -> Column:
    """For a model: the last 40 lines of the previous code, else the narration, else neither."""
    tail = T.let(T.lines(previous), lambda a: T.join_lines(F.slice(a, F.greatest(F.lit(1), F.size(a) - 39), F.lit(40))))
    fill = lambda template, slot, value: F.replace(F.lit(template), F.lit(slot), value)
    said = fill(NARRATED, "{narration}", T.truncate_narration(narration))
    return F.when(previous.isNotNull(), fill(CONTINUED, "{previous_tail}", tail)).when(narration.isNotNull(), said).otherwise(F.lit(PROMPT))


def with_retry(call: Callable[[], str], waits: tuple[float, ...] = (1.0, 2.0), transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError)) -> str:
    """Call again after each wait if a transient error came; any other error, or one after the last wait, goes on."""
    for wait in waits:
        try:
            return call()
        except transient:
            time.sleep(wait)
    return call()


def extract(frames: DataFrame, name: str, strict: bool = True, content: str = "content", prompts: Column | None = None, parallel: int = 4) -> DataFrame:
    """``frames`` with ``text`` and ``error``, read by the backend ``name`` from the images in ``content``.

    Up to ``parallel`` images of a task are read at a time; texts stand with their frames. Strict: the first error fails
    the job; else it gives an empty text and the error. ``prompts`` are PROMPT by default.
    """
    make = backend(name)

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        call = make()

        def one(image: bytes, words: str) -> tuple[str, str | None]:
            try:
                return with_retry(lambda: call(image, words)), None
            except Exception as e:
                if strict:
                    raise
                return "", f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for images, words in batches:
                yield pd.DataFrame(list(pool.map(one, images, words)), columns=["text", "error"])

    asked = F.lit(PROMPT) if prompts is None else prompts
    return frames.withColumn("__x", run(F.col(content), asked)).select(*frames.columns, T.clean_response(F.col("__x.text")).alias("text"), F.col("__x.error").alias("error"))


def refine(texts: DataFrame, client: Callable[[], Callable[[str, int, int], str]], agents: int = 4) -> DataFrame:
    """``(id, text)`` refined in ``agents`` chunks by a client, which is told a chunk, its number and how many there are;
    blank texts stay. Chunks are spread over tasks, ``agents`` at a time in each. An error fails the job."""
    agents = max(1, agents)
    blank = T.trim(F.col("text")) == ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        ask = lambda x, k, n: with_retry(lambda: call(x, int(k), int(n)), (2.0, 4.0))
        with ThreadPoolExecutor(agents) as pool:
            for pdf in batches:
                yield pdf.assign(text=pd.Series(list(pool.map(ask, pdf["text"], pdf["chunk"], pdf["of"])), dtype=object, index=pdf.index))

    parts = chunks(texts.filter(~blank), agents)
    parts = parts.withColumn("of", F.max("chunk").over(Window.partitionBy("id")))
    parts = parts.mapInPandas(run, parts.schema).withColumn("text", T.strip_fences(T.trim(F.col("text"))))
    joined = parts.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return texts.filter(blank).select("id", "text").unionByName(joined)


def revisions(captures: DataFrame) -> DataFrame:
    """``(video_id, frame_index, timestamp, content, narration, diff)`` from captures ``(video_id, group_idx,
    seq_in_group, timestamp, text)``: each group stitched, with its diff to the one before."""
    from scrollweave.operators import folds

    keyed = captures.withColumn("__g", F.to_json(F.struct("video_id", "group_idx")))
    stitched = folds.per_group(keyed, folds.stitch_scroll, "__g", "seq_in_group")
    heads = keyed.groupBy("__g", "video_id", "group_idx").agg(F.min_by("timestamp", "seq_in_group").alias("timestamp"))
    rows = heads.join(stitched, "__g").select("video_id", F.col("group_idx").cast("long").alias("frame_index"), "timestamp", F.col("text").alias("content"))
    before = F.lag("content").over(Window.partitionBy("video_id").orderBy("frame_index"))

    @F.pandas_udf("string")
    def differ(old: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([folds.diff(a, b) or None for a, b in zip(old, new, strict=True)], dtype=object)

    return rows.withColumn("__old", before).select("*", F.lit(None).cast("string").alias("narration"), differ("__old", "content").alias("diff")).drop("__old")
