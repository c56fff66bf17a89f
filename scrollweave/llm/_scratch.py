"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


#: Temporary folders of applications on one machine without a setting.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the cluster's ``spark.checkpoint.dir``, or else of the context's checkpoint folder.

    Where neither is set, a session on this one machine (tests) gets a temporary folder, which goes when Python ends; on
    a cluster that is an error, as executors would write to disks that others don't see.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir() or _local.get(context.applicationId)
    if not base:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _local[context.applicationId] = tempfile.mkdtemp(prefix="scrollweave-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/llm-{context.applicationId}"


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: The tables parked in each open scope, with their paths.
_open: list[list[tuple[DataFrame, str]]] = []


def park(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if _open:
        _open[-1].append((table, path))
    return table


@contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables parked inside are deleted at the end, but for those given to the function that this yields: what is read
    later must be one of them, or parked outside."""
    _open.append([])
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        for table, path in _open.pop():
            if not any(table is k for k in kept):
                _delete(table.sparkSession, path)
            elif _open:
                _open[-1].append((table, path))


#: Files whose rows are named by their place, beyond which a copy is parked; their names are broadcast, 200 bytes each.
MOST_FILES, ROWS_BITS = 100_000, 40
_PLAIN = ("LogicalRelation", "Project", "Filter", "SubqueryAlias")


def keyed(docs: DataFrame) -> DataFrame:
    """``(row, doc)``: a key for each row and the row itself as one struct, so that no name of its columns can clash with
    one of an operator's. The key holds where ids are null or repeated, and is the same in every job.

    Rows of a plain scan of Parquet files are named by file and place, without a copy. Others are parked first.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    files = _files(docs)
    if files is None:
        return park(docs.select(F.monotonically_increasing_id().alias("row"), whole), "rows")
    names = docs.sparkSession.createDataFrame([(name, k) for k, name in enumerate(files)], "path string, file long")
    placed = docs.select(whole, F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
    return placed.join(F.broadcast(names), "path").select((F.shiftleft("file", ROWS_BITS) + F.col("place")).alias("row"), "doc")


def _files(docs: DataFrame) -> list[str] | None:
    """The files that ``docs`` scans; None if it isn't a plain scan of Parquet files, MOST_FILES at most."""

    def plain(plan) -> bool:
        children = plan.children()
        return plan.nodeName().split(" ")[0] in _PLAIN and children.size() <= 1 and all(plain(children.apply(k)) for k in range(children.size()))

    if "_metadata" in (c.lower() for c in docs.columns) or not plain(docs._jdf.queryExecution().analyzed()):
        return None
    try:
        places = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # not Parquet, or the columns no longer come with their files
        return None
    found = [r.path for r in places.select("path").distinct().limit(MOST_FILES + 1).collect()]
    return sorted(found) if len(found) <= MOST_FILES else None


def unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of ``doc``."""
    return rows.select(*(F.col("doc").getField(c).alias(c) for c in columns))


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a parked table that no later read needs."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, name)


def sweep(spark: SparkSession) -> None:
    """Delete all that this application has parked, when the results that read from it have been written elsewhere."""
    _delete(spark, shared_dir(spark))
