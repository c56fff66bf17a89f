"""Gapless numbering and running sums inside groups without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one numbering task takes, and copies of a row that one explode step makes.
PER_TASK, CHUNK = 100_000, 65_536


def running(tall: DataFrame, group: str, keys: list[str], weight: str) -> DataFrame:
    """``tall`` with ``__before``: the sum of ``weight`` over the rows of the same ``group`` that come earlier, in the order
    of a hash of ``keys`` and then the keys, which tell the rows of a group apart.

    A group is cut by the hash into parts of about PER_TASK rows, and no fewer parts than the session has shuffle
    partitions. Windows run over the parts alone, and a table of part totals, of at most a row for each row of ``tall``,
    gives where each part begins. ``tall`` is read several times and should be parked.
    """
    spread = max(int(tall.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tall.count() // PER_TASK))
    parted = tall.withColumn("__part", F.pmod(F.xxhash64(*keys), F.lit(spread)))
    totals = parted.groupBy(group, "__part").agg(F.sum(weight).alias("__total"))
    earlier = F.sum("__total").over(Window.partitionBy(group).orderBy("__part")) - F.col("__total")
    offsets = totals.select(F.col(group).alias("__group"), F.col("__part").alias("__at"), earlier.alias("__earlier"))
    within = F.sum(weight).over(Window.partitionBy(group, "__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    placed = parted.withColumn("__within", within)
    placed = placed.join(offsets, placed[group].eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__at")))
    return placed.withColumn("__before", F.col("__earlier") + F.col("__within")).drop("__part", "__group", "__at", "__earlier", "__within")


def number(tall: DataFrame, group: str, keys: list[str], copies: str = "copies") -> DataFrame:
    """Expand ``tall`` (one row for each distinct ``keys``, ``copies`` of it) and number each ``group`` from 0 in ``slot``.

    As equal rows are counted first, a row that fills a third of the input is one row here; its copies are made in two
    steps, and between them the steps of a row with more than CHUNK copies are dealt to other tasks.
    """
    placed = running(tall, group, keys, copies)
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1, F.lit(CHUNK).cast("long")))
    many = placed.filter(F.col(copies) > CHUNK).withColumn("__low", step).repartition(F.xxhash64(*keys, "__low"))
    few = placed.filter(F.col(copies) <= CHUNK).withColumn("__low", F.lit(0).cast("long"))
    most = tall.agg(F.coalesce(F.max(copies), F.lit(0))).first()[0]
    stepped = many.unionByName(few) if most > CHUNK else few
    one = F.explode(F.sequence(F.col("__low"), F.least(F.col(copies), F.col("__low") + CHUNK) - 1))
    out = stepped.withColumn("__copy", one).withColumn("slot", F.col("__before") + F.col("__copy"))
    return out.drop("__before", "__low", "__copy", copies)
