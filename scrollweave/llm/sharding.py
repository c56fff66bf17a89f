"""Weighted rendezvous hashing of record keys over shards, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollweave.llm._scratch import park
from scrollweave.llm._slots import number


def rendezvous(key: Column, weights: Sequence[float]) -> tuple[Column, Column]:
    """``(score, shard)`` of the winning shard for ``key``.

    Shard ``s`` scores ``-ln(u) / weight`` with ``u`` in (0, 1) a hash of key and shard; the lowest score wins, the
    lower shard on a tie. A shard's score depends on no other shard, so a new shard only takes rows into itself and a
    shard whose weight grows only wins rows.
    """
    scores = []
    for s, weight in enumerate(weights):
        if weight <= 0:
            raise ValueError("weights must be positive")
        u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(s)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
        scores.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("score"), F.lit(s).alias("shard")))
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return best["score"], best["shard"]


def shards(docs: DataFrame, n_shards: int = 40, weights: Sequence[float] | None = None, grown_weight: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus 16 and ``text_crc32`` their CRC-32; a null text counts as empty for both.
    Id and weights alone decide the shard (``law`` is ``key``). Slots run gapless from 0 in each shard, in hash-part
    order. ``grown_shard`` is the shard with one more of ``grown_weight``.

    A null id is a key like any other. Repeated rows share a shard and get slots of their own. Other columns don't
    matter; an empty table gives an empty result.
    """
    weights = list(weights) if weights is not None else [1.0] * n_shards
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tall = base.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    score, shard = rendezvous(F.col("doc_id"), weights)
    extra = len(weights)
    tall = tall.withColumns({"__score": score, "shard": shard})
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(extra)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    tall = tall.withColumn("grown_shard", F.when(-F.log(u) / F.lit(float(grown_weight)) < F.col("__score"), F.lit(extra)).otherwise(F.col("shard")))
    tall = park(tall.drop("__score"), "shards")
    out = number(tall, "shard", ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
