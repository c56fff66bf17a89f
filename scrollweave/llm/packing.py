"""Length buckets with least padding, found by dynamic programming over the global length histogram, and token-budget
batches inside each bucket."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollweave.llm._scratch import keyed, park
from scrollweave.llm._slots import number
from scrollweave.llm.tokens import token_counts

#: Lengths up to EXACT have a histogram bin each; above, bins are 1/256 of their power of two wide.
EXACT = 16_384


def bin_top(length: Column) -> Column:
    """The largest length of the histogram bin of ``length``; under 30,000 bins in all, whatever the data."""
    width = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - 8).cast("long")
    return F.when(length <= EXACT, length).otherwise((F.ceil(length / width) * width).cast("long"))


def best_buckets(tops: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """At most ``k`` upper bounds with the least sum of ``bound * rows``, hence the least padding.

    ``best[b][j]`` is the least cost of the first ``j`` bins in ``b`` buckets. The cost of a bucket satisfies the
    quadrangle inequality, so the best split points ascend and each layer takes O(n log n) by divide and conquer.
    """
    n = len(tops)
    if not n:
        return []
    tops, total = tops.astype(np.float64), np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    best = np.concatenate([[0.0], tops * total[1:]])
    splits = []
    for _ in range(1, min(k, n)):
        now, split = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        now[0] = 0.0
        work = [(1, n, 0, n - 1)]
        while work:
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            cost = best[i] + tops[mid - 1] * (total[mid] - total[i])
            at = int(cost.argmin())
            now[mid], split[mid] = cost[at], i[at]
            work += [(lo, mid - 1, a, int(i[at])), (mid + 1, hi, int(i[at]), b)]
        splits.append(split)
        best = now
    bounds, j = [int(tops[-1])], n
    for split in reversed(splits):
        j = int(split[j])
        if not j:
            break
        bounds.append(int(tops[j - 1]))
    return bounds[::-1]


def word_count(text: Column) -> Column:
    """Words (runs without ASCII white space) and one end token: a length where no tokenizer is at hand."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")) + 1


def pack(docs: DataFrame, n_buckets: int = 16, budget: int = 65_536, id_col: str = "doc_id", length: Column | None = None, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, bucket, bound, batch, slot, padding`` for every row; only ids and lengths are shuffled.

    The length of a row is ``length``, else its text's tokens by the ``tokenizer`` file and one end token, else its words
    and one. A row goes to the first bucket whose ``bound`` (the padded length) reaches its length. A batch of a bucket
    holds ``budget // bound`` rows, so its padded tokens keep the budget; a row over the budget is a batch of its own.
    ``slot`` is the row's place in its batch, batches count from 0 in each bucket, only a bucket's last is not full.
    The one thing gathered on the driver is the histogram, of under 30,000 bins.

    A null or empty text has the length of its end token (1); a null ``length`` counts as 0. Null ids and repeated rows
    are packed like others; an empty table gives an empty result; other columns don't matter.
    """
    if length is None and tokenizer is not None:
        rows = token_counts(docs, tokenizer, id_col, text_col)
    else:
        size = word_count(F.col(text_col)) if length is None else length
        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(size.cast("long"), F.lit(0)).alias("n_tokens"))
    tall = park(rows.groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies")), "lengths")
    bins = sorted((r.top, r.n) for r in tall.groupBy(bin_top(F.col("n_tokens")).alias("top")).agg(F.sum("copies").alias("n")).collect())
    bounds = best_buckets(np.array([b[0] for b in bins]), np.array([b[1] for b in bins]), n_buckets)
    bucket = F.lit(max(0, len(bounds) - 1))
    for k in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
    placed = number(tall.withColumn("bucket", bucket.cast("int")), "bucket", ["doc_id", "n_tokens"])
    table = F.array(*(F.lit(b).cast("long") for b in bounds or [0]))
    placed = placed.withColumn("bound", F.get(table, F.col("bucket"))).withColumn("__rows", F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bound"), F.lit(1)))))
    return placed.select(
        "doc_id", "n_tokens", "bucket", "bound", F.floor(F.col("slot") / F.col("__rows")).alias("batch"),
        F.pmod("slot", "__rows").alias("slot"), (F.col("bound") - F.col("n_tokens")).alias("padding"),
    )


def pack_rows(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the columns ``n_tokens, bucket, bound, batch, slot, padding`` of ``pack`` beside its own; one of its own
    that has such a name gets ``doc_`` before it (as often as needed).

    Rows are told apart by a key of their own, so null ids and repeated rows are rows like others.
    """
    added = ("n_tokens", "bucket", "bound", "batch", "slot", "padding")
    names: dict[str, str] = {}
    for c in docs.columns:
        name = c
        while name.lower() in added or name in names.values() or (name != c and name in docs.columns):
            name = f"doc_{name}"
        names[c] = name
    rows = keyed(docs)
    texts = rows.select("row", F.col("doc").getField(text_col).cast("string").alias("text"))
    packed = pack(texts, id_col="row", text_col="text", **options).withColumnRenamed("doc_id", "row")
    whole = (F.col("doc").getField(c).alias(n) for c, n in names.items())
    return rows.join(packed, "row").select(*whole, *added)
