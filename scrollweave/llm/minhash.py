"""MinHash near-duplicate groups with sequential Bayesian verification.

Plan, with every intermediate table in the shared folder:

1. One Arrow pass over the texts gives each row its shingle count, a 128-bit digest of its shingle set, an 8-bit MinHash
   signature and the hashes of its bands. Equal sets share a node, which the lower half of the digest names; should sets
   with different upper halves meet in one, all but one get names of their own.
2. Every band bucket gets its smallest node as hub by a minimum aggregation. All nodes are compared with the hubs of
   their buckets: as many candidates as bucket members, however large a bucket is.
3. Sequential Bayesian pruning drops a candidate after any batch of signature positions in which the posterior chance
   of a similarity over the threshold is under ``miss``. A bit map of each set then gives an upper bound of the
   similarity, which excludes most pairs that are a little under the threshold and none over it. Survivors are confirmed
   on the full shingle sets.
4. In buckets whose nodes are still in more than one component, all nodes outside the largest component are compared with
   all nodes of other components (in blocks if the bucket is large, which send on only what survives pruning), so that no
   banded candidate is lost by the hubs, and a few strays in a large bucket cost no more than a pass over it.
5. Components by large and small stars.

With ``bands`` x ``rows`` = 40 x 5 a pair at similarity 0.8 exactly has no common bucket with probability 1.3e-7 and is
pruned with at most 8e-7; more similar pairs less. Sets hold 64-bit hashes of shingles: of two texts of n shingles, two
different shingles are taken for equal with probability n**2 / 2**64 at most.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrollweave.llm import _textvec as tv
from scrollweave.llm._components import components
from scrollweave.llm._scratch import keyed, park, scope, unpacked

#: Buckets up to this size are paired by a join, larger ones in blocks of BLOCK nodes.
SMALL, BLOCK = 32, 256
#: Bits of the map that bounds the similarity of two sets from above.
MAP_BITS = 4096


def posterior_floor(n: int, threshold: float, miss: float) -> int:
    """Fewest matches in ``n`` positions whose posterior chance of similarity >= threshold is at least ``miss``.

    Under a uniform prior the posterior is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    Signatures hold 8 bits, so unequal minima match by chance in 1 of 256 cases; t is raised by that.
    """
    t = threshold + (1 - threshold) / 256
    tail = 0.0
    for m in range(n + 1):
        tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def digest(shingles: np.ndarray) -> tuple[int, int]:
    """The lower and the upper half of a shingle set's digest, signed 64-bit numbers."""
    x = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(h - (1 << 64) if h >> 63 else h for h in (x & ((1 << 64) - 1), x >> 64))


class Sketcher:
    """Digest, signature, band hashes and bit map of a shingle set."""

    def __init__(self, bands: int, rows: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 32, bands * rows, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows, np.uint32)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        h = (shingles >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for k in range(0, len(h), 512):
            part = self.a[:, None] * h[None, k : k + 512]
            part += self.b[:, None]
            np.minimum(low, part.min(1), out=low)
        return low

    def __call__(self, shingles: np.ndarray) -> tuple[int, bytes, np.ndarray, bytes, int]:
        low = self.minima(shingles)
        grid = low.reshape(self.bands, self.rows).astype(np.uint64)
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(self.rows):
            key = tv.mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
        bits = np.zeros(MAP_BITS, bool)
        bits[(shingles & np.uint64(MAP_BITS - 1)).astype(np.int64)] = True
        signature = (tv.mix(low.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()  # minima of long texts are small numbers
        node, twin = digest(shingles)
        return node, signature, key.view(np.int64), np.packbits(bits).tobytes(), twin


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """``(id, n_shingles, node, twin, signature, buckets, bits)`` for each row; node and what follows are null without a
    shingle."""

    def run(batches):
        sketch = Sketcher(bands, rows)
        for whole in batches:
            for batch in tv.slices(whole, ("text",)):
                bounds, hashes = tv.words(batch.column("text"))
                n, node, twin, signature, buckets, bits = [], [], [], [], [], []
                for s in tv.shingle_sets(bounds, hashes, shingle):
                    n.append(len(s))
                    for out, x in zip((node, signature, buckets, bits, twin), sketch(s) if len(s) else (None,) * 5, strict=True):
                        out.append(x)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(twin, pa.int64()), pa.array(signature, pa.binary()), pa.array(buckets, pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                    ["id", "n_shingles", "node", "twin", "signature", "buckets", "bits"],
                )
        tv.release()

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(run, "id long, n_shingles long, node long, twin long, signature binary, buckets array<long>, bits binary")


def _floors(size: int, threshold: float, miss: float) -> list[tuple[int, int, int]]:
    """(from, to, fewest matches up to there) for each batch of 25 positions."""
    return [(k, min(k + 25, size), posterior_floor(min(k + 25, size), threshold, miss)) for k in range(0, size, 25)]


def _survivors(x: np.ndarray, y: np.ndarray, floors: list[tuple[int, int, int]]) -> np.ndarray:
    """Indices of the rows of two signature arrays that no batch prunes."""
    left, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for a, b, least in floors:
        matches += (x[left, a:b] == y[left, a:b]).sum(1)
        left, matches = left[matches >= least], matches[matches >= least]
    return left


def _possible(n: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether bit maps allow the similarity: each bit in one map alone is a shingle in one set alone, so with d such
    bits the similarity is (n + m - d) / (n + m + d) at most. Nothing that could be linked is lost."""
    apart = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
    return den * (n + m - apart) >= num * (n + m + apart)


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _prune(pairs: DataFrame, signed: DataFrame, floors: list[tuple[int, int, int]], num: int, den: int) -> DataFrame:
    """The pairs that sequential Bayesian comparison of their signatures leaves, less those that bit maps exclude."""
    size = floors[-1][1]

    def run(batches):
        for batch in batches:
            left = _survivors(_matrix(batch.column("sa"), size), _matrix(batch.column("sb"), size), floors)
            batch = batch.take(pa.array(left))
            x, y = (_matrix(batch.column(c), MAP_BITS // 8).view(np.uint64) for c in ("ba", "bb"))
            left = np.flatnonzero(_possible(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), x, y, num, den))
            yield batch.take(pa.array(left)).select(["a", "b"])

    side = lambda s: signed.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("signature").alias(f"s{s}"), F.col("bits").alias(f"b{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "nb", "sa", "sb", "ba", "bb").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs whose full shingle sets have ``den * |both| >= num * |either|``."""

    def run(batches):
        for whole in batches:
            for batch in tv.slices(whole, ("ta", "tb")):
                sets = [list(tv.shingle_sets(*tv.words(batch.column(c)), shingle)) for c in ("ta", "tb")]
                keep = []
                ends = (batch.column(c).to_pylist() for c in ("va", "vb"))
                for k, (x, y, a, b) in enumerate(zip(*sets, *ends, strict=True)):
                    if (digest(x)[1], digest(y)[1]) != (a, b):  # the id stands on another text as well
                        continue
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if both and den * both >= num * (len(x) + len(y) - both):
                        keep.append(k)
                yield batch.take(pa.array(keep, pa.int64())).select(["a", "b"])
        tv.release()

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(ends, "rep").select("node", "twin", "text")
    side = lambda s: texts.select(F.col("node").alias(s), F.col("twin").alias(f"v{s}"), F.col("text").alias(f"t{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "va", "vb", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


def _across(members: DataFrame, signed: DataFrame, floors: list[tuple[int, int, int]], num: int, den: int) -> DataFrame:
    """Unpruned pairs of different components among ``(bucket, node, root)``, every one within a bucket considered.

    Each pair has an end outside the largest component of its bucket, a stray. All nodes of a bucket make rows of BLOCK
    nodes, strays also columns; a node goes to the blocks of its row and a stray to those of its column as well.
    """
    parts = members.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    held = parts.groupBy("bucket").agg(F.sum("n").alias("held"), F.max(F.col("n")).alias("top"), F.max_by("root", "n").alias("major"), F.count("*").alias("parts"))
    mixed = park(held.filter("parts > 1 AND held > 2").select("bucket", "held", "major", (F.col("held") - F.col("top")).alias("strays")), "mixed")
    within = members.join(mixed, "bucket").withColumn("stray", F.col("root") != F.col("major"))
    few = within.filter(F.col("held") <= SMALL)
    side = lambda s: few.select("bucket", F.col("node").alias(s), F.col("root").alias(f"r{s}"), F.col("stray").alias(f"s{s}"))
    pairs = side("a").join(side("b"), "bucket").filter("a < b AND ra <> rb AND (sa OR sb)").select("a", "b").distinct()
    size = floors[-1][1]

    def run(key, table):
        node, root, column = (table.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "column"))
        stray, n = table.column("stray").to_numpy(zero_copy_only=False), table.column("n").to_numpy()
        sig, bits = _matrix(table.column("signature"), size), _matrix(table.column("bits"), MAP_BITS // 8).view(np.uint64)
        rows, a, b = np.flatnonzero(~column), [], []
        for x in np.flatnonzero(column):
            y = rows[(root[rows] != root[x]) & (~stray[rows] | (node[rows] > node[x]))]
            y = y[_survivors(np.broadcast_to(sig[x], (len(y), size)), sig[y], floors)]
            y = y[_possible(n[x], n[y], bits[x], bits[y], num, den)]
            a.append(np.minimum(node[x], node[y]))
            b.append(np.maximum(node[x], node[y]))
        return pa.table({"a": np.concatenate(a or [np.zeros(0, np.int64)]), "b": np.concatenate(b or [np.zeros(0, np.int64)])})

    many = within.filter(F.col("held") > SMALL).join(signed, "node")
    many = many.withColumns({"rows": F.ceil(F.col("held") / BLOCK), "columns": F.ceil(F.col("strays") / BLOCK)})
    place = lambda n: F.pmod(F.xxhash64("node", "bucket"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ("node", "root", "stray", "n", "signature", "bits")
    as_rows = many.select("bucket", place("rows").alias("i"), every("columns").alias("j"), *kept, F.lit(False).alias("column"))
    as_columns = many.filter("stray").select("bucket", every("rows").alias("i"), place("columns").alias("j"), *kept, F.lit(True).alias("column"))
    blocks = as_rows.unionByName(as_columns).groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
    return _prune(pairs, signed, floors, num, den).unionByName(blocks).distinct()


def _named(sketched: DataFrame) -> DataFrame:
    """``sketched`` with a node for each digest: where digests with different upper halves share a lower half, all but the
    least are renamed by a hash of both."""
    clashes = sketched.filter("node IS NOT NULL").groupBy("node").agg(F.min("twin").alias("least"), F.max("twin").alias("most")).filter("least <> most")
    clashes = park(clashes.select("node", "least"), "clashes")
    if clashes.isEmpty():
        return sketched
    renamed = F.when(F.col("twin") != F.col("least"), F.xxhash64("node", "twin")).otherwise(F.col("node"))
    return park(sketched.join(clashes, "node", "left").withColumn("node", renamed).drop("least"), "sketch")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, threshold: tuple[int, int] = (80, 100), bands: int = 40, rows: int = 5, miss: float = 1e-7) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Two texts are linked if ``threshold[1] * |both| >= threshold[0] * |either|`` for their sets of ``shingle``-word
    shingles (A-Z lower-cased; words are runs without ASCII white space; a text of fewer words is one shingle).
    ``component_id`` is the smallest id reachable over links, ``kept`` says that a row has this id.

    Null and empty texts, and texts of white space, have no shingle and form components of their own. A row with a null
    id shares the component of rows with an equal shingle set that have one; without such rows it links with nothing, and
    its ``component_id`` is null. Its ``kept`` is null. Repeated rows share a component. Other columns are ignored, whatever their names.
    """
    num, den = threshold
    floors = _floors(bands * rows, num / den, miss)
    with scope() as keep:
        rows_, final = _grouped(docs, id_col, text_col, shingle, bands, rows, floors, num, den)
        keep(rows_)
        keep(final)
    out = rows_.select("id", "n_shingles", "node").join(final, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, bands: int, rows: int, floors: list[tuple[int, int, int]], num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row, and ``(node, component_id)``, both parked."""
    rows_ = _named(park(sketches(docs, id_col, text_col, shingle, bands, rows), "sketch"))
    nodes = park(rows_.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("rep"), F.min("twin").alias("twin")), "nodes")
    banded = rows_.filter("node IS NOT NULL").select("node", F.explode("buckets").alias("bucket"))
    hubs = banded.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top")
    hubs = park(hubs.select("bucket", "hub"), "hubs")
    members = park(banded.join(hubs, "bucket").distinct(), "members")
    stars = members.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    wanted = members.select("node").distinct().join(nodes, "node").filter("rep IS NOT NULL")
    signed = park(wanted.join(rows_.select(F.col("id").alias("rep"), "node", F.col("n_shingles").alias("n"), "signature", "bits"), ["rep", "node"]).select("node", "n", "signature", "bits").dropDuplicates(["node"]), "signed")
    confirm = lambda pairs: _confirm(pairs, nodes, docs, id_col, text_col, shingle, num, den)

    links = park(confirm(park(_prune(stars, signed, floors, num, den), "pruned")), "links")
    roots = components(links)
    labelled = members.join(roots, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"))
    rest = park(_across(labelled, signed, floors, num, den).join(links, ["a", "b"], "left_anti"), "across")
    more = park(confirm(rest), "links")
    if not more.isEmpty():
        roots = components(links.unionByName(more))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = park(named.join(least, "root").select("node", "component_id"), "final")
    return rows_, final


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without near duplicates: one row of each group, that with the smallest id, or with a null one if no row has
    an id.

    All columns stay as they are, whatever their names. Rows are told apart by a key of their own, so null ids, ids on
    several texts and repeated rows are rows like others. Rows without a shingle (null and empty texts) are groups of
    their own; an empty table stays empty.
    """
    rows = keyed(docs)
    with scope() as keep:
        texts = rows.select("row", F.col("doc").getField(text_col).alias("text"))
        found = near_duplicates(texts, "row", "text", **options).select(F.col("doc_id").alias("row"), "component_id")
        ids = rows.select("row", F.col("doc").getField(id_col).cast("long").alias("id"))
        order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
        found = park(found.join(ids, "row").select("row", "component_id", order.alias("order")), "found")
        best = found.groupBy("component_id").agg(F.min("order")["row"].alias("row"))
        best = keep(park(best.select("row"), "best"))
    return unpacked(rows.join(best, "row", "left_semi"), docs.columns)
