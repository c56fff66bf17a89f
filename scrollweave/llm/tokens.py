"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollweave.llm import _textvec as tv
from scrollweave.llm._scratch import fresh

#: Encoded pieces above which a worker forgets those that the last batches did not have, some 40 MB; bytes of a batch. Pieces that one
#: library call encodes, as strings of JOINED pieces each: a result of the library holds far more than the ids and costs
#: more than most pieces.
KNOWN, BATCH, AT_ONCE, JOINED = 600_000, 1 << 23, 4_096, 64
SCHEMA = "file int, doc_id long, local_start long, n_tokens long, ids array<int>"
MANIFEST = "file int, path string, first long, last long, nulls boolean, total long"
#: Files whose manifest rows are broadcast: 16 bytes each, 16 MB at most. Beyond, the manifest is joined by a shuffle.
MOST_BROADCAST = 1_000_000

_ALPHABET, _MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BEFORE_MARKS = r"([\pL\pN])[!-/:-@\[-`{-~]+$"


def _separable(tokenizer) -> bool:
    """Whether the tokenizer drops white space and cuts there, by probes: pieces between white space can then be encoded
    each by itself."""
    if any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.content or t.content.split() != [t.content] for t in tokenizer.get_added_tokens_decoder().values()):
        return False
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    probes = ["a", "the", "Word", "it's", "'s", "x.", "...", "(", "42", "1", "\u00e9", "\u4e2d", "\u0301", "<"]
    gaps = [" ", "  ", "\n", "\t", "\r\n", "\x0b\x0c"]
    if any(ids(g) or ids(f"{g}a{g}") != ids("a") for g in gaps):
        return False
    return all(ids(x + gaps[(i + j) % len(gaps)] + y) == ids(x) + ids(y) for i, x in enumerate(probes) for j, y in enumerate(probes))


def _cuts_marks(tokenizer) -> bool:
    """Whether the tokenizer cuts between a letter or digit and the ASCII marks that end a piece, by probes."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    tails = [*_MARKS, *(a + b for a in _MARKS for b in ".,'\")!")]
    return all(ids(x + t) == ids(x) + ids(t) for x in ("word", "it's", "42", "caf\u00e9", "\u4e2d", "x-y") for t in tails)


def _separator(tokenizer) -> tuple[str, int] | None:
    """A rare symbol that the tokenizer has as one id between blanks."""
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids
    for c in map(chr, [*range(0x2500, 0x2800), *range(0x4E00, 0x4F00), *range(0xA1, 0x250)]):
        one = ids(c)
        if len(one) == 1 and ids(f"a {c} b") == [*ids("a"), *one, *ids("b")]:
            return c, one[0]
    return None


def _folded(column: pa.LargeStringArray) -> pa.LargeStringArray:
    data, offsets = tv.text_bytes(column)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer(offsets), pa.py_buffer(tv.FOLD[data]))


class _Pieces:
    """Ids of pieces of text, as arrays."""

    def __init__(self):
        self.keys = pa.array([], pa.large_string())
        self.first, self.size, self.used = (np.zeros(0, np.int64) for _ in range(3))
        self.flat, self.tick = np.zeros(0, np.int32), 0

    def find(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece; -1 if it isn't known."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.keys), -1).to_numpy().astype(np.int64)

    def ids(self, at: np.ndarray) -> np.ndarray:
        return self.flat[tv.ranges(self.first[at], self.size[at])]

    def add(self, pieces: pa.Array, size: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The places of new pieces."""
        self.keys = pa.concat_arrays([self.keys, pieces.cast(pa.large_string())])
        self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(size) - size])
        self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        self.used = np.concatenate([self.used, np.full(len(size), self.tick)])
        return np.arange(len(self.size) - len(size), len(self.size))

    def age(self) -> None:
        """Another batch begins. If too many pieces are known, those that the last two did not have go."""
        if len(self.size) > KNOWN:
            kept = np.flatnonzero(self.used >= self.tick - 1)
            keys, size, flat, used = self.keys.take(pa.array(kept)), self.size[kept], self.ids(kept), self.used[kept]
            tick = self.tick
            self.__init__()
            self.tick = tick
            self.add(keys, size, flat)
            self.used = used
        self.tick += 1


@cache
def encoder(path: str) -> Callable[..., tuple[np.ndarray, np.ndarray | None]]:
    """A function from texts to ``(lengths, ids)``, the same as encoding each whole text without special tokens added;
    with ``ids=False`` to lengths alone.

    Made once in each Python worker, which serves many tasks. A tokenizer that does not cut at white space (probed) gets
    whole texts. For others, texts are cut at ASCII white space, each distinct piece of a batch is encoded once, and
    pieces stay known while batches have them. Where the tokenizer lower-cases, A-Z are folded first; where it cuts before
    the marks that end a piece (probed), new pieces are encoded without these, and the marks by themselves. Neither is
    done in a batch that spells an added token in any case. Pieces go to the library joined by a separator that is one id;
    a group in which this id is found more often than it was put there is encoded piece by piece.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    separable, between = _separable(tokenizer), _separator(tokenizer)
    cuts = _cuts_marks(tokenizer)
    folds = tokenizer.normalizer is not None and tokenizer.normalizer.normalize_str(_ALPHABET) == _ALPHABET.lower()
    known = _Pieces()

    def encode(texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int32) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(lengths, ids)`` of pieces."""
        sizes, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for some in batched(pieces, AT_ONCE):
            groups = list(batched(some, JOINED if between else 1))
            glue = f" {between[0]} " if between else ""
            for group, ids in zip(groups, encode([glue.join(g) + glue for g in groups]), strict=True):
                ends = np.flatnonzero(ids == between[1]) if between else np.array([len(ids)])
                if len(ends) == len(group):
                    sizes.append(np.diff(ends, prepend=-1) - 1 if between else ends)
                    flat.append(ids[ids != between[1]] if between else ids)
                else:
                    own = encode(group)
                    sizes.append(np.array([len(x) for x in own]))
                    flat += own
        return np.concatenate(sizes), np.concatenate(flat)

    def learn(pieces: pa.Array, cut: bool) -> np.ndarray:
        """The places of pieces that aren't known yet."""
        if not cut:
            return known.add(pieces, *joined(pieces.to_pylist()))
        pieces = pieces.cast(pa.large_string())
        heads = pc.replace_substring_regex(pieces, _BEFORE_MARKS, r"\1")
        data, bounds = tv.text_bytes(pieces)
        head = pc.binary_length(heads).to_numpy().astype(np.int64)
        rest = np.diff(bounds) - head
        ends = np.concatenate([[0], np.cumsum(rest)])
        tails = pa.LargeStringArray.from_buffers(len(rest), pa.py_buffer(ends), pa.py_buffer(data[tv.ranges(bounds[:-1] + head, rest)]))
        parts = pa.concat_arrays([heads, tails]).dictionary_encode()
        at = known.find(parts.dictionary)
        new = parts.dictionary.filter(pa.array(at < 0))
        at[at < 0] = known.add(new, *joined(new.to_pylist()))
        both = at[parts.indices.to_numpy().reshape(2, -1).T]
        marked = np.flatnonzero(rest > 0)
        out = both[:, 0]
        out[marked] = known.add(pieces.take(pa.array(marked)), known.size[both[marked]].sum(1), known.ids(both[marked].ravel()))
        return out

    def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = [x for some in batched(column.to_pylist(), 64) for x in encode(some)]
        return np.array([len(x) for x in found], np.int64), np.concatenate([np.zeros(0, np.int32), *found])

    def run(column: pa.Array, ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        column = pc.fill_null(column, "").cast(pa.large_string())
        if not separable:
            return whole(column)
        plain = not any(pc.any(pc.match_substring(column, a, ignore_case=True)).as_py() for a in added)
        if folds and plain:
            column = _folded(column)
        pieces = pc.ascii_split_whitespace(column)
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(pieces).dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        known.age()
        at = known.find(coded.dictionary)
        if (at < 0).any():
            at[at < 0] = learn(coded.dictionary.filter(pa.array(at < 0)), cuts and plain)
        known.used[at] = known.tick
        at = at[coded.indices.to_numpy()]
        ends = np.concatenate([[0], np.cumsum(known.size[at])])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        return ends[bounds[1:]] - ends[bounds[:-1]], known.ids(at) if ids else None

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens``: the number of ids of every text and one end id, in one pass without a shuffle. A null text has
    the end id alone; null ids and repeated rows are rows like others; other columns don't matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for whole in batches:
            for batch in tv.slices(whole, ("text",), BATCH):
                lengths, _ = encode(batch.column("text"), ids=False)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lengths + 1)], ["doc_id", "n_tokens"])
        tv.release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, stripe_mb: int = 64) -> None:
    """Write the ids of every text, ``end_id`` after each, as ORC files under ``path`` in ascending id order.

    Rows are dealt by ranges of the id and, so that many rows of one id make several files, of the first 32 characters of
    the text and the row's place in the input; file ``k`` holds range ``k``, and each row knows the ids before it in its file.
    ``files`` ranges are made, or as many as the session has shuffle partitions. Stripes have integer run-length
    encoding, row indexes each 1,000 rows and Bloom filters on ``doc_id``. ``path/_manifest`` has a row for each file.

    Null and empty texts have the end id alone, null ids come first, repeated rows are rows like others, an empty table
    makes no file with rows; other columns don't matter.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.substring("text", 1, 32).alias("begin"), F.monotonically_increasing_id().alias("place"), "text")
    order = ("doc_id", "begin", "place")
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    ordered = dealt.sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before = encoder(tokenizer), 0
        for whole in batches:
            for batch in tv.slices(whole, ("text",), BATCH):
                lengths, ids = encode(batch.column("text"))
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                lengths = lengths + 1
                ends = np.concatenate([[0], np.cumsum(lengths)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("file").cast(pa.int32()), batch.column("doc_id"), pa.array(before + ends[:-1]), pa.array(lengths), lists], ["file", "doc_id", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])
        tv.release()

    options = {"orc.compress": "ZSTD", "orc.stripe.size": str(stripe_mb << 20), "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}
    ordered.mapInArrow(run, SCHEMA).write.options(**options).mode("overwrite").orc(path)
    written = docs.sparkSession.read.schema(SCHEMA).orc(path).withColumn("path", F.input_file_name())
    summary = written.groupBy("file").agg(F.first("path").alias("path"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("nulls"), F.sum("n_tokens").alias("total"))
    summary.write.mode("overwrite").parquet(f"{path}/_manifest")


def _begins(spark: SparkSession, path: str) -> DataFrame:
    """``file, path, first, last, nulls, begin``: the manifest, with the ids before each file. One row a file."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    return manifest.withColumn("begin", F.sum("total").over(Window.orderBy("file")) - F.col("total")).drop("total")


def _placed(rows: DataFrame, begins: DataFrame) -> DataFrame:
    begins = begins.select(F.col("file").alias("__file"), F.col("begin").alias("__begin"))
    if begins.count() <= MOST_BROADCAST:
        begins = F.broadcast(begins)
    return rows.join(begins, F.col("file") == F.col("__file")).select("doc_id", (F.col("__begin") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; filters on ``doc_id`` reach stripes, row indexes and Bloom filters.

    Where a file begins is a sum over the manifest, which has one row a file and is broadcast up to MOST_BROADCAST rows:
    ids are not shuffled.
    """
    return _placed(spark.read.schema(SCHEMA).orc(path), _begins(spark, path))


def read_documents(spark: SparkSession, path: str, ids: Sequence[int | None]) -> DataFrame:
    """The rows of ``read_tokens`` for a few ``ids`` (null included): only files whose range has one are opened."""
    begins, wanted = _begins(spark, path), [i for i in ids if i is not None]
    near = F.lit(False)
    for i in wanted:
        near = near | F.lit(i).between(F.col("first"), F.col("last"))
    own = F.col("doc_id").isin(wanted)
    if None in ids:
        near, own = near | F.col("nulls"), own | F.col("doc_id").isNull()
    paths = [r.path for r in begins.filter(near).select("path").collect()]
    rows = spark.read.schema(SCHEMA).orc(paths) if paths else spark.createDataFrame([], SCHEMA)
    return _placed(rows.filter(own), begins)


def stripes(path: str) -> int:
    """The number of stripes of one file, by its URI or local path."""
    return _orc(path).nstripes


def read_stripe(path: str, stripe: int) -> pa.RecordBatch:
    """One stripe of one file (a URI or local path), for readers that take stripes in parallel."""
    return _orc(path).read_stripe(stripe)


def _orc(path: str):
    from pyarrow import fs, orc

    store, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return orc.ORCFile(store.open_input_file(place))


def token_digest(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None, **options) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every row, read back from the files that were written.

    ``start`` counts the ids of all documents before, ``n_tokens`` has the end id, ``ids_crc32`` is the unsigned CRC-32
    of the ids as little-endian unsigned 32-bit integers. A null or empty text has the end id alone. Null ids come
    first; rows of one id stand in the order of the first 32 characters of their texts. Repeated rows give a
    row each, an empty table an empty result; other columns don't matter.
    """
    path = path or fresh(docs.sparkSession, "orc")
    write_tokens(docs, path, tokenizer, end_id, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            ids, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    back = read_tokens(docs.sparkSession, path)
    return back.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
