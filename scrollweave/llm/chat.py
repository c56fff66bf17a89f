"""Chat formatting as a prefix tree: turns that conversations share from their start are emitted once.

A node of the tree is a turn with all turns before it. Nodes come out depth first; each has the token ids of its turn,
the position of its first token in the conversation, a loss mask, and the intervals of the token stream that it may
attend to, which are its ancestors.

All that follows a conversation turn by turn is a running window in the JVM. A node's name is the running exclusive or of
two 64-bit hashes of each turn with its depth. Its place in the stream needs no walk: it is its position in the
conversation plus, for it and each ancestor, the tokens under earlier siblings. Python encodes each node once and decodes
each node once.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scrollweave.llm import _textvec as tv
from scrollweave.llm._scratch import discard, park
from scrollweave.llm._slots import running

#: Strings with a meaning in the template or in common templates; inside texts they are escaped.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
_escaped = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))
_HEAD, _MIDDLE, _TAIL = "<s>[ROLE]", "[/ROLE]\n", "</s>\n"

#: Fixed value: how byte-level vocabularies of this kind cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def escape(text: str) -> str:
    """Double every backslash and put one behind the first character of a control string."""
    if "\\" not in text and "<" not in text and "[" not in text:
        return text
    return _escaped.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a formatted turn."""
    return f"{_HEAD}{escape(role)}{_MIDDLE}", escape(text), _TAIL


def parse(formatted: str) -> list[tuple[str, str]]:
    """The ``(role, text)`` turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        role = at + len(_HEAD)
        middle = formatted.find(_MIDDLE, role)
        tail = formatted.find(_TAIL, middle + len(_MIDDLE))
        if not formatted.startswith(_HEAD, at) or middle < 0 or tail < 0:
            raise ValueError("no turn where one should begin")
        turns.append((unescape(formatted[role:middle]), unescape(formatted[middle + len(_MIDDLE) : tail])))
        at = tail + len(_TAIL)
    return turns


@cache
def encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """A function from texts to ids, read once in each Python worker, which serves many tasks.

    ``path`` is a file of byte-level ranks (``.tiktoken``), cut by PATTERN, or a tokenizers file. Special tokens are
    ordinary text, and decoding gives back what was encoded.
    """
    if path.endswith(".tiktoken"):
        import tiktoken

        own = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
        return lambda texts: list(map(own.encode_ordinary, texts))
    known = _tokenizer(path)
    return lambda texts: [x.ids for x in known.encode_batch_fast(texts, add_special_tokens=False)]


@cache
def decoder(path: str) -> Callable[[np.ndarray, np.ndarray], list[str]]:
    """A function from ids and the bounds of texts in them to texts. With ranks it puts the bytes of tokens together."""
    if not path.endswith(".tiktoken"):
        known = _tokenizer(path)
        return lambda ids, bounds: known.decode_batch([ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], skip_special_tokens=False)
    tokens = sorted(_ranks(path).items(), key=lambda x: x[1])
    size, flat = np.zeros(tokens[-1][1] + 1, np.int64), np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
    size[[rank for _, rank in tokens]] = [len(t) for t, _ in tokens]
    first = np.cumsum(size) - size

    def run(ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        at = np.concatenate([[0], np.cumsum(size[ids])])[bounds].tolist()
        data = flat[tv.ranges(first[ids], size[ids])].tobytes()
        return [data[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:], strict=True)]

    return run


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.encode_special_tokens = True
    return known


def _paths(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, node, parent, role, text``: node names a turn with all before it, by 128 bits."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumn("depth", F.row_number().over(w).cast("long") - 1)
    rows = rows.withColumns({f"h{k}": F.xxhash64(F.lit(k), "depth", "role", "text") for k in (1, 2)})
    rows = rows.withColumns({f"n{k}": F.bit_xor(f"h{k}").over(so_far) for k in (1, 2)})
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    above = pair(F.col("n1").bitwiseXOR(F.col("h1")), F.col("n2").bitwiseXOR(F.col("h2")))
    return rows.select("conv_id", "depth", pair(F.col("n1"), F.col("n2")).alias("node"), above.alias("parent"), "role", "text")


TOKENS = "node struct<a: long, b: long>, parent struct<a: long, b: long>, owner long, n_tokens long, body long, body_end long, loss boolean, ids array<int>"


def _encoded(nodes: DataFrame, tokenizer: str) -> DataFrame:
    """TOKENS rows from ``(node, parent, owner, role, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        heads: dict[str, list[int]] = {}
        tail = encode([_TAIL])[0]
        for whole in batches:
            for batch in tv.slices(whole, ("role", "text")):
                roles = batch.column("role").to_pylist()
                if len(heads) > 1024:
                    heads.clear()
                for role in set(roles) - set(heads):
                    heads[role] = encode([parts(role, "")[0]])[0]
                bodies = encode([escape(t) for t in batch.column("text").to_pylist()])
                ids = [heads[r] + b + tail for r, b in zip(roles, bodies, strict=True)]
                first = [len(heads[r]) for r in roles]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), batch.column("parent"), batch.column("owner"), pa.array(map(len, ids), pa.int64()), pa.array(first, pa.int64()),
                     pa.array([a + len(b) for a, b in zip(first, bodies, strict=True)], pa.int64()), pa.array([r == "assistant" for r in roles]), pa.array(ids, pa.list_(pa.int32()))],
                    ["node", "parent", "owner", "n_tokens", "body", "body_end", "loss", "ids"],
                )

    return nodes.select("node", "parent", "owner", "role", "text").mapInArrow(run, TOKENS)


def prefix_tree(conversations: DataFrame, tokenizer: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(stream, index)``.

    ``stream`` has a row for each node, in files by depth-first order: ``part, seq`` (place), ``node, start`` (its first
    token in the stream), ``position`` (id of its first token in the conversation; the others count on), ``n_tokens,
    ids``, ``loss_from, loss_to`` (token range under the loss mask, equal if none) and ``visible``, the ``[from, to)``
    intervals of the stream that it attends to besides itself. ``index`` has ``conv_id, depth, node``.

    Turns are ordered by turn, then role, then text; null roles and texts count as empty, a null turn comes first, and
    rows with a null conversation id are one conversation. Repeated rows are turns of their own. Other columns don't
    matter; an empty table gives empty results. A conversation is one task's where its turns are followed, without
    their texts but for the first time; the nodes under one parent are not.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    paths = park(_paths(turns), "paths")
    # Rows of one node are alike but for the conversation, so any of them does; the least conversation owns the node.
    alike = {c: F.any_value(c).alias(c) for c in ("parent", "role", "text")}
    nodes = paths.groupBy("node").agg(F.min("conv_id").alias("owner"), *alike.values())
    tokens = park(_encoded(nodes, tokenizer), "tokens")
    index = park(paths.select("conv_id", "depth", "node"), "index")
    discard(paths)

    by = Window.partitionBy("conv_id").orderBy("depth")
    before, whole = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv_id")
    none = F.lit(0).cast("long")
    rows = index.join(tokens.select("node", "owner", "n_tokens"), "node").withColumn("own", F.col("conv_id").eqNullSafe(F.col("owner")))
    mine = F.when(F.col("own"), F.col("n_tokens")).otherwise(none)
    rows = rows.withColumns({"mine": mine, "position": F.coalesce(F.sum("n_tokens").over(before), none)})
    rows = rows.withColumn("under", F.sum("mine").over(whole) - F.coalesce(F.sum("mine").over(before), none))
    tree = park(rows.select("conv_id", "depth", "node", "own", "n_tokens", "position", "under"), "tree")

    # Every node under a node is owned by one conversation, which runs through it.
    sizes = tree.groupBy("node").agg(F.sum("under").alias("size"))
    sizes = park(sizes.join(tokens.select("node", "parent"), "node"), "sizes")
    earlier = running(sizes, "parent", ["node"], "size").select("node", F.col("__before").alias("earlier"))
    walked = tree.join(earlier, "node").withColumn("start", F.col("position") + F.sum("earlier").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    walked = walked.withColumn("before", F.lag(F.col("start") + F.col("n_tokens")).over(by))
    jump = (F.col("depth") == 0) | (F.col("earlier") > 0)
    jumps = F.collect_list(F.when(jump, F.struct(F.col("start").alias("start"), F.col("before").alias("before")))).over(before)
    walked = walked.withColumn("jumps", jumps).filter("own")
    ends = lambda x, k: F.struct(x["start"].alias("from"), F.coalesce(F.get("jumps", k + 1)["before"], F.col("before")).alias("to"))
    placed = walked.select("node", "start", "position", F.transform("jumps", ends).alias("visible"))

    loss_to = F.when(F.col("loss"), F.col("body_end")).otherwise(F.col("body"))
    stream = tokens.select("node", "n_tokens", "ids", F.col("body").alias("loss_from"), loss_to.alias("loss_to")).join(placed, "node")
    place = F.monotonically_increasing_id()
    stream = stream.repartitionByRange("start").sortWithinPartitions("start").withColumn("__place", place)
    stream = stream.withColumns({"part": F.shiftright("__place", 33).cast("int"), "seq": F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))})
    done = park(stream.select("part", "seq", "node", "start", "position", "n_tokens", "ids", "loss_from", "loss_to", "visible"), "stream")
    for table in (tokens, tree, sizes):
        discard(table)
    return done, index


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
_SAID = "node struct<a: long, b: long>, n_turns long, said string, learned string, formatted_chars long, n_tokens long"


def _decoded(stream: DataFrame, tokenizer: str) -> DataFrame:
    """_SAID rows: what the tokens of a node say, as ``role\\ntext\\n`` for each turn parsed from the formatted text, and
    the text under the loss mask, unescaped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = decoder(tokenizer)
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                lists = batch.column("ids")
                ids, bounds = lists.flatten().to_numpy(), lists.offsets.to_numpy().astype(np.int64)
                bounds -= bounds[0]
                # What lies before the mask, under it and behind it are texts of their own.
                first, last = (bounds[:-1] + batch.column(c).to_numpy() for c in ("loss_from", "loss_to"))
                pieces = decode(ids, np.append(np.stack([bounds[:-1], first, last], 1).ravel(), bounds[-1]))
                formatted, learned = list(map("".join, zip(pieces[::3], pieces[1::3], pieces[2::3], strict=True))), pieces[1::3]
                turns = [parse(x) for x in formatted]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("node"), pa.array(map(len, turns), pa.int64()), pa.array("".join(f"{r}\n{t}\n" for r, t in own) for own in turns),
                     pa.array(map(unescape, learned), pa.string()), pa.array(map(len, formatted), pa.int64()), batch.column("n_tokens")],
                    ["node", "n_turns", "said", "learned", "formatted_chars", "n_tokens"],
                )

    return stream.select("node", "ids", "loss_from", "loss_to", "n_tokens").mapInArrow(run, _SAID)


def read_back(stream: DataFrame, index: DataFrame, tokenizer: str) -> DataFrame:
    """One DIGEST row for each conversation, decoded from the tree: each node is decoded once, and its texts go to the
    conversations that run through it. Null conversation ids are one conversation; an empty tree gives no row."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64())])
    columns = ("conv_id", "n_turns", "said", "learned", "formatted_chars", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, totals, turns, loss = None, None, None, None

        def done() -> list:
            return [conv, totals[0], turns.hexdigest(), totals[1], loss.hexdigest(), totals[2], totals[3]]

        for batch in batches:
            out = []
            for own, n, said, learned, chars, size in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if totals is None or own != conv:
                    if totals is not None:
                        out.append(done())
                    conv, totals, turns, loss = own, [0, 0, 0, 0], hashlib.sha256(), hashlib.sha256()
                turns.update(said.encode())
                loss.update(learned.encode())
                totals = [a + b for a, b in zip(totals, (n, len(learned), chars, size), strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if totals is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(done(), schema, strict=True)], schema=schema)

    both = index.join(_decoded(stream, tokenizer), "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return both.select(*columns).mapInArrow(run, DIGEST)
