"""Operators on the line table ``(id, i, line)`` and on whole texts, as windows and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollweave.functions import text as T


def explode_lines(texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, i, line)`` with ``i`` from 0; a text without lines gives no row."""
    return texts.select(F.col(id_col).alias("id"), F.posexplode(T.lines(F.col(text_col))).alias("i", "line"))


def _runs(table: DataFrame, starts: Column, name: str, order: str = "i") -> DataFrame:
    w = Window.partitionBy("id").orderBy(order)
    return table.withColumn(name, F.sum(starts.cast("int")).over(w))


def collapse_runs(table: DataFrame, longest: int = 5) -> DataFrame:
    """Of each run of ``longest`` or more equal lines the first stays; shorter runs stay whole."""
    w = Window.partitionBy("id").orderBy("i")
    runs = _runs(table, F.coalesce(F.col("line") != F.lag("line").over(w), F.lit(True)), "__run")
    run = Window.partitionBy("id", "__run")
    kept = runs.withColumn("__n", F.count("*").over(run)).withColumn("__k", F.row_number().over(run.orderBy("i")))
    return kept.filter((F.col("__n") < longest) | (F.col("__k") == 1)).select(*table.columns)


def clean_lines(table: DataFrame, least: float = 0.3) -> DataFrame:
    """Runs collapsed first, then lines of too low quality out."""
    # As one expression: a filter over staged columns would be pushed below them and put each stage into the next.
    return collapse_runs(table).filter(T.line_quality(F.col("line")) >= least)


def clean_text(text: Column, least: float = 0.3, longest: int = 5) -> Column:
    """``clean_lines`` of one text as a column, without a shuffle: run starts by comparing neighbours, run lengths by
    the distance to the next start."""

    def collapse(a: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(a) - 1, F.lit(0)))
        starts = F.filter(places, lambda i: F.coalesce(F.get(a, i) != F.get(a, i - 1), F.lit(True)))

        length = lambda st, s, k: F.coalesce(F.get(st, k + 1), F.size(a)) - s
        once = lambda n: F.when(n >= longest, 1).otherwise(n).cast("int")
        runs = lambda st: F.flatten(F.transform(st, lambda s, k: F.array_repeat(F.get(a, s), once(length(st, s, k)))))
        return F.when(F.size(a) == 0, a).otherwise(T.let(starts, runs))

    return T.join_lines(F.filter(T.let(T.lines(text), collapse), lambda x: T.line_quality(x) >= least))


def hallucinated(texts: DataFrame, expected: Column | None = None) -> DataFrame:
    """``(id, hallucinated)``: over five times the expected lines, or over half of them of low quality."""
    bad = lambda a: F.size(F.filter(a, lambda x: T.line_quality(x) < 0.3)) / F.size(a) > 0.5
    long = lambda a: F.coalesce((expected > 0) & (F.size(a) > expected * 5), F.lit(False)) if expected is not None else F.lit(False)
    return texts.select("id", T.let(T.lines(F.col("text")), lambda a: F.when(F.size(a) == 0, False).otherwise(long(a) | bad(a))).alias("hallucinated"))


def blocks(table: DataFrame) -> DataFrame:
    """``(id, block, i, line)``: maximal runs of lines that are not blank, numbered from 0."""
    full = table.withColumn("__full", T.trim(F.col("line")) != "")
    w = Window.partitionBy("id").orderBy("i")
    starts = F.col("__full") & ~F.coalesce(F.lag("__full").over(w), F.lit(False))
    return _runs(full, starts, "block").filter("__full").select("id", (F.col("block") - 1).cast("long").alias("block"), "i", "line")


def block_pairs(lined: DataFrame, unit: str = "block", above: float = 0.85) -> DataFrame:
    """``(id, a, b, similarity)`` of units whose multisets of normalised line hashes are more similar than ``above``.

    Counts come first, so a frequent line is one row a unit. A pair shares more than ``above`` of the longer unit, hence
    some line among the rarest ``n - ceil(above * n) + 1`` positions of either: only those are joined, which keeps hot
    lines out of the join without losing a pair. Then the pair's counts are compared in full.
    """
    counts = lined.groupBy("id", unit, T.normalized_line_hash(F.col("line")).alias("h")).agg(F.count("*").alias("n"))
    df = counts.groupBy("id", "h").agg(F.count("*").alias("df"))
    units = counts.join(df, ["id", "h"]).groupBy("id", unit).agg(F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("df", "h", "n"))).alias("bag"))
    need = F.floor(F.col("size") * F.lit(above)) + 1
    before = Window.partitionBy("id", unit).orderBy("x.df", "x.h").rowsBetween(Window.unboundedPreceding, -1)
    prefix = units.select("id", unit, "size", F.explode("bag").alias("x")).withColumn("__before", F.coalesce(F.sum("x.n").over(before), F.lit(0)))
    prefix = prefix.filter(F.col("__before") <= F.col("size") - need).select("id", unit, "size", F.col("x.h").alias("h"))
    side = lambda s: prefix.select("id", "h", F.col(unit).alias(s), F.col("size").alias(f"size_{s}"))
    pairs = side("a").join(side("b"), ["id", "h"]).filter(F.col("a") < F.col("b"))
    pairs = pairs.filter(F.least("size_a", "size_b") > F.greatest("size_a", "size_b") * F.lit(above)).select("id", "a", "b").distinct()
    bag = lambda s: units.select("id", F.col(unit).alias(s), F.col("size").alias(f"size_{s}"), F.map_from_entries(F.transform("bag", lambda x: F.struct(x["h"], x["n"]))).alias(f"bag_{s}"))
    both = pairs.join(bag("a"), ["id", "a"]).join(bag("b"), ["id", "b"])
    common = F.aggregate(F.map_entries("bag_a"), F.lit(0).cast("long"), lambda acc, e: acc + F.least(e["value"], F.coalesce(F.try_element_at(F.col("bag_b"), e["key"]), F.lit(0))))
    return both.withColumn("similarity", common / F.greatest("size_a", "size_b")).filter(F.col("similarity") > above).select("id", "a", "b", "similarity")


def sections(table: DataFrame) -> DataFrame:
    """``(id, section, start, end, key, body_len)``: from a heading to the next; lines before the first are a section
    without key. The key is the chain of enclosing headings: of the earlier sections those with a lower level than all
    between them and here."""
    w = Window.partitionBy("id").orderBy("i")
    marked = table.withColumn("__head", T.is_heading(F.col("line")))
    marked = marked.withColumn("section", F.sum(F.when(F.col("__head") | (F.col("i") == 0), 1).otherwise(0)).over(w) - 1)
    heads = marked.groupBy("id", "section").agg(
        F.min("i").cast("long").alias("start"), (F.max("i") + 1).cast("long").alias("end"), F.max("__head").alias("head"),
        F.max(F.when(F.col("__head"), F.struct(T.heading_level(F.col("line")).alias("level"), T.normalize_line(F.col("line")).alias("name")))).alias("own"),
    )
    stack = F.array().cast("array<struct<level:int,name:string>>")
    row = F.struct("section", "start", "end", "head", "own")
    per = heads.groupBy("id").agg(F.sort_array(F.collect_list(row)).alias("all"))

    def push(acc: Column, x: Column) -> Column:
        held = F.concat(F.filter(acc["open"], lambda e: e["level"] < x["own"]["level"]), F.array(x["own"]))
        opened = F.when(x["head"], held).otherwise(acc["open"])
        key = F.when(x["head"], F.array_join(F.transform(held, lambda e: e["name"]), "|"))
        return F.struct(opened.alias("open"), F.concat(acc["keys"], F.array(key)).alias("keys"))

    keys = F.aggregate("all", F.struct(stack.alias("open"), F.array().cast("array<string>").alias("keys")), push)["keys"]
    each = per.select("id", F.explode(F.arrays_zip(F.col("all").alias("s"), keys.alias("key"))).alias("z"))
    body = F.col("z.s.end") - F.col("z.s.start") - F.col("z.s.head").cast("int")
    return each.select("id", F.col("z.s.section").cast("long").alias("section"), F.col("z.s.start").alias("start"), F.col("z.s.end").alias("end"), F.col("z.key").alias("key"), body.alias("body_len"))


def dedup_sections(table: DataFrame) -> DataFrame:
    """``(id, i, line)`` with new ``i``: of each key the section with the longest body (the earliest on a tie), at the place
    of the key's first. Sections without a key all stay."""
    found = sections(table)
    same = F.coalesce("key", F.concat(F.lit("\u0000"), F.col("section").cast("string")))
    w = Window.partitionBy("id", same)
    best = found.withColumn("__rank", F.row_number().over(w.orderBy(F.col("body_len").desc(), "section"))).withColumn("place", F.min("section").over(w))
    best = best.filter("__rank = 1").select("id", "start", "end", "place")
    kept = best.select("id", "place", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("i")).join(table.withColumn("i", F.col("i").cast("long")), ["id", "i"])
    order = F.row_number().over(Window.partitionBy("id").orderBy("place", "i")) - 1
    return kept.select("id", order.alias("i"), "line")


def passage_candidates(table: DataFrame) -> DataFrame:
    """``(id, i, first)``: where three normalised lines occur for the first time, for each place at least three lines later
    where they occur again; the first line isn't blank and two of them differ and are not blank."""
    w = Window.partitionBy("id").orderBy("i")
    h = table.select("id", "i", T.normalized_line_hash(F.col("line")).alias("h"))
    tri = h.select("id", "i", F.array("h", F.lead("h", 1).over(w), F.lead("h", 2).over(w)).alias("t")).filter(F.get("t", F.lit(2)).isNotNull())
    first = tri.withColumn("first", F.min("i").over(Window.partitionBy("id", "t")))
    varied = F.size(F.array_distinct(F.filter("t", lambda x: x != T.BLANK))) >= 2
    return first.filter((F.col("first") <= F.col("i") - 3) & (F.get("t", F.lit(0)) != T.BLANK) & varied).select("id", "i", "first")


def chunks(texts: DataFrame, n: int) -> DataFrame:
    """``(id, chunk, text)``: ``n`` chunks of nearly equal line counts (fewer for a shorter text), from 1."""
    per = explode_lines(texts).withColumn("chunk", F.ntile(n).over(Window.partitionBy("id").orderBy("i")))
    return per.groupBy("id", "chunk").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("text"))


def views(texts: DataFrame, visible: int = 6, step: int = 3) -> DataFrame:
    """``(id, k, v)``: what a window of ``visible`` lines shows that scrolls down ``step`` lines at a time and ends at the last
    line; a text without lines shows nothing."""
    a = texts.select("id", T.lines(F.col("text")).alias("__a")).filter(F.size("__a") > 0)
    last = F.greatest(F.size("__a") - visible, F.lit(0))
    seen = a.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(last / step).cast("int"))))
    return seen.select("id", "k", F.slice("__a", F.least(F.col("k") * step, F.greatest(F.size("__a") - visible, F.lit(0))) + 1, F.lit(visible)).alias("v"))


def _suffix_prefix(a: Column, b: Column, n: Column, same) -> Column:
    return same(F.slice(a, F.size(a) - n + 1, n), F.slice(b, F.lit(1), n))


def overlap(a: Column, b: Column, least: int = 3, fuzzy: int = 15) -> Column:
    """Most hashes that end ``a`` and begin ``b``, at least ``least``; else, up to ``fuzzy``, the most with 85 % in place and
    ``least`` not blank; else 0."""
    top = F.least(F.size(a), F.size(b))
    exact = F.array_max(F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), top)), lambda n: (n >= least) & (n <= top) & _suffix_prefix(a, b, n, lambda x, y: x == y)))
    hits = lambda x, y: F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda m: m))
    full = lambda x: F.size(F.filter(x, lambda h: h != T.BLANK))
    near = lambda n: (n >= least) & (n <= top) & _suffix_prefix(a, b, n, lambda x, y: (hits(x, y) >= n * F.lit(0.85)) & (full(x) >= least))
    return F.coalesce(exact, F.array_max(F.filter(F.sequence(F.lit(1), F.lit(fuzzy)), near)), F.lit(0))


def reverse_overlap(a: Column, b: Column, window: int = 10) -> Column:
    """First place in ``a`` of the first (up to) ``window`` hashes of ``b``; -1 if none, or if they say too little."""
    w = F.least(F.size(b), F.lit(window))
    head = F.slice(b, F.lit(1), w)
    found = F.array_min(F.filter(F.sequence(F.lit(0), F.greatest(F.size(a) - w, F.lit(0))), lambda i: (i + w <= F.size(a)) & (F.slice(a, i + 1, w) == head)))
    varied = F.size(F.array_distinct(F.filter(head, lambda h: h != T.BLANK))) >= 2
    return F.when((F.size(b) < 3) | ~varied, -1).otherwise(F.coalesce(found, F.lit(-1)))
