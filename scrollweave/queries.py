"""Registered queries for the text, frame and extraction operators, and the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrollweave import sql
from scrollweave.functions import text as T
from scrollweave.operators import extract, folds, frames, lines
from scrollweave.plans import chain
from scrollweave.sources import sinks
from scrollweave.sql import d_hash, d_lines, d_norm, d_trim

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.explode_lines(_texts(spark, sf))


_L = f"L AS (SELECT doc_id AS id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, {d_lines('text')} AS a FROM documents))"


def d_quality(prefix: str) -> str:
    """CTEs from ``prefix``'s table L (line) to Q with the parts and the score of each distinct line."""
    tokens = " OR ".join(f"contains(t, '{w} ')" for w in T.CODE_TOKENS)
    words = f"list_filter(regexp_split_to_array(t, '{sql.WS}+'), lambda w: w <> '')"
    ident = lambda w: f"regexp_matches({w}, '[_.]|::|\\p{{Ll}}\\p{{Lu}}')"
    return f"""{prefix},
U AS (SELECT line, {d_trim('line')} AS t FROM (SELECT DISTINCT line FROM L)),
V AS (SELECT *, {words} AS ws, list_transform({words}, lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}_.:]', '', 'g')) AS bare,
  strlen(regexp_replace(t, '\\P{{L}}', '', 'g')) AS alpha, len(regexp_extract_all(t, '\\p{{Lu}}')) AS uppers,
  coalesce(list_max(list_transform(regexp_extract_all(t, '\\p{{L}}+'), lambda w: length(w))), 0) AS run FROM U),
P AS (SELECT *,
  CASE WHEN prefix(t, '|') AND suffix(t, '|') AND len(regexp_extract_all(t, '[|]')) >= 3 THEN 0.5::DOUBLE ELSE least(0.5::DOUBLE,
    (CASE WHEN prefix(t, '#') OR prefix(t, '```') THEN 0.4::DOUBLE ELSE 0::DOUBLE END) + (CASE WHEN prefix(t, '- ') OR prefix(t, '* ') OR prefix(t, '> ') OR prefix(t, '//') THEN 0.3::DOUBLE ELSE 0::DOUBLE END)
    + (CASE WHEN {tokens} THEN 0.3::DOUBLE ELSE 0::DOUBLE END) + least(len(regexp_extract_all(t, '[={{}}()\\[\\];:,.]')) * 0.05::DOUBLE, 0.2::DOUBLE)) END AS bonus,
  CASE WHEN len(ws) = 0 THEN 0::DOUBLE ELSE least(0.5::DOUBLE, len(list_filter(bare, lambda w: strlen(w) > 15 AND NOT {ident('w')})) / len(ws)::DOUBLE * 0.6::DOUBLE) END AS long_word,
  CASE WHEN alpha < 5 THEN 0::DOUBLE WHEN uppers / alpha::DOUBLE > 0.3::DOUBLE AND uppers / alpha::DOUBLE < 0.7::DOUBLE AND alpha > 8 THEN
      CASE WHEN len(list_filter(ws, lambda w: {ident('w')})) > 0 THEN 0::DOUBLE ELSE least(0.4::DOUBLE, (0.5::DOUBLE - abs(uppers / alpha::DOUBLE - 0.5::DOUBLE)) * 0.8::DOUBLE) END
    WHEN run > 20 AND len(list_filter(ws, lambda w: {ident('w')})) = 0 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS char_class FROM V),
Q AS (SELECT line, bonus, long_word, char_class, CASE WHEN strlen(t) < 3 THEN 0.5::DOUBLE ELSE greatest(0::DOUBLE, least(1::DOUBLE, 0.5::DOUBLE + bonus - long_word - char_class)) END AS quality FROM P)"""


_RUNS = """R AS (SELECT *, sum(CASE WHEN line = prev THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, lag(line) OVER (PARTITION BY id ORDER BY i) AS prev FROM L)),
C AS (SELECT id, i, line FROM (SELECT *, count(*) OVER (PARTITION BY id, run) AS n, row_number() OVER (PARTITION BY id, run ORDER BY i) AS k FROM R) WHERE n < 5 OR k = 1)"""


def d_clean(src: str) -> str:
    """``(id, text)`` of ``src`` without runs and low-quality lines."""
    return f"""WITH {d_quality(sql.line_table(src))}, {_RUNS}, K AS (SELECT id, string_agg(C.line, chr(10) ORDER BY i) AS text FROM C JOIN Q USING (line) WHERE quality >= 0.3::DOUBLE GROUP BY id)
SELECT s.id, coalesce(K.text, '') AS text FROM {src} s LEFT JOIN K USING (id)"""


@query(f"WITH {_L} SELECT id, i::INT AS i, line, {d_hash('line')} AS raw_hash, {d_hash(d_norm('line'))} AS norm_hash FROM L")
def line_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).select("id", "i", "line", T.line_hash(F.col("line")).alias("raw_hash"), T.normalized_line_hash(F.col("line")).alias("norm_hash"))


@query(f"WITH {d_quality(_L)} SELECT id, i::INT AS i, round(bonus, 6) AS bonus, round(long_word, 6) AS long_word, round(char_class, 6) AS char_class, round(quality, 6) AS quality FROM L JOIN Q USING (line)")
def line_quality(spark: SparkSession, sf: str) -> DataFrame:
    scored = T.with_quality(_lines(spark, sf))
    return scored.select("id", "i", *(F.round(c, 6).alias(c) for c in ("bonus", "long_word", "char_class", "quality")))


@query(f"WITH {_L}, {_RUNS} SELECT id, i::INT AS i, line FROM C")
def collapse_runs(spark: SparkSession, sf: str) -> DataFrame:
    return lines.collapse_runs(_lines(spark, sf))


@query(f"WITH {d_quality(_L)}, {_RUNS} SELECT id, i::INT AS i, C.line FROM C JOIN Q USING (line) WHERE quality >= 0.3::DOUBLE")
def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return lines.clean_lines(_lines(spark, sf))


_DOCS = "(SELECT doc_id AS id, text FROM documents)"


@query(d_clean(_DOCS))
def clean_text(spark: SparkSession, sf: str) -> DataFrame:
    return _texts(spark, sf).select("id", lines.clean_text(F.col("text")).alias("text"))


@query(f"""WITH {d_quality(_L)}, G AS (SELECT id, count(*) AS n, avg(CASE WHEN quality < 0.3::DOUBLE THEN 1::DOUBLE ELSE 0::DOUBLE END) AS bad FROM L JOIN Q USING (line) GROUP BY id)
SELECT doc_id AS id, coalesce(bad > 0.5::DOUBLE, false) AS by_share, coalesce(n > 5 * (doc_id % 4) AND doc_id % 4 > 0 OR bad > 0.5::DOUBLE, false) AS by_length FROM documents LEFT JOIN G ON doc_id = id""")
def hallucinated_texts(spark: SparkSession, sf: str) -> DataFrame:
    t = _texts(spark, sf)
    share = lines.hallucinated(t).withColumnRenamed("hallucinated", "by_share")
    return share.join(lines.hallucinated(t, F.col("id") % 4).withColumnRenamed("hallucinated", "by_length"), "id")


def _repeated(spark: SparkSession, sf: str) -> DataFrame:
    """Each text three times over, an empty line between: as it is, in blocks of four lines, and in one more way by its
    number; so it has blocks and passages that repeat exactly and nearly."""
    t = F.col("text")
    group = lambda a, k: F.array_join(F.slice(a, k * 4 + 1, F.lit(4)), "\n")
    groups = lambda a: F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 4).cast("int")), lambda k: group(a, k)), "\n\n")
    four = lambda x: T.let(F.split(x, "\n", -1), groups)
    again = F.when(F.col("id") % 4 == 0, four(t)).when(F.col("id") % 4 == 1, F.concat(F.lit("# "), t)).when(F.col("id") % 4 == 2, F.concat(t, F.lit("\nplus one"))).otherwise(four(F.replace(t, F.lit(" the "), F.lit(" THE "))))
    mark = F.when(F.col("id") % 5 == 0, F.lit("---\n")).otherwise(F.lit(""))
    return _texts(spark, sf).select("id", F.concat(mark, t, F.lit("\n\n"), four(t), F.lit("\n\n"), again).alias("text"))


def _four(x: str) -> str:
    return f"(SELECT array_to_string(list_transform(range((len(a) - 1) // 4 + 1), lambda k: array_to_string(a[k * 4 + 1 : k * 4 + 4], chr(10))), chr(10) || chr(10)) FROM (SELECT string_split({x}, chr(10)) AS a))"


_REPEATED = f"""(SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN '---' || chr(10) ELSE '' END || text || chr(10) || chr(10) || {_four('text')} || chr(10) || chr(10) || CASE doc_id % 4 WHEN 0 THEN {_four('text')} WHEN 1 THEN '# ' || text
WHEN 2 THEN text || chr(10) || 'plus one' ELSE {_four("replace(text, ' the ', ' THE ')")} END AS text FROM documents)"""
_BL, _BB = sql.line_table(_REPEATED), sql.BLOCKS
_PAIRS = """H AS (SELECT id, {unit} AS u, h, count(*) AS n FROM (SELECT *, {hash} AS h FROM {table}) GROUP BY ALL), Z AS (SELECT id, u, sum(n) AS size FROM H GROUP BY ALL),
X AS (SELECT x.id, x.u AS a, y.u AS b, sum(least(x.n, y.n)) AS common FROM H x JOIN H y ON x.id = y.id AND x.h = y.h AND x.u < y.u GROUP BY ALL)
SELECT X.id, a, b, round(common / greatest(p.size, q.size)::DOUBLE, 6) AS similarity FROM X JOIN Z p ON p.id = X.id AND p.u = a JOIN Z q ON q.id = X.id AND q.u = b WHERE common / greatest(p.size, q.size)::DOUBLE > {above}::DOUBLE"""


@query(f"WITH {_BL}, {_BB} SELECT id, block, i, line FROM B")
def split_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return lines.blocks(lines.explode_lines(_repeated(spark, sf)))


@query(f"WITH {_BL}, {_BB}, " + _PAIRS.format(unit="block", hash=d_hash(d_norm("line")), table="B", above="0.85"))
def block_similarity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    found = lines.block_pairs(lines.blocks(lines.explode_lines(_repeated(spark, sf))))
    return found.withColumn("similarity", F.round("similarity", 6))


@query(f"WITH {_L.replace('doc_id AS id', 'lang AS id, doc_id').replace('SELECT doc_id, ', 'SELECT lang, doc_id, ')}, " + _PAIRS.format(unit="doc_id", hash=d_hash(d_norm("line")), table="L", above="0.75"))
def revision_similarity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    table = _lines(spark, sf).withColumnRenamed("id", "doc_id").join(docs.select("doc_id", F.col("lang").alias("id")), "doc_id")
    return lines.block_pairs(table, "doc_id", 0.75).withColumn("similarity", F.round("similarity", 6))


@query(sql.dedup_blocks(_REPEATED))
def dedup_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return folds.per_text(_repeated(spark, sf), folds.dedup_blocks)


def _sectioned(spark: SparkSession, sf: str) -> DataFrame:
    """Each text twice under headings of two levels, so that keys repeat."""
    head = lambda k: F.concat(F.lit("## v0."), (F.col("id") % 7).cast("string"), F.lit("\n### "), (F.col("id") % k).cast("string"), F.lit("\n"))
    return _texts(spark, sf).select("id", F.concat(F.lit("intro\n"), head(3), F.col("text"), F.lit("\n"), head(2), F.col("text"), F.lit("\nlast")).alias("text"))


_head = "'## v0.' || (doc_id % 7) || chr(10) || '### ' || (doc_id % {k}) || chr(10)"
_SL = sql.sections(f"(SELECT doc_id AS id, 'intro' || chr(10) || {_head.format(k=3)} || text || chr(10) || {_head.format(k=2)} || text || chr(10) || 'last' AS text FROM documents)")


@query(f"WITH {_SL} SELECT * FROM SEC")
def split_sections(spark: SparkSession, sf: str) -> DataFrame:
    return lines.sections(lines.explode_lines(_sectioned(spark, sf)))


@query(f"WITH {_SL}, {sql.DEDUP_SECTIONS} SELECT id, i, line FROM DS")
def dedup_sections(spark: SparkSession, sf: str) -> DataFrame:
    return lines.dedup_sections(lines.explode_lines(_sectioned(spark, sf)))


@query(f"""WITH {_BL}, H AS (SELECT id, i, {d_hash(d_norm('line'))} AS h FROM L), T AS (SELECT id, i, h, lead(h, 1) OVER w AS h1, lead(h, 2) OVER w AS h2 FROM H WINDOW w AS (PARTITION BY id ORDER BY i)),
F AS (SELECT *, min(i) OVER (PARTITION BY id, h, h1, h2) AS first FROM T WHERE h2 IS NOT NULL)
SELECT id, i::INT AS i, first::INT AS first FROM F WHERE first <= i - 3 AND h <> '{T.BLANK}' AND len(list_distinct(list_filter([h, h1, h2], lambda x: x <> '{T.BLANK}'))) >= 2""")
def passage_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return lines.passage_candidates(lines.explode_lines(_repeated(spark, sf)))


@query(sql.dedup_passages(_REPEATED))
def dedup_passages(spark: SparkSession, sf: str) -> DataFrame:
    return folds.per_text(_repeated(spark, sf), folds.dedup_passages)


def _captures(spark: SparkSession, sf: str) -> DataFrame:
    """Views of six lines, three further each, over every text; every eleventh view has a misread line."""
    a = T.lines(F.col("text"))
    base = _texts(spark, sf).withColumn("a", a).filter(F.size("a") > 0)
    views = base.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.size("a") - 1) / 3).cast("int")))).select("id", "k", F.slice("a", F.col("k") * 3 + 1, F.lit(6)).alias("v"))
    return views.withColumn("v", F.when((F.col("id") + F.col("k")) % 11 == 0, F.transform("v", lambda x, j: F.when(j == 1, F.concat(x, F.lit("~"))).otherwise(x))).otherwise(F.col("v")))


def _neighbours(spark: SparkSession, sf: str) -> DataFrame:
    h = _captures(spark, sf).withColumn("h", F.transform("v", T.line_hash))
    w = Window.partitionBy("id").orderBy("k")
    return h.withColumn("p", F.lag("h").over(w)).filter("p IS NOT NULL")


_CAP = f"""A AS (SELECT doc_id AS id, {d_lines('text')} AS a FROM documents), KK AS (SELECT id, a, unnest(range(((len(a) - 1) // 3)::BIGINT + 1)) AS k FROM A WHERE len(a) > 0),
CV AS (SELECT id, k, list_transform(a[k * 3 + 1 : k * 3 + 6], lambda x, j: CASE WHEN (id + k) % 11 = 0 AND j = 2 THEN x || '~' ELSE x END) AS v FROM KK),
HH AS (SELECT id, k, list_transform(v, lambda x: {d_hash('x')}) AS h FROM CV), PP AS (SELECT * FROM (SELECT *, lag(h) OVER (PARTITION BY id ORDER BY k) AS p FROM HH) WHERE p IS NOT NULL),
NN AS (SELECT id, k, h, p, n, list_slice(p, len(p) - n + 1, len(p)) AS x, h[1:n] AS y FROM (SELECT *, unnest(range(3, 7)) AS n FROM PP) WHERE n <= least(len(h), len(p))),
OO AS (SELECT id, k, max(CASE WHEN x = y THEN n END) AS exact, max(CASE WHEN len(list_filter(list_zip(x, y), lambda z: z[1] = z[2])) >= n * 0.85::DOUBLE AND len(list_filter(x, lambda z: z <> '{T.BLANK}')) >= 3 THEN n END) AS fuzzy FROM NN GROUP BY ALL)"""


@query(f"""WITH {_CAP}, WW AS (SELECT id, k, min(j) AS back FROM (SELECT *, unnest(range(len(p))) AS j FROM PP) WHERE len(h) >= 3 AND len(list_distinct(list_filter(h, lambda z: z <> '{T.BLANK}'))) >= 2 AND j + len(h) <= len(p) AND p[j + 1 : j + len(h)] = h GROUP BY ALL)
SELECT PP.id, PP.k::INT AS k, coalesce(exact, fuzzy, 0)::INT AS overlap, coalesce(back, -1)::INT AS reverse FROM PP LEFT JOIN OO USING (id, k) LEFT JOIN WW USING (id, k)""")
def overlaps(spark: SparkSession, sf: str) -> DataFrame:
    n = _neighbours(spark, sf)
    return n.select("id", "k", lines.overlap(F.col("p"), F.col("h")).cast("int").alias("overlap"), lines.reverse_overlap(F.col("p"), F.col("h")).cast("int").alias("reverse"))


@query(sql.stitch_scroll(f"(WITH {_CAP} SELECT id, k, v FROM CV)"))
def stitch_scroll(spark: SparkSession, sf: str) -> DataFrame:
    return folds.per_group(_captures(spark, sf).select("id", "k", T.join_lines(F.col("v")).alias("text")), folds.stitch_scroll, "id", "k")


_VIDEOS = "(SELECT source AS id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, text FROM documents)"


@query(f"SELECT id AS source, text FROM ({sql.stitch_revisions(_VIDEOS)})")
def stitch_revisions(spark: SparkSession, sf: str) -> DataFrame:
    return folds.per_group(_table(spark, sf, "documents"), folds.stitch_revisions, "source", "doc_id")


@query()
def revision_diffs(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").alias("group_idx"), F.lit(0).alias("seq_in_group"), F.col("turn").cast("double").alias("timestamp"), "text")
    return extract.revisions(turns)


_SNIPPETS = ["fn main() { let mut x = 1; }", "import os\nprint(os)", "interface A { b: string }", "const a = () => console.log(1)", "package main\nfunc f() { x := 1 }", "public class A { System.out }", "puts 1\nend\n", "#include <a>\nint main() {}", "nothing"]


def _snippets(spark: SparkSession, sf: str) -> DataFrame:
    snippet = F.get(F.array(*(F.lit(s) for s in _SNIPPETS)), (F.col("id") % len(_SNIPPETS)).cast("int"))
    return _texts(spark, sf).withColumn("text", F.concat("text", F.lit("\n"), snippet))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_scores = ", ".join(f"({r}, '{n}', " + " + ".join(f"contains(text, {_lit(p)})::INT" for p in ps) + ")" for r, (n, ps) in enumerate(T.LANGUAGE_PATTERNS.items()))
_files = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.FILENAMES.items())
_chosen = "[" + ", ".join(_lit(s) for s in _SNIPPETS) + f"][(doc_id % {len(_SNIPPETS)})::INT + 1]"


@query(f"""WITH D AS (SELECT doc_id AS id, text || chr(10) || {_chosen} AS text FROM documents), B AS (SELECT id, coalesce((SELECT n FROM (VALUES {_scores}) AS v(r, n, c) WHERE c > 0 ORDER BY c DESC, r LIMIT 1), 'unknown') AS language FROM D)
SELECT id, language, CASE language {_files} ELSE 'extracted.txt' END AS filename FROM B""")
def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    named = _snippets(spark, sf).select("id", T.detect_language(F.col("text")).alias("language"))
    return named.withColumn("filename", T.infer_filename(F.col("language")))


@query(f"WITH {_L} SELECT id, chunk::INT AS chunk, string_agg(line, chr(10) ORDER BY i) AS text FROM (SELECT *, ntile(4) OVER (PARTITION BY id ORDER BY i) AS chunk FROM L) GROUP BY id, chunk")
def chunk_texts(spark: SparkSession, sf: str) -> DataFrame:
    return lines.chunks(_texts(spark, sf), 4)


_fenced = "[text, '```' || chr(10) || text || chr(10) || '```', '```py' || chr(10) || text, '```'][(doc_id % 4)::INT + 1]"


def d_unfence(a: str) -> str:
    return f"array_to_string(CASE WHEN len({a}) > 1 AND {d_trim(f'{a}[len({a})]')} = '```' THEN {a}[2:len({a}) - 1] ELSE {a}[2:] END, chr(10))"


@query(f"""WITH D AS (SELECT doc_id AS id, {_fenced} AS t FROM documents), A AS (SELECT id, t, {d_lines('t')} AS a, {d_lines(d_trim('t'))} AS b, {d_trim('t')} AS s FROM D)
SELECT id, CASE WHEN prefix(t, '```') AND len(a) >= 2 THEN {d_unfence('a')} ELSE t END AS stripped, CASE WHEN prefix(s, '```') THEN {d_unfence('b')} ELSE s END AS cleaned FROM A""")
def code_fences(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(F.col("text"), F.concat(F.lit("```\n"), "text", F.lit("\n```")), F.concat(F.lit("```py\n"), "text"), F.lit("```"))
    t = F.get(kinds, (F.col("id") % 4).cast("int"))
    return _texts(spark, sf).withColumn("t", t).select("id", T.strip_fences(F.col("t")).alias("stripped"), T.clean_response(F.col("t")).alias("cleaned"))


_said = "(SELECT count(*) FROM (SELECT unnest(range(1, least(length(text), 501) + 1)) AS k) WHERE strlen(text[1:k - 1]) < 500)"


@query(f"""SELECT doc_id AS id, CASE WHEN strlen(text) > 500 THEN text[1:{_said}] ELSE text END AS said, CASE doc_id % 3 WHEN 0 THEN replace({_lit(extract.CONTINUED)}, '{{previous_tail}}', array_to_string({d_lines('text')}[greatest(1, len({d_lines('text')}) - 39):], chr(10)))
WHEN 1 THEN replace({_lit(extract.NARRATED)}, '{{narration}}', CASE WHEN strlen(text) > 500 THEN text[1:{_said}] ELSE text END) ELSE {_lit(extract.PROMPT)} END AS prompt FROM documents""")
def prompts(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda k: F.when(F.col("id") % 3 == k, F.col("text"))
    return _texts(spark, sf).select("id", T.truncate_narration(F.col("text")).alias("said"), extract.prompt(pick(0), pick(1)).alias("prompt"))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 3) END AS seconds FROM events""")
def pts_times(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.when(F.col("event_id") % 5 == 0, F.lit(" ")).otherwise(F.lit(""))
    line = F.concat(F.lit("[showinfo] n:1 pts_time:"), gap, F.format_string("%.3f", F.round("value", 3)), F.lit(" fmt:rgb24"))
    return _table(spark, sf, "events").select("event_id", T.pts_time(line).alias("seconds"))


@query("""WITH E AS (SELECT user_id AS video_id, epoch(ts) % 1000 / 10.0::DOUBLE AS timestamp, 'f' || event_id AS path, event_type = (SELECT min(event_type) FROM events) AS kf FROM events),
K AS (SELECT * FROM E WHERE kf), S AS (SELECT * FROM E WHERE NOT kf)
SELECT video_id, timestamp, path, true AS is_keyframe FROM K UNION ALL
SELECT video_id, timestamp, path, false FROM S WHERE (SELECT count(*) FROM K WHERE K.video_id = S.video_id) < 5 AND NOT EXISTS (SELECT 1 FROM K WHERE K.video_id = S.video_id AND round(K.timestamp * 10) = round(S.timestamp * 10))""")
def keyframe_backfill(spark: SparkSession, sf: str) -> DataFrame:
    events = _table(spark, sf, "events")
    kind = events.agg(F.min("event_type").alias("__first"))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    e = events.crossJoin(F.broadcast(kind)).select(F.col("user_id").alias("video_id"), (seconds % 1000 / F.lit(10.0)).alias("timestamp"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), (F.col("event_type") == F.col("__first")).alias("kf"))
    return frames.backfill(e.filter("kf").drop("kf"), e.filter("NOT kf").drop("kf"))


def _pixels(c: Column) -> Column:
    return F.transform(c, lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x.cast("double") + 1) * F.lit(127.5)))).cast("int"))


_px = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 1) * 127.5::DOUBLE)))::INT)"


@query(f"""SELECT vec_id, round(list_avg(list_transform(p, lambda x: (x < 80)::INT)), 6) AS dark, round(list_avg(list_transform(p, lambda x: (x > 200)::INT)), 6) AS light, round(list_stddev_pop(p), 6) AS std,
CASE WHEN list_avg(p) < 40 AND list_avg(list_transform(p, lambda x: (x > 180)::INT)) < 0.15::DOUBLE THEN 'terminal' ELSE 'editor' END AS region_type FROM (SELECT vec_id, {_px} AS p FROM embeddings)""")
def region_statistics(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "embeddings").select("vec_id", F.explode(_pixels(F.col("embedding"))).alias("p"))
    share = lambda c: F.avg(c.cast("int"))
    kind = F.when((F.avg("p") < 40) & (share(F.col("p") > 180) < 0.15), "terminal").otherwise("editor")
    return p.groupBy("vec_id").agg(F.round(share(F.col("p") < 80), 6).alias("dark"), F.round(share(F.col("p") > 200), 6).alias("light"), F.round(F.stddev_pop("p"), 6).alias("std"), kind.alias("region_type"))


def _density(spark: SparkSession, sf: str) -> DataFrame:
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("y", "d"))
    return e.select("frame_id", (F.col("y") * 8).alias("y0"), F.when(F.abs(F.col("d").cast("double")) > 0.05, 1.0).otherwise(0.0).alias("density"), "y")


_bands = """I AS (SELECT vec_id AS frame_id, y, y - row_number() OVER (PARTITION BY vec_id ORDER BY y) AS g FROM (SELECT vec_id, unnest(range(64)) AS y, unnest(embedding)::DOUBLE AS d FROM embeddings) WHERE abs(d) > 0.05::DOUBLE),
N AS (SELECT frame_id, min(y) * 8 AS y0, (max(y) + 1) * 8 AS y1 FROM I GROUP BY frame_id, g)"""


@query(f"""WITH {_bands}, S AS (SELECT *, CASE WHEN y1 - y0 <= 21 THEN 1 ELSE greatest(2, round((y1 - y0) / 12.0::DOUBLE)::INT) END AS n FROM N), K AS (SELECT *, (y1 - y0) // n AS step, unnest(range(n)) AS k FROM S)
SELECT frame_id, (y0 + k * step)::INT AS y0, (CASE WHEN k = n - 1 THEN y1 ELSE y0 + (k + 1) * step END)::INT AS y1 FROM K""")
def text_bands(spark: SparkSession, sf: str) -> DataFrame:
    found = frames.text_bands(_density(spark, sf).select("frame_id", "y", "density"))
    return frames.split_bands(found.select("frame_id", (F.col("y0") * 8).alias("y0"), (F.col("y1") * 8).alias("y1")), F.lit(512))


_LETTERS = list("abcdefghij")


def d_ctc(src: str) -> str:
    """``(vec_id, text)`` of steps ``src (vec_id, t, c)`` by the letters above."""
    return f"""WITH S AS (SELECT * FROM {src}),
P AS (SELECT *, lag(c, 1, 0) OVER (PARTITION BY vec_id ORDER BY t) AS prev, max(CASE WHEN c <> 0 THEN t END) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM S),
G AS (SELECT *, CASE WHEN last IS NULL THEN t ELSE t - last - 1 END AS run FROM P WHERE c <> 0),
M AS (SELECT vec_id, count(*) AS n, list_sort(list(run)) AS runs FROM G WHERE last IS NOT NULL AND run > 0 GROUP BY vec_id),
H AS (SELECT G.*, CASE WHEN coalesce(n, 0) > 2 THEN greatest(4, floor(runs[n // 2 + 1] * 2.5::DOUBLE)::INT) ELSE 8 END AS wide, c <> prev AND c <= 10 AS told FROM G LEFT JOIN M USING (vec_id)),
J AS (SELECT *, coalesce(bool_or(told) OVER (PARTITION BY vec_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS begun FROM H),
O AS (SELECT vec_id, string_agg((CASE WHEN run >= wide AND begun THEN ' ' ELSE '' END) || (CASE WHEN told THEN substr('abcdefghij', c, 1) ELSE '' END), '' ORDER BY t) AS text FROM J GROUP BY vec_id)
SELECT vec_id, coalesce(O.text, '') AS text FROM embeddings LEFT JOIN O USING (vec_id)"""


@query(d_ctc("(SELECT vec_id, unnest(range(64)) AS t, unnest(list_transform(embedding, lambda x: greatest(0, floor(x::DOUBLE * 40))::INT)) AS c FROM embeddings)"))
def ctc_decode(spark: SparkSession, sf: str) -> DataFrame:
    steps = F.transform("embedding", lambda x: F.greatest(F.lit(0), F.floor(x.cast("double") * 40)).cast("int"))
    return _table(spark, sf, "embeddings").withColumn("s", steps).select("vec_id", frames.ctc_decode(F.col("s"), F.array(*(F.lit(c) for c in _LETTERS))).alias("text"))


@query(d_ctc("(SELECT vec_id, t, list_position(e, list_max(e)) - 1 AS c FROM (SELECT vec_id, t, embedding[t * 4 + 1 : t * 4 + 4] AS e FROM embeddings, range(16) AS r(t)))"))
def recognised_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen steps of four scores each; the best class of each step, decoded."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: frames.best_class(F.slice("embedding", t * 4 + 1, F.lit(4))))
    return _table(spark, sf, "embeddings").withColumn("s", steps).select("vec_id", frames.ctc_decode(F.col("s"), F.array(*(F.lit(c) for c in _LETTERS))).alias("text"))


@query(f"""WITH {_bands.replace("> 0.05::DOUBLE", "> 0.05::DOUBLE AND vec_id % 5 <> 0")}, Z AS (SELECT vec_id AS frame_id, 64 + (vec_id % 7) * 150 AS h, floor(greatest((64 + (vec_id % 7) * 150) / 1080::DOUBLE * 25, 12::DOUBLE))::INT AS line FROM embeddings),
B AS (SELECT frame_id, h, line, floor(y0 / 8 * (h / 64::DOUBLE))::INT AS y0, floor(y1 / 8 * (h / 64::DOUBLE))::INT AS y1 FROM N JOIN Z USING (frame_id)),
S AS (SELECT *, CASE WHEN y1 - y0 <= floor(line * 1.8::DOUBLE) THEN 1 ELSE greatest(2, round((y1 - y0) / line::DOUBLE)::INT) END AS n FROM B), K AS (SELECT *, (y1 - y0) // n AS step, unnest(range(n)) AS k FROM S),
U AS (SELECT frame_id, h, line, unnest(range(h // line + 1)) AS k FROM Z WHERE frame_id NOT IN (SELECT frame_id FROM N))
SELECT frame_id, (y0 + k * step)::INT AS y0, (CASE WHEN k = n - 1 THEN y1 ELSE y0 + (k + 1) * step END)::INT AS y1 FROM K
UNION ALL SELECT frame_id, (k * line)::INT, least((k + 1) * line, h)::INT FROM U WHERE (k + 1) * line <= h OR h - k * line > line // 2""")
def text_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of frames of seven heights, of which every fifth has no band."""
    e = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.posexplode("embedding").alias("y", "d"))
    inked = (F.abs(F.col("d").cast("double")) > 0.05) & (F.col("frame_id") % 5 != 0)
    sizes = _table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(64).alias("map_h"), (64 + F.col("vec_id") % 7 * 150).alias("img_h"))
    return frames.text_lines(e.select("frame_id", "y", F.when(inked, 1.0).otherwise(0.0).alias("density")), sizes)


@query(f"""WITH A AS (SELECT doc_id AS id, {d_lines('text')} AS a FROM documents)
SELECT id, k::INT AS k, array_to_string(a[least(k * 3, greatest(len(a) - 6, 0)) + 1 : least(k * 3, greatest(len(a) - 6, 0)) + 6], chr(10)) AS text FROM (SELECT *, unnest(range(ceil(greatest(len(a) - 6, 0) / 3.0::DOUBLE)::BIGINT + 1)) AS k FROM A WHERE len(a) > 0)""")
def scroll_views(spark: SparkSession, sf: str) -> DataFrame:
    return lines.views(_texts(spark, sf)).select("id", "k", T.join_lines(F.col("v")).alias("text"))


@query(r"""SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'file_' || page_id || '.txt' ELSE regexp_replace(url, '[/\\]', '_', 'g') END AS name FROM pages""")
def safe_names(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.get(F.array(F.lit(""), F.lit("."), F.lit("..")), (F.col("page_id") % 3).cast("int"))
    name = F.when(F.col("page_id") % 10 == 0, odd).otherwise(F.col("url"))
    return _table(spark, sf, "pages").select("page_id", T.safe_name(name, F.col("page_id")).alias("name"))


def _images(spark: SparkSession, sf: str) -> DataFrame:
    """Per label a video of 48 x 48 planes, every pixel of an 8 x 8 plane six times each way; frames in pairs of equals."""
    e = _table(spark, sf, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("seq"), _pixels(F.col("embedding")).alias("p"))
    row = lambda r: F.flatten(F.transform(F.slice("p", r * 8 + 1, F.lit(8)), lambda x: F.array_repeat(x, 6)))
    wide = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.flatten(F.array_repeat(row(r), 6))))
    luma = F.unhex(F.array_join(F.transform(wide, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    base = e.select("video_id", "seq", F.lit(48).alias("w"), F.lit(48).alias("h"), luma.alias("luma"))
    return base.withColumn("twice", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("seq", F.col("seq") * 2 + F.col("twice")).drop("twice").withColumn("timestamp", F.col("seq").cast("double"))


def _hexed(p: Column) -> Column:
    return F.unhex(F.array_join(F.transform(p, lambda x: F.lpad(F.hex(x), 2, "0")), ""))


@query(sql.frame_dedup(f"(SELECT label AS video_id, vec_id * 3 + k AS seq, list_transform(list_transform(range(64), lambda j: {_px}[j + 1] + CASE WHEN k = 2 AND j = vec_id % 64 THEN 20 * (vec_id % 7) ELSE 0 END), lambda x: least(255, x)::DOUBLE) AS p FROM embeddings, range(3) AS r(k))", 8))
def frame_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Per label a video of 8 x 8 planes, compared at their own width: each plane, the same again, and with one pixel changed."""
    e = _table(spark, sf, "embeddings").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    spot = lambda x, j: F.least(F.lit(255), x + F.when((F.col("k") == 2) & (j == F.col("vec_id") % 64), 20 * (F.col("vec_id") % 7)).otherwise(0)).cast("int")
    p = F.transform(_pixels(F.col("embedding")), spot)
    table = e.select(F.col("label").alias("video_id"), (F.col("vec_id") * 3 + F.col("k")).alias("seq"), F.lit(8).alias("w"), F.lit(8).alias("h"), _hexed(p).alias("luma"))
    return frames.dedup_frames(table, width=8).select("video_id", "seq")


_SCROLLS = f"""(WITH E AS (SELECT label AS video_id, vec_id AS seq, list_transform(embedding, lambda x: greatest(0, least(255, floor(128 + x::DOUBLE * 400)))::INT) AS p, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings),
L AS (SELECT *, lag(p) OVER (PARTITION BY video_id ORDER BY k) AS q, 3 + k % 5 AS s FROM E)
SELECT video_id, seq, list_transform(range(1600), lambda j: (CASE WHEN k % 2 = 1 THEN p[(j // 200) * 8 + (j % 40) // 5 + 1] WHEN j // 40 + s < 40 THEN q[((j // 40 + s) // 5) * 8 + (j % 40) // 5 + 1] ELSE p[((j // 40 + s - 40) // 5) * 8 + (j % 40) // 5 + 1] END)::DOUBLE) AS p FROM L)"""


@query(sql.scroll_groups(_SCROLLS, 40))
def scroll_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Per label a video of 40 x 40 planes, compared at their own width; every second is the one before, scrolled by three to
    seven rows, and goes on with its own."""
    w = Window.partitionBy("label").orderBy("vec_id")
    value = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + x.cast("double") * 400))).cast("int")
    e = _table(spark, sf, "embeddings").select("label", "vec_id", F.transform("embedding", value).alias("p"), F.row_number().over(w).alias("k"))
    e = e.withColumns({"q": F.lag("p").over(w), "s": 3 + F.col("k") % 5})
    at = lambda a, y, x: F.get(a, F.floor(y / 5).cast("int") * 8 + F.floor(x / 5).cast("int"))
    y, x = (lambda j: F.floor(j / 40).cast("int")), (lambda j: j % 40)
    moved = lambda j: F.when(y(j) + F.col("s") < 40, at(F.col("q"), y(j) + F.col("s"), x(j))).otherwise(at(F.col("p"), y(j) + F.col("s") - 40, x(j)))
    p = F.transform(F.sequence(F.lit(0), F.lit(1599)), lambda j: F.when(F.col("k") % 2 == 1, at(F.col("p"), y(j), x(j))).otherwise(moved(j)))
    table = e.select(F.col("label").alias("video_id"), F.col("vec_id").alias("seq"), F.lit(40).alias("w"), F.lit(40).alias("h"), _hexed(p).alias("luma"))
    return frames.scroll_groups(table, width=40).select("video_id", "seq", "group_idx", "seq_in_group")


def _screens(spark: SparkSession, sf: str) -> DataFrame:
    """Per label a video of 240 x 240 planes, every value of an embedding a square of 30: dark screens, terminals, and such
    as are neither dark nor light, by the label."""
    e = _table(spark, sf, "embeddings")
    shade = F.col("label") % 3
    mean, wide = F.when(shade == 0, 60).when(shade == 1, 20).otherwise(130), F.when(shade == 0, 300).when(shade == 1, 40).otherwise(100)
    value = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(mean + x.cast("double") * wide))).cast("int")
    p = e.select(F.col("label").alias("video_id"), F.col("vec_id").alias("seq"), F.transform("embedding", value).alias("p"))
    cell = F.transform("p", lambda x: F.repeat(F.lpad(F.hex(x), 2, "0"), F.lit(30)))
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(F.array_join(F.slice(cell, r * 8 + 1, F.lit(8)), ""), F.lit(30)))
    return p.select("video_id", "seq", F.lit(240).alias("w"), F.lit(240).alias("h"), F.unhex(F.array_join(rows, "")).alias("luma"))


_share = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
#: P: the squares of each frame; R: the region of each video, by its first frame. A strip of 30 columns is one square wide,
#: the top bar of 20 rows lies in one.
_REGIONS = f"""P AS (SELECT label AS video_id, vec_id AS seq, unnest(range(64)) AS k, unnest(list_transform(embedding, lambda e: greatest(0, least(255, floor([60, 20, 130][label % 3 + 1] + e::DOUBLE * [300, 40, 100][label % 3 + 1])))::INT)) AS v FROM embeddings),
Q AS (SELECT video_id, k // 8 AS y, k % 8 AS x, v FROM P WHERE (video_id, seq) IN (SELECT (video_id, min(seq)) FROM P GROUP BY video_id)),
D AS (SELECT video_id, {_share('v < 80')} AS dark, {_share('v > 200')} AS light FROM Q GROUP BY video_id),
CX AS (SELECT video_id, min(x) AS x0, max(x) + 1 AS x1 FROM (SELECT video_id, x FROM Q GROUP BY ALL HAVING {_share('v < 80')} > 0.5::DOUBLE) GROUP BY video_id),
CY AS (SELECT video_id, min(y) AS y0, max(y) + 1 AS y1 FROM (SELECT video_id, y FROM Q GROUP BY ALL HAVING {_share('v < 80')} > 0.5::DOUBLE) GROUP BY video_id),
BX AS (SELECT video_id, dark, light, coalesce(x0, 0) AS x0, coalesce(x1, 8) AS x1, coalesce(y0, 0) AS y0, coalesce(y1, 8) AS y1 FROM D LEFT JOIN CX USING (video_id) LEFT JOIN CY USING (video_id)),
TX AS (SELECT *, CASE WHEN (x1 - x0) * 30 > 144 AND (SELECT stddev_pop(v) FROM Q WHERE Q.video_id = BX.video_id AND Q.x = BX.x0 AND Q.y >= BX.y0 AND Q.y < BX.y1) < 15 THEN x0 + 1 ELSE x0 END AS fx FROM BX),
TY AS (SELECT *, (y1 - y0) * 30 > 120 AND (SELECT stddev_pop(v) FROM Q WHERE Q.video_id = TX.video_id AND Q.y = TX.y0 AND Q.x >= TX.fx AND Q.x < TX.x1) < 20 AS bar FROM TX),
RB AS (SELECT video_id, dark > 0.3::DOUBLE AND dark > light AS found, fx * 30 AS x, y0 * 30 + CASE WHEN bar THEN 20 ELSE 0 END AS y, greatest((x1 - fx) * 30, 100) AS w, greatest(y1 * 30 - y0 * 30 - CASE WHEN bar THEN 20 ELSE 0 END, 100) AS h FROM TY),
IN_BOX AS (SELECT RB.video_id, sum(v * n) / sum(n)::DOUBLE AS mean, sum(CASE WHEN v > 180 THEN n ELSE 0 END) / sum(n)::DOUBLE AS bright FROM (
  SELECT Q.video_id, v, greatest(0, least(RB.x + RB.w, (Q.x + 1) * 30) - greatest(RB.x, Q.x * 30)) * greatest(0, least(RB.y + RB.h, (Q.y + 1) * 30) - greatest(RB.y, Q.y * 30)) AS n FROM Q JOIN RB USING (video_id)) c JOIN RB USING (video_id) GROUP BY RB.video_id),
R AS (SELECT video_id, (CASE WHEN found THEN least(x, 239) ELSE 0 END)::INT AS x, (CASE WHEN found THEN least(y, 239) ELSE 0 END)::INT AS y, (CASE WHEN found THEN least(w, 240 - least(x, 239)) ELSE 240 END)::INT AS w, (CASE WHEN found THEN least(h, 240 - least(y, 239)) ELSE 240 END)::INT AS h,
  CASE WHEN found AND mean < 40 AND bright < 0.15::DOUBLE THEN 'terminal' ELSE 'editor' END AS region_type FROM RB LEFT JOIN IN_BOX USING (video_id))"""


@query(f"WITH {_REGIONS} SELECT video_id, x, y, w, h, region_type FROM R")
def code_regions(spark: SparkSession, sf: str) -> DataFrame:
    return frames.code_regions(_screens(spark, sf))


@query(f"""WITH {_REGIONS}, C AS (SELECT video_id, seq, k // 8 AS r, string_agg(repeat(lpad(printf('%X', v), 2, '0'), 30), '' ORDER BY k) AS px FROM P GROUP BY ALL),
A AS (SELECT video_id, seq, list(px ORDER BY r) AS px FROM C GROUP BY ALL)
SELECT video_id, seq, w, h, md5(unhex(array_to_string(list_transform(range(R.y, R.y + R.h), lambda j: substr(px[j // 30 + 1], R.x * 2 + 1, R.w * 2)), ''))) AS md5 FROM A JOIN R USING (video_id)""")
def crop_frames(spark: SparkSession, sf: str) -> DataFrame:
    images = _screens(spark, sf)
    return frames.crop(images, frames.code_regions(images)).select("video_id", "seq", "w", "h", F.md5("luma").alias("md5"))


_K = frames.blur_matrix(8)
_weights = ", ".join(f"({i}, {j}, {float(_K[i, j])!r}::DOUBLE)" for i in range(8) for j in range(8) if _K[i, j])


@query(f"""WITH W(i, j, k) AS (VALUES {_weights}), E AS (SELECT vec_id, {_px} AS p FROM embeddings), M AS (SELECT a.vec_id, a.p, list_transform(list_zip(a.p, b.p), lambda z: (z[1] * (a.vec_id % 5) + z[2] * (4 - a.vec_id % 5)) // 4) AS q FROM E a JOIN E b ON b.vec_id = a.vec_id + 1),
X AS (SELECT vec_id, n // 8 AS y, n % 8 AS x, p[n + 1]::DOUBLE AS a, q[n + 1]::DOUBLE AS b FROM M, range(64) AS r(n)),
H AS (SELECT vec_id, y, i AS x, sum(k * a) AS a, sum(k * b) AS b, sum(k * a * a) AS aa, sum(k * b * b) AS bb, sum(k * a * b) AS ab FROM X JOIN W ON W.j = X.x GROUP BY ALL),
V AS (SELECT vec_id, i AS y, x, sum(k * a) AS a, sum(k * b) AS b, sum(k * aa) AS aa, sum(k * bb) AS bb, sum(k * ab) AS ab FROM H JOIN W ON W.j = H.y GROUP BY ALL),
S AS (SELECT vec_id, avg((2 * a * b + 6.5025::DOUBLE) * (2 * (ab - a * b) + 58.5225::DOUBLE) / ((a * a + b * b + 6.5025::DOUBLE) * (aa - a * a + bb - b * b + 58.5225::DOUBLE))) AS s FROM V GROUP BY vec_id)
SELECT vec_id, round(s * 10)::INT AS tenths, s < 0.95::DOUBLE AS differs, s > 0.85::DOUBLE AS alike FROM S""")
def frame_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Each plane of 8 x 8 against a mixture, by its number, of itself and the next one."""
    e = _table(spark, sf, "embeddings").select("vec_id", _pixels(F.col("embedding")).alias("p"))
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("q"))
    part = F.col("vec_id") % 5
    mixed = F.zip_with("p", "q", lambda a, b: F.floor((a * part + b * (4 - part)) / 4).cast("int"))
    pairs = e.join(after, "vec_id").select("vec_id", F.lit(8).alias("w"), F.lit(8).alias("h"), _hexed(F.col("p")).alias("luma"), _hexed(mixed).alias("other"))
    s = F.col("similarity")
    return frames.similarities(pairs).select("vec_id", F.round(s * 10).cast("int").alias("tenths"), (s < 0.95).alias("differs"), (s > 0.85).alias("alike"))


_json = r"""{
  "files" : [ {
    "filename" : "<filename>",
    "language" : "<language>",
    "final_content" : <content>,
    "revisions" : [ ]
  } ],
  "terminal_commands" : [ ],
  "annotations" : [ ],
  "duration" : 0.0,
  "source_video" : "<id>"
}"""


def _filled(template: str, **values: str) -> str:
    """SQL for the template with values in place of their names."""
    out = _lit(template)
    for name, value in values.items():
        out = out.replace(f"<{name}>", f"' || {value} || '")
    return out


@query(f"WITH T AS ({SQL['detect_language']}) SELECT T.id, {_filled(_json, filename='filename', language='language', content=f'to_json(text || chr(10) || {_chosen})::VARCHAR', id='T.id')} AS json FROM T JOIN documents ON doc_id = T.id")
def output_json(spark: SparkSession, sf: str) -> DataFrame:
    named = _snippets(spark, sf).withColumn("language", T.detect_language(F.col("text")))
    none = F.array().cast("array<struct<timestamp:double,content:string,narration:string,frame_index:bigint,diff:string>>")
    file = F.struct(T.infer_filename(F.col("language")).alias("filename"), "language", F.col("text").alias("final_content"), none.alias("revisions"))
    return named.select("id", sinks.as_json(sinks.record(F.array(file), F.lit(0.0), F.col("id").cast("string"))).alias("json"))


@query(f"""WITH S0 AS ({sql.stitch_revisions(_VIDEOS)}), S1 AS ({d_clean('S0')}), S2 AS ({sql.dedup_blocks('S1')}), S3 AS ({sql.section_texts('S2')}), S4 AS ({sql.dedup_passages('S3')}) SELECT id, text FROM S4""")
def text_chain(spark: SparkSession, sf: str) -> DataFrame:
    return chain.text_chain(_table(spark, sf, "documents"), "source", "doc_id", "text")


@query()
def scrape_videos(spark: SparkSession, sf: str) -> DataFrame:
    """The whole way with a backend that writes the beginnings of an image's rows as text, for want of a model."""
    extract.BACKENDS["rows"] = lambda: lambda image, prompt: "\n".join(row[:12, 0].tobytes().hex() for row in frames.read_png(image))
    return chain.scrape(_images(spark, sf), chain.Settings(backend="rows", work_dir=chain.work_folder(spark))).select("video_id", "json")
