"""The registered queries of this subpackage and their SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrollweave.llm.chat import CONTROL, parts, prefix_tree, read_back
from scrollweave.llm.decontaminate import leaks
from scrollweave.llm.minhash import near_duplicates
from scrollweave.llm.packing import pack
from scrollweave.llm.quality import STOP_WORDS, quality
from scrollweave.llm.secrets import secret_scan
from scrollweave.llm.sharding import shards
from scrollweave.llm.tokens import token_digest
from scrollweave.llm.toxicity import score, train
from scrollweave.llm.urlfilter import RULES, judge


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, threshold=(80, 100))


def op2_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_SAID).alias("text"))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    stream, index = prefix_tree(chats.unionByName(extra), path)
    return read_back(stream, index, path).drop("n_tokens")


def op3_url_link_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"))


def op4_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op5_toxicity_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score(docs, train(docs, _table(spark, sf_dir, "labels")))


def op6_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"), n_shards=40)


def op7_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_length_bucket_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer=tokenizer_path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(_table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_chat_prefix_tree, op3_url_link_propagation, op4_orc_token_ids, op5_toxicity_ordinal,
        op6_rendezvous_sharding, op7_simhash_decontamination, op8_length_bucket_packing, op9_quality_rules, op10_secret_ownership,
    )
}

_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

_A_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _rule(k: int) -> str:
    """Conditions and values of the k-th field of RULES, the longest first."""
    longest = sorted(RULES, key=lambda r: (-len(r.name), r.name))
    return " ".join(f"WHEN (host = '{r.host}' OR suffix(host, '.{r.host}')) AND prefix(path, '{r.path}') THEN '{(r.name, r.verdict)[k]}'" for r in longest)


def _escaped(x: str) -> str:
    """The length of an escaped text: a character more for each backslash and each control string."""
    more = [f"(length({x}) - length(replace({x}, '{c}', ''))) / {len(c)}" for c in ("\\", *CONTROL)]
    return f"(length({x}) + " + " + ".join(more) + ")"


_SAID = "</s>[INST] ok [/INST]"

#: The other queries have no SQL: a sampled fit (5), hashes or tokenizers that DuckDB lacks (4, 6, 8), a greedy best window
#: (7), and patterns with possessive parts (10). Tests hold them against brute force or other implementations.
SQL: dict[str, str] = {
    "op1_minhash_near_dedup": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_A_Z}), '[^\x20\x09-\x0D]+') AS w FROM documents
), n AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS s FROM n
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least AS component_id, doc_id = least AS kept FROM n JOIN c ON a = doc_id
""",
    "op2_chat_prefix_tree": f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum({len(parts('', '')[0] + parts('', '')[2])} + {_escaped('role')} + {_escaped('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
""",
    "op3_url_link_propagation": rf"""
WITH RECURSIVE p AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), {_A_Z}), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(html, '') AS html FROM pages
), f AS (
  SELECT *, CASE {_rule(0)} END AS rule, CASE {_rule(1)} END AS fit FROM p
), s AS (
  SELECT walk, host, avg(CASE WHEN fit = verdict THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS mass
  FROM f, (VALUES ('trust', 'allow'), ('distrust', 'block')) AS v(walk, verdict) WHERE host <> '' GROUP BY walk, host
), h AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)) AS dst FROM p
), l AS (
  SELECT src, translate(dst, {_A_Z}) AS dst, count(*) AS n FROM h WHERE src <> '' AND dst <> '' AND src <> translate(dst, {_A_Z}) GROUP BY ALL
), d AS (
  SELECT 'trust' AS walk, src AS host, dst AS next, n FROM l UNION ALL SELECT 'distrust', dst, src, n FROM l
), t AS (
  SELECT walk, host, next, n / sum(n) OVER (PARTITION BY walk, host) AS share FROM d
), r AS (
  SELECT 0 AS k, walk, host, mass FROM s WHERE mass > 0
  UNION ALL SELECT k + 1, r.walk, next, sum(mass * share * 0.85::DOUBLE) FROM r JOIN t ON t.walk = r.walk AND t.host = r.host WHERE k < 200 GROUP BY k, r.walk, next
), g AS (
  SELECT host, coalesce(sum(mass) FILTER (walk = 'trust'), 0) AS trust, coalesce(sum(mass) FILTER (walk = 'distrust'), 0) AS distrust FROM r GROUP BY host
)
SELECT page_id, f.host, path, rule, coalesce(fit, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0)::DOUBLE AS trust, coalesce(distrust, 0)::DOUBLE AS distrust
FROM f LEFT JOIN g ON g.host = f.host
""",
    "op9_quality_rules": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM d
), x AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)
), f AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM x) WHERE n > 1
), p AS (
  SELECT r, count(DISTINCT i + k) AS n FROM f, (VALUES (0), (1), (2)) AS o(k) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words,
    len(l) AS n_lines, len(list_filter(l, lambda s: regexp_matches(s, '^[\x20\x09-\x0D]*[-*•‣●]'))) AS n_bullets,
    len(list_filter(l, lambda s: suffix(s, '...') OR suffix(s, '…'))) AS n_ellipsis,
    len(list_filter(w, lambda s: lower(s) IN ({_STOPS}))) AS n_stops
  FROM w LEFT JOIN p USING (r)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words::DOUBLE BETWEEN 2.0::DOUBLE AND 15.0::DOUBLE AND n_symbols / n_words::DOUBLE <= 0.25::DOUBLE
    AND n_stops / n_words::DOUBLE >= 0.02::DOUBLE AND n_dup_lines / n_lines::DOUBLE <= 0.5::DOUBLE
    AND n_bullets / n_lines::DOUBLE <= 0.9::DOUBLE AND n_ellipsis / n_lines::DOUBLE <= 0.5::DOUBLE AS kept
FROM j
""",
}
