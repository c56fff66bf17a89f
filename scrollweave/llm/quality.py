"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to a in is it that was for on are with as be this by from at or an "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur avec "
    "el los y del se las por con no su para una al lo como"
).split()

#: name: (ratio over the measures below, least, most); None is no bound. A null ratio passes.
THRESHOLDS: Mapping[str, tuple[str, float | None, float | None]] = {
    "word_length": ("word_chars / n_words", 2.0, 15.0),
    "symbols_a_word": ("n_symbols / n_words", None, 0.25),
    "stop_word_share": ("n_stop_words / n_words", 0.02, None),
    "dup_line_share": ("n_dup_lines / n_lines", None, 0.5),
    "bullet_line_share": ("n_bullet_lines / n_lines", None, 0.9),
    "ellipsis_line_share": ("n_ellipsis_lines / n_lines", None, 0.5),
}

_SPACE = r"[\\x20\\x09-\\x0D]"
_WORD = r"[^\\x20\\x09-\\x0D]"


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_bullet_lines, n_ellipsis_lines,
    n_stop_words, n_repeat_words`` (long) of each whole text.

    Words are runs without ASCII white space. ``n_repeat_words`` counts the word positions inside windows of three
    words that occur twice or more in the text, all occurrences included: where two windows have the same hash, the
    hashes, each with its position in the low bits, are sorted; equal neighbours are repeats. So much of a hash stays that two different windows of a
    text of n words fall together with probability n**2 / 2**63 at most.
    Null counts as empty; all counts of an empty text are 0.
    """
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    step = docs.select(*(F.col(c) for c in keep), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    step = step.selectExpr(
        *keep, "__t",
        f"array_remove(split(__t, '{_SPACE}+'), '') AS __w",
        f"filter(split(__t, '\\n'), l -> l RLIKE '{_WORD}') AS __l",
    )
    step = step.selectExpr(
        *keep, "__w", "size(__w) AS __n", "CAST(greatest(1, ceil(log2(size(__w) + 1))) AS INT) AS __b",
        "CAST(char_length(array_join(__w, '')) AS BIGINT) AS word_chars",
        "CAST(regexp_count(__t, '[#*$%&|<>]') AS BIGINT) AS n_symbols",
        "CAST(size(__l) AS BIGINT) AS n_lines", "CAST(size(__l) - size(array_distinct(__l)) AS BIGINT) AS n_dup_lines",
        f"CAST(size(filter(__l, l -> l RLIKE '^{_SPACE}*([-*•‣●])')) AS BIGINT) AS n_bullet_lines",
        "CAST(size(filter(__l, l -> endswith(l, '...') OR endswith(l, '…'))) AS BIGINT) AS n_ellipsis_lines",
        f"CAST(size(filter(__w, w -> lower(w) IN ({stops}))) AS BIGINT) AS n_stop_words",
    )
    counts = ("word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines", "n_stop_words")
    step = step.selectExpr(
        *keep, *counts, "__n", "__b",
        "CASE WHEN __n >= 3 THEN transform(sequence(0, __n - 3), i -> xxhash64(__w[i], __w[i + 1], __w[i + 2])) ELSE CAST(array() AS ARRAY<BIGINT>) END AS __h",
    )
    # Most texts repeat no window; only the others are sorted.
    step = step.selectExpr(
        *keep, *counts, "__n", "__b",
        "CASE WHEN size(array_distinct(__h)) < size(__h) THEN transform(__h, (x, i) -> shiftleft(x, __b) | CAST(i AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END AS __h",
    )
    step = step.selectExpr(*keep, *counts, "__n", "__b", "sort_array(__h) AS __s")
    step = step.selectExpr(
        *keep, *counts, "__n",
        "sort_array(transform(filter(__s, (x, k) -> coalesce(shiftright(x, __b) = shiftright(get(__s, k - 1), __b), false) OR coalesce(shiftright(x, __b) = shiftright(get(__s, k + 1), __b), false)), x -> x & (shiftleft(1L, __b) - 1))) AS __p",
    )
    covered = "aggregate(zip_with(__p, slice(__p, 2, greatest(size(__p), 1)), (a, b) -> least(3L, coalesce(b - a, 3L))), 0L, (x, y) -> x + y)"
    step = step.selectExpr(*keep, "CAST(__n AS BIGINT) AS n_words", *counts, f"{covered} AS n_repeat_words")
    # A generator keeps later filters above it: pushed below, they would put whole arrays inside the lambda functions.
    names = ("n_words", *counts, "n_repeat_words")
    return step.select(*keep, F.inline(F.array(F.struct(*names))))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def passes(thresholds: Mapping[str, tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """The threshold table as one boolean column over the measures."""
    verdict = F.lit(True)
    for ratio, least, most in thresholds.values():
        value = F.expr(f"try_divide(CAST({ratio.split('/')[0]} AS DOUBLE), CAST({ratio.split('/')[1]} AS DOUBLE))")
        for bound, holds in ((least, value >= F.lit(least)), (most, value <= F.lit(most))):
            if bound is not None:
                verdict = verdict & F.coalesce(holds, F.lit(True))
    return verdict


def quality(docs: DataFrame, thresholds: Mapping[str, tuple[str, float | None, float | None]] = THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept`` for every row.

    ``kept`` is false where the base rule fails (under 50 words, or over half of them in repeated windows), else says
    whether all thresholds hold. Null and empty texts fail; null ids and repeated rows are rows like others; columns of
    any other name don't matter.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    failed = base_failed()
    out = measures(rows, "__text")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & passes(thresholds)).alias("kept"))


def keep_good(docs: DataFrame, thresholds: Mapping[str, tuple[str, float | None, float | None]] = THRESHOLDS, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, that the rules keep. One scan, no shuffle.

    Null and empty texts go; null ids and repeated rows are rows like others; an empty table stays empty."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")
    judged = measures(docs.select(row, F.col(text_col).alias("__text")), "__text", keep=("__row",))
    return judged.filter(~base_failed() & passes(thresholds)).select("__row.*")
