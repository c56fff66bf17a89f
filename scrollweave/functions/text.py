"""Line-level functions as Spark columns. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unicode white space as a Java class, and the characters that a normalised line loses at its start.
WS = r"[\t-\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
MARKERS = rf"[#*\->@+{WS}]"
#: Words that hint at code, each with a space behind.
CODE_TOKENS = ("import", "from", "def", "fn", "let", "const", "pub", "use", "struct", "enum", "impl", "trait", "class", "return", "if", "else", "for", "while", "match", "async", "await")
MARKS = "={}()[];:,."

#: Substrings that speak for a language, in the order that breaks ties.
LANGUAGE_PATTERNS = {
    "rust": ["fn ", "let mut ", "impl ", "pub fn", "use std::", "-> "],
    "python": ["import ", "class ", "self.", "print(", "elif ", "except ", "async def "],
    "typescript": ["interface ", ": string", ": number", "export ", "import {"],
    "javascript": ["const ", "let ", "function ", "=>", "console.log", "require("],
    "go": ["func ", "package ", "import (", "fmt.", ":= ", "go func"],
    "java": ["public class", "public static", "System.out", "import java"],
    "ruby": ["end\n", "puts ", "require '", "attr_"],
    "c": ["#include", "int main", "printf(", "malloc(", "void "],
}
#: Output names by language.
FILENAMES = {
    "python": "extracted.py", "javascript": "extracted.js", "typescript": "extracted.ts", "rust": "extracted.rs",
    "go": "extracted.go", "java": "Extracted.java", "c": "extracted.c", "ruby": "extracted.rb",
}


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^{WS}+|{WS}+$", "")


def lines(text: Column) -> Column:
    """Lines without their ends: ``\\r\\n`` ends a line too, a final end begins no line, an empty text has none."""
    return let(
        F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1),
        lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a),
    )


def join_lines(a: Column) -> Column:
    return F.array_join(a, "\n")


def line_hash(x: Column) -> Column:
    return F.substring(F.md5(x.cast("binary")), 1, 12)


def normalize_line(x: Column) -> Column:
    """Leading markers and white space off, ``**`` out, trimmed, lower-cased."""
    return F.lower(trim(F.replace(F.regexp_replace(x, f"^{MARKERS}+", ""), F.lit("**"), F.lit(""))))


def normalized_line_hash(x: Column) -> Column:
    return line_hash(normalize_line(x))


#: Hash of a line that normalises to nothing, and of an empty one.
BLANK = "d41d8cd98f00"


def is_table_row(x: Column) -> Column:
    return x.startswith("|") & x.endswith("|") & (F.regexp_count(x, F.lit(r"\|")) >= 3)


def is_identifier(word: Column) -> Column:
    return word.rlike(r"[_.]|::|\p{IsLowercase}\p{IsUppercase}")


def _words(x: Column) -> Column:
    return F.filter(F.split(x, f"{WS}+"), lambda w: w != "")


def pattern_bonus(x: Column) -> Column:
    """How much a trimmed line looks like code or markup, 0 to 0.5."""
    token = F.lit(False)
    for word in CODE_TOKENS:
        token = token | x.contains(word + " ")
    some = lambda cond, value: F.when(cond, F.lit(value)).otherwise(F.lit(0.0))
    marks = F.char_length(x) - F.char_length(F.translate(x, MARKS, ""))
    listed = x.startswith("- ") | x.startswith("* ") | x.startswith("> ") | x.startswith("//")
    total = some(x.startswith("#") | x.startswith("```"), 0.4) + some(listed, 0.3) + some(token, 0.3) + F.least(marks * F.lit(0.05), F.lit(0.2))
    return F.when(is_table_row(x), F.lit(0.5)).otherwise(F.least(total, F.lit(0.5)))


def long_word_penalty(x: Column) -> Column:
    """Share of words over 15 bytes that are no identifiers, times 0.6, at most 0.5."""
    bare = lambda w: F.regexp_replace(w, r"[^\p{IsAlphabetic}\p{N}_.:]", "")
    long = lambda w: (F.octet_length(w) > 15) & (F.octet_length(bare(w)) > 15) & ~is_identifier(bare(w))
    return let(_words(x), lambda a: F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.size(F.filter(a, long)) / F.size(a) * F.lit(0.6), F.lit(0.5))))


def char_class_penalty(x: Column) -> Column:
    """For mixed case, or for very long runs of letters, unless a word is an identifier."""
    named = F.exists(_words(x), is_identifier)
    free = F.lit(0.0)

    def judged(letters: Column) -> Column:
        total = F.octet_length(letters)
        ratio = F.regexp_count(letters, F.lit(r"\p{IsUppercase}")) / total
        dense = lambda r: F.least((F.lit(0.5) - F.abs(r - F.lit(0.5))) * F.lit(0.8), F.lit(0.4))
        run = F.when(x.rlike(r"\p{IsAlphabetic}{21}") & ~named, F.lit(0.3)).otherwise(free)
        mixed = lambda r: (r > 0.3) & (r < 0.7) & (total > 8)
        scored = lambda r: F.when(mixed(r), F.when(named, free).otherwise(dense(r))).otherwise(run)
        return F.when(total < 5, free).otherwise(let(ratio, scored))

    return let(F.regexp_replace(x, r"\P{IsAlphabetic}+", ""), judged)


def score(x: Column, bonus: Column, long_word: Column, char_class: Column) -> Column:
    """The quality of a trimmed line by its three parts: 0 to 1; lines under three bytes are neutral (0.5)."""
    total = F.lit(0.5) + bonus - long_word - char_class
    return F.when(F.octet_length(x) < 3, F.lit(0.5)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def line_quality(x: Column) -> Column:
    """The quality of a line, for array functions; see ``with_quality`` for tables."""
    return let(trim(x), lambda t: score(t, pattern_bonus(t), long_word_penalty(t), char_class_penalty(t)))


def with_quality(table: DataFrame, line: str = "line") -> DataFrame:
    """``table`` with ``bonus, long_word, char_class, quality`` of ``line``, each computed once a row."""
    t = F.col("__t")
    parts = {"bonus": pattern_bonus(t), "long_word": long_word_penalty(t), "char_class": char_class_penalty(t)}
    staged = table.withColumn("__t", trim(F.col(line))).withColumns(parts)
    return staged.withColumn("quality", score(t, *(F.col(c) for c in parts))).drop("__t")


def is_heading(x: Column) -> Column:
    t = trim(x)
    return t.rlike(r"^(#|@@)") | t.rlike(rf"^[*\->{WS}]*v[0-9]")


def heading_level(x: Column) -> Column:
    return F.greatest(F.char_length(F.regexp_extract(trim(x), "^#+", 0)), F.lit(1))


def detect_language(text: Column) -> Column:
    """The language with most patterns present; the earlier one on a tie; ``unknown`` without any."""
    best = F.struct(F.lit(0).alias("n"), F.lit(0).alias("rank"), F.lit("unknown").alias("name"))
    scored = [best]
    for rank, (name, patterns) in enumerate(LANGUAGE_PATTERNS.items()):
        n = F.lit(0)
        for p in patterns:
            n = n + text.contains(p).cast("int")
        scored.append(F.struct(n.alias("n"), F.when(n > 0, F.lit(-rank)).otherwise(F.lit(-99)).alias("rank"), F.lit(name).alias("name")))
    return F.greatest(*scored)["name"]


def infer_filename(language: Column) -> Column:
    named = F.lit("extracted.txt")
    for name, file in FILENAMES.items():
        named = F.when(language == name, F.lit(file)).otherwise(named)
    return named


def _unfenced(a: Column) -> Column:
    body = F.slice(a, F.lit(2), F.size(a))
    closed = F.coalesce(trim(F.try_element_at(body, F.lit(-1))) == "```", F.lit(False))
    return join_lines(F.when(closed, F.slice(body, F.lit(1), F.size(body) - 1)).otherwise(body))


def strip_fences(text: Column) -> Column:
    """Without the code fence around it; a text of one line stays."""
    return let(lines(text), lambda a: F.when(text.startswith("```") & (F.size(a) >= 2), _unfenced(a)).otherwise(text))


def clean_response(text: Column) -> Column:
    """Trimmed, without a code fence; a lone fence becomes empty."""
    return let(trim(text), lambda t: F.when(t.startswith("```"), _unfenced(lines(t))).otherwise(t))


def pts_time(line: Column) -> Column:
    """The number right behind ``pts_time:``; null if there is none."""
    return F.regexp_extract(line, r"pts_time:([0-9.\-]*)", 1).try_cast("double")


def safe_name(name: Column, position: Column) -> Column:
    flat = F.regexp_replace(name, r"[/\\]", "_")
    return F.when(flat.isin("", ".", ".."), F.concat(F.lit("file_"), position.cast("string"), F.lit(".txt"))).otherwise(flat)


def truncate_narration(text: Column, most: int = 500) -> Column:
    """If over ``most`` UTF-8 bytes, the characters that begin before byte ``most``."""
    chars = lambda: F.split(text, "")
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    count = F.aggregate(chars(), start, lambda acc, c: F.struct((acc["at"] + F.octet_length(c)).alias("at"), (acc["n"] + (acc["at"] < most).cast("int")).alias("n")))["n"]
    return F.when(F.octet_length(text) > most, F.substring(text, F.lit(1), count)).otherwise(text)
