"""Secret scans by corpus-wide ownership frequency, in DataFrame functions alone.

Candidates are found by patterns. Their hashes are counted by distinct repositories and owners over the whole corpus:
a value that several owners have is a widely copied example, one that a single owner has and that looks random is
taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrollweave.llm._scratch import park

#: A private key from BEGIN to END, or where END is missing as far as its lines of base64 go; group 1 is its body.
#: Groups repeat possessively, which Java does without recursion, so long bodies are safe.
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----((?:[^-]|-(?!----))*+(?=-----END [A-Z ]{0,40}PRIVATE KEY-----)"
    r"|(?:\s*+[A-Z][A-Za-z-]*+:\x20[^\n]*+)*+(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{16,}+)++(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{1,15}+(?=\s*\z))?+)"
    r"(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?"
)

#: kind: (pattern, least length, group whose length counts and whose text is the value). Base kinds come first.
KINDS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    "access": (r"AKIA[A-Z0-9]+", 16, 0),
    "hex": (r"[0-9a-f]{32,}", 32, 0),
    "provider": (r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[srp]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{30,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})", 12, 0),
    "url": (r"://[^\s:/@]{1,64}:([^\s:/@]{4,128})@", 4, 1),
    "pem": (_PEM, 20, 1),
}
BASE = ("assign", "access", "hex")

#: Values that documentation and tests use.
PLACEHOLDER = r"(?i)(example|sample|dummy|placeholder|changeme|change_me|your|xxxx|test|1234567|abcdef|redacted)"


#: A match: its kind, its number in the text, the text since the one before and its own, in code points and in bytes,
#: whether it is long enough, the hash of its value and whether that looks random.
_MATCHES = "array<struct<ord:int,k:int,gap:int,hit:int,bgap:int,bhit:int,ok:boolean,h:bigint,random:boolean>>"


def _matches(text: Column, kind: str) -> Column:
    """``_MATCHES`` of one kind: leftmost matches that do not overlap. ``split`` gives the text between the matches and
    ``regexp_extract_all`` the matches, so the sums of their lengths are the places."""
    pattern, least, group = KINDS[kind]
    hits, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if kind == "pem":  # one key, however its lines are broken
        values = F.transform(values, lambda v: F.regexp_replace(v, r"\\[nr]|[^A-Za-z0-9+/=]", ""))
    both = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), values.alias("value"))
    one = lambda x, k: F.struct(
        F.lit(list(KINDS).index(kind)).alias("ord"), k.alias("k"), F.char_length(x["gap"]).alias("gap"), F.char_length(x["hit"]).alias("hit"), F.octet_length(x["gap"]).alias("bgap"),
        F.octet_length(x["hit"]).alias("bhit"), (F.char_length(x["value"]) >= least).alias("ok"), F.xxhash64(x["value"]).alias("h"), _random(x["value"]).alias("random"),
    )
    return F.when(text.rlike(pattern), F.transform(both, one)).otherwise(F.array().cast(_MATCHES))


def _random(value: Column) -> Column:
    """Looks issued by a machine: 12 characters or more, letters and digits, no placeholder."""
    return (F.char_length(value) >= 12) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)


def candidates(text: Column) -> Column:
    """``_MATCHES`` of all kinds."""
    return F.concat(*(_matches(text, kind) for kind in KINDS))


def places(rows: DataFrame) -> DataFrame:
    """``(row, repo, owner, start, ord, end, b_start, b_end, base, h, random)``: each candidate span of ``rows (row, repo,
    owner, matches)``, in code points and in bytes. Places are running sums over the matches of one kind in one text, so
    a text takes time in proportion to its matches."""
    w = Window.partitionBy("row", "ord").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    each = rows.select("row", "repo", "owner", F.inline("matches"))
    each = each.withColumns({"end": F.sum(F.col("gap") + F.col("hit")).over(w), "b_end": F.sum(F.col("bgap") + F.col("bhit")).over(w)}).filter("ok")
    base = F.col("ord") < len(BASE)
    return each.select("row", "repo", "owner", (F.col("end") - F.col("hit")).alias("start"), "ord", "end", (F.col("b_end") - F.col("bhit")).alias("b_start"), "b_end", base.alias("base"), "h", "random")


def _name(order: Column) -> Column:
    return F.get(F.array(*(F.lit(k) for k in KINDS)), order)


def _spelled(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", _name(x["ord"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(spread: DataFrame, widely: int = 3) -> DataFrame:
    """``(h, n_repos, n_owners, copied)`` of each candidate hash over rows ``(h, repo, owner)``; null repositories and
    owners count as none. Distinct triples are made on the map side first, so a value in a third of all rows is cheap."""
    counts = spread.groupBy("h").agg(F.count_distinct("repo").alias("n_repos"), F.count_distinct("owner").alias("n_owners"))
    return counts.withColumn("copied", F.col("n_owners") >= widely)


def _row(docs: DataFrame, text_col: str, repo_cols: tuple[str, ...], owner_col: str) -> list[Column]:
    """``row, text, repo, owner`` of ``docs``."""
    repo = F.when(F.concat(*(F.col(c).cast("string") for c in repo_cols)).isNotNull(), F.xxhash64(*repo_cols))
    owner = F.when(F.col(owner_col).isNotNull(), F.xxhash64(owner_col))
    return [F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), repo.alias("repo"), owner.alias("owner")]


def _judged(rows: DataFrame, widely: int) -> DataFrame:
    """The ``places`` of rows, each with ``copied``."""
    spans = park(places(rows.filter(F.size("matches") > 0)), "places")
    counts = park(ownership(spans.select("h", "repo", "owner"), widely), "ownership")
    return spans.join(counts.select("h", "copied"), "h")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", widely: int = 3) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied, live_spans`` for every row.

    ``spans`` has the base spans and those that the method adds (kinds provider, url, pem, unless widely copied), as
    ``kind:start:end`` in code points. A span is live if fewer than ``widely`` owners have its value and it looks
    random (or is a private key, whose value is its body); ``n_copied`` counts the spans whose value ``widely`` owners
    or more have.

    Null and empty texts have no span, and the hash of the empty string. Null ids and repeated rows are rows like
    others; null repositories or owners don't count; columns of other names don't matter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_row(docs, text_col, repo_cols, owner_col))
    rows = park(rows.select("doc_id", "row", "repo", "owner", candidates(F.col("text")).alias("matches")), "matches")
    spans = _judged(rows, widely).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "ord", "end", "base", "random", "copied"))).alias("found"))
    judged = rows.select("doc_id", "row").join(spans, "row", "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:bigint,ord:int,end:bigint,base:boolean,random:boolean,copied:boolean>>"))
    judged = judged.select("doc_id", found.alias("found"))
    base, live = F.filter("found", lambda x: x["base"]), F.filter("found", lambda x: _live(x["copied"], x["random"], x["ord"]))
    count = lambda kind: F.size(F.filter("found", lambda x: x["ord"] == list(KINDS).index(kind))).cast("long")
    return judged.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_spelled(base).cast("binary"), 256).alias("base_sha256"), _spelled(F.filter("found", lambda x: x["base"] | ~x["copied"])).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.size(F.filter("found", lambda x: x["copied"])).cast("long").alias("n_copied"), _spelled(live).alias("live_spans"),
    )


def _live(copied: Column, random: Column, order: Column) -> Column:
    return ~copied & (random | (order == list(KINDS).index("pem")))


def redact(docs: DataFrame, mask: str = "[REDACTED]", id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", widely: int = 3) -> DataFrame:
    """``docs`` with every live span of its texts replaced by ``mask``; no row goes and other columns stay, whatever their
    names.

    Texts are scanned once; only rows with a live span pass through a join. Spans that overlap get one mask. Null texts
    stay null, empty ones empty; null ids and repeated rows are rows like others, null repositories or owners don't count.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(whole, *_row(docs, text_col, repo_cols, owner_col))
    rows = park(rows.select("doc", "row", "repo", "owner", candidates(F.col("text")).alias("matches")), "matches")
    live = _judged(rows.select("row", "repo", "owner", "matches"), widely).filter(_live(F.col("copied"), F.col("random"), F.col("ord")))
    # What stays of a text is what lies between the spans so far and each next one.
    before = Window.partitionBy("row").orderBy("b_start", "b_end").rowsBetween(Window.unboundedPreceding, -1)
    live = live.withColumn("reach", F.coalesce(F.max("b_end").over(before), F.lit(0).cast("long")))
    piece = F.when(F.col("b_start") >= F.col("reach"), F.struct("b_start", "reach"))
    live = park(live.groupBy("row").agg(F.sort_array(F.collect_list(piece)).alias("pieces"), F.max("b_end").alias("last")), "live")
    held = rows.filter(F.size("matches") > 0).select("doc", "row").join(live, "row", "left")

    def masked(data: Column) -> Column:
        kept = F.transform("pieces", lambda p: F.substring(data, (p["reach"] + 1).cast("int"), (p["b_start"] - p["reach"]).cast("int")).cast("string"))
        return F.concat(F.array_join(kept, mask), F.lit(mask), F.substring(data, (F.col("last") + 1).cast("int"), F.octet_length(data)).cast("string"))

    text = F.col("doc").getField(text_col)
    new = F.when(F.col("pieces").isNull(), text).otherwise(F.get(F.transform(F.array(text.cast("binary")), masked), F.lit(0)))
    shown = lambda table, value: table.select(*((value if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns))
    return shown(rows.filter(F.size("matches") == 0), text).unionByName(shown(held, new))
