"""URL filters by link-graph propagation: longest rules decide the pages that they fit, and from these hosts trust and
distrust spread over the links between hosts to judge the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrollweave.llm._scratch import discard, park


@dataclass(frozen=True)
class Rule:
    """A verdict for the urls of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values of the query's contract.
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)

_A_Z, _a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), _A_Z, _a_z), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """``struct<rule, verdict>`` of the longest rule (by its name, host and path together) that fits; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(src, dst, n)``: links between different hosts, by the absolute ``href`` values of the pages. Null urls, null html
    and html without such a value give none; repeated rows count as often as they are there."""
    pattern = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^/?#"'\s>]+)"""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    found = F.when(html.rlike(pattern), F.regexp_extract_all(html, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(found).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.filter("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """``(walk, host, score)`` from ``seeds (walk, host, mass)`` over ``links (src, dst, n)``.

    Walk ``trust`` follows the links, walk ``distrust`` follows them backwards: who links to a bad host is suspect.
    Both are personalised PageRank, ``score = seed + damping * incoming``, each host sharing its score over its links by
    their number; without the usual factor ``1 - damping`` an isolated host keeps its seed mass. What a host without links
    on receives goes no further: it is not dealt out again, neither to the seeds nor to all. A round is one join
    and one aggregation of both walks, written to the shared folder; it ends when scores move by less than
    ``tolerance`` a seed in total. A round moves at most ``damping`` of what the one before it moved, so the rounds
    that this takes follow from both (86 here at most). Only that total reaches the driver.
    """
    steps = links.select(F.lit("trust").alias("walk"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    steps = steps.unionByName(links.select(F.lit("distrust").alias("walk"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = steps.groupBy("walk", "host").agg(F.sum("n").alias("all"))
    steps = park(steps.join(out, ["walk", "host"]).select("walk", "host", "to", (F.col("n") / F.col("all")).alias("share")), "steps")
    seeds = seeds.filter("host IS NOT NULL").groupBy("walk", "host").agg(F.sum("mass").alias("mass"))
    score = seeds.withColumnRenamed("mass", "score")
    if steps.isEmpty():
        return score
    seeds = park(seeds, "seeds")
    score, mass = park(score, "score"), seeds.agg(F.coalesce(F.sum("mass"), F.lit(0.0))).first()[0]
    if not 0 <= damping < 1:
        raise ValueError("damping must be at least 0 and less than 1, else scores need not settle")
    while True:
        flow = score.join(steps, ["walk", "host"]).select("walk", F.col("to").alias("host"), (F.col("score") * F.col("share") * damping).alias("mass"))
        after = park(seeds.unionByName(flow).groupBy("walk", "host").agg(F.sum("mass").alias("score")), "score")
        old = score.withColumnRenamed("score", "old")
        moved = after.join(old, ["walk", "host"], "full").agg(F.sum(F.abs(F.coalesce("score", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        discard(score)
        score = after
        if (moved or 0.0) <= tolerance * max(mass, 1.0):
            discard(steps)
            discard(seeds)
            return score


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, threshold: float = 0.5, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", damping: float = 0.85) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every page.

    The longest fitting rule decides. The share of a host's pages that rules allow is its trust seed, the share that
    they block its distrust seed; where no rule fits, a host is blocked if its distrust exceeds its trust by
    ``threshold`` or more, so a host without links falls if rules block half of its pages on balance.

    A null url, or one without ``://``, has empty host and path, fits no rule, is no seed and is allowed. Null html has
    no links. Repeated rows count as often as they are there, and each gets its row; other columns don't matter.
    """
    host = host_of(F.col(url_col))
    path = path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__fit", fitting_rule(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("__fit.verdict") == verdict, 1.0).otherwise(0.0))
    hosts = park(rows.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "hosts")
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("walk", "mass")).filter("mass > 0")
    links = park(host_links(pages, url_col, html_col), "links")
    score = propagate(seeds.select("walk", "host", "mass"), links, damping)
    of = lambda walk: F.coalesce(F.sum(F.when(F.col("walk") == walk, F.col("score"))), F.lit(0.0))
    score = park(score.groupBy("host").agg(of("trust").alias("trust"), of("distrust").alias("distrust")), "verdicts")
    discard(links)
    discard(hosts)
    out = rows.join(score, "host", "left")
    out = out.withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    fallen = F.when(F.col("distrust") - F.col("trust") >= threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("__fit.rule").alias("rule"), F.coalesce("__fit.verdict", fallen).alias("verdict"), "trust", "distrust")
