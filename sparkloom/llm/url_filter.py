"""URL rules and link-graph propagation over host edges, by DataFrame functions only.

Rules (host, path prefix) fit their host and its subdomains; the longest that fits decides a
page. Other pages get their host's verdict: personalised PageRank spreads trust along links
from hosts with allowed pages and distrust against them from hosts with blocked pages; a host
is blocked where its distrust outweighs its trust ``RATIO`` times and is worth ``SHARE`` blocked
pages or more for each page it has.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and
is allowed; null html has no links, a tag that is not closed reaches to the next one's end; repeated pages count each; an empty table gives an empty
one; other columns are ignored. Ranks that two hosts share need no tie-break: hosts are judged
one by one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_hot, settle

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Scores are in pages. Rounds go on until those since the last cut have added less than ``TOLERANCE`` pages to all
#: scores together; each round sends on ``DAMPING`` of what the one before it did, so no score has that much to come.
DAMPING, TOLERANCE, CUT_EVERY = 0.85, 1e-3, 4
RATIO, SHARE = 4.0, 0.5
#: A table of host verdicts of at most so many rows is broadcast; a larger one is shuffled.
BROADCAST_HOSTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A tag is taken whole before its link is looked for, so that a page is scanned once.
ANCHOR, LINK = r"(?i)<a\s[^>]*", r"""(?i)^<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """verdict and rule of the longest rule that fits; null where none does."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and the number of links between different hosts."""
    tags = pages.select("host", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(ANCHOR), F.lit(0))).alias("tag"))
    links = tags.select("host", F.regexp_extract("tag", LINK, 1).alias("link")).where("link <> ''")
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    links = links.select(F.col("host").alias("src"), host_of(absolute).alias("dst"))
    return links.where((F.col("dst") != "") & (F.col("src") != "") & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """kind, host, score: PageRank from seeds (kind, host, seed) along edges (kind, src, dst, links).

    A host's score is its seed and, for each path that leads to it, the path's share of the seed where it begins,
    damped by its length. Scores only grow, so the growth of their total is all that has changed. The edges of a
    host with very many are dealt to parts.
    """
    out = settle(edges.groupBy("kind", "src").agg(F.sum("links").alias("total"), F.count("*").alias("_n")), "url-out")
    weighted = join_hot(edges, out.drop("_n"), ["kind", "src"], None, counts=out.drop("total"))
    weighted = settle(weighted.select("kind", "src", "dst", (F.col("links") / F.col("total")).alias("w")), "url-edges")
    home = settle(seeds, "url-seeds").select("kind", "host", F.col("seed").cast("double").alias("score"))
    rank = home
    if weighted.isEmpty():
        return rank
    degrees = out.drop("total")
    last = rank.agg(F.sum("score")).first()[0] or 0.0
    while True:
        for _ in range(CUT_EVERY):
            senders = rank.withColumnRenamed("host", "src")
            sent = join_hot(weighted, senders, ["kind", "src"], None, counts=degrees).groupBy("kind", F.col("dst").alias("host")).agg((DAMPING * F.sum(F.col("w") * F.col("score"))).alias("score"))
            rank = sent.unionByName(home).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        rank = settle(rank, "url-rank")
        total = rank.agg(F.sum("score")).first()[0] or 0.0
        if total - last <= max(tolerance, 1e-12 * total):
            return rank
        last = total


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html"))
    judged = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    hosts = settle(judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("r.verdict") == "allow").alias("allowed"), F.count_if(F.col("r.verdict") == "block").alias("blocked")), "url-hosts")
    seeds = hosts.select(F.lit("trust").alias("kind"), "host", F.col("allowed").alias("seed")).unionByName(hosts.select(F.lit("distrust").alias("kind"), "host", F.col("blocked").alias("seed"))).where("seed > 0")
    links = settle(host_edges(rows), "url-links")
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    rank = propagate(both, seeds, tolerance).groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("score"))).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("score"))).alias("distrust"))
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    bad = settle(hosts.join(rank, "host").where((distrust > RATIO * trust) & (distrust >= SHARE * F.col("pages"))).select("host", F.lit(True).alias("bad")), "url-bad")
    n = bad.count()
    method = F.when(F.col("bad"), "block").otherwise("allow")
    pages_of = hosts.select("host", F.col("pages").alias("_n"))
    return join_hot(judged.drop("html"), bad, ["host"], n if n <= BROADCAST_HOSTS else None, "left", counts=pages_of).select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), method).alias("verdict"))
