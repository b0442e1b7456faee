"""Operator 7: URL filters by rules and by trust in the link graph, with DataFrame functions only.

A rule (host, path) fits its host and all subdomains of it where the path of the url starts with the rule's; the
longest rule wins. Urls without a rule are judged by their host: personalised PageRank spreads trust from the
hosts of allowed pages along the links, and distrust from the hosts of blocked pages against them; a host is
blocked when its distrust exceeds its trust by the threshold.

Defined cases: a null url or one without ``://`` has an empty host and path; a host without trust or distrust is
allowed; of rules of equal length the first in the alphabet wins; a table without links leaves the seeds' own weights; repeated pages count as pages, and repeated links
between two hosts as one weighted edge; links to the same host are no edges; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stavelake.llm.common import Scratch, ascii_lower, table, written


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING = 0.85
#: The walk has settled when a round moves less than this of all rank; each round moves at most ``DAMPING`` of what the last one did.
TOLERANCE, MOST_ROUNDS = 1e-6, 200
THRESHOLD = 0.0
URL_IN_HTML = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_match(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host + r.path), r.host + r.path)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def ruled_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """page_id, url, host, path, rule, rule_verdict."""
    split = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = _rule_match(rules)
    return split.select("*", rule.alias("rule"), verdict.alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, weight: links between different hosts, counted before the shuffle."""
    linked = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(URL_IN_HTML), F.lit(1))).alias("link"))
    full = F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return (
        linked.select("src", host_of(full).alias("dst"))
        .filter("src <> dst and src <> '' and dst <> ''")
        .groupBy("src", "dst")
        .agg(F.count("*").cast("double").alias("weight"))
    )


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """host, rank. seeds: host, seed (adding up to 1). Rank that a host without links would pass on goes back to the seeds.

    Each round is a join on the host and one sum, cut by a written table; the rounds end when the ranks have settled.
    """
    none, no = F.lit(0.0), F.lit(False)
    start = seeds.select("host", F.col("seed").alias("rank"), none.alias("before"), no.alias("linked"))
    with Scratch(edges.sparkSession) as scratch:
        out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
        shares = scratch.written(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "links")
        if shares.isEmpty():
            return written(start.select("host", "rank"), "rank")
        linked = scratch.written(out.select(F.col("src").alias("host"), none.alias("rank"), none.alias("before"), F.lit(True).alias("linked")), "linked")
        sums = lambda rows: scratch.written(rows.union(linked).groupBy("host").agg(F.sum("rank").alias("rank"), F.sum("before").alias("before"), F.max("linked").alias("linked")), "rank")
        rank = sums(start)
        for _ in range(MOST_ROUNDS):
            # Two numbers: what the round before changed, and the rank that hosts with links pass on.
            change, sent = rank.agg(F.sum(F.abs(F.col("rank") - F.col("before"))), F.coalesce(F.sum(F.when(F.col("linked"), F.col("rank"))), none)).first()
            if change is None or change < tolerance:
                return written(rank.filter("rank > 0").select("host", "rank"), "rank")
            moved = shares.join(rank.withColumnRenamed("host", "src"), "src").select("dst", damping * F.col("rank") * F.col("share"), none, no)
            kept = seeds.select("host", (F.col("seed") * (1 - damping * sent)), none, no)
            new = sums(rank.select("host", none.alias("rank"), F.col("rank").alias("before"), no.alias("linked")).union(moved).union(kept))
            scratch.drop(rank)
            rank = new
        raise RuntimeError(f"the ranks have not settled in {MOST_ROUNDS} rounds")


def _seeds(hosts: DataFrame, column: str) -> DataFrame:
    whole = hosts.agg(F.sum(column)).first()[0] or 1.0  # one number
    return hosts.filter(F.col(column) > 0).select("host", (F.col(column) / whole).alias("seed"))


def host_scores(ruled: DataFrame, edges: DataFrame) -> DataFrame:
    """host, trust, distrust: each adds up to 1 over all hosts, weighted by the share of pages on either side."""
    hosts = ruled.groupBy("host").agg(
        F.count_if(F.col("rule_verdict") == "allow").cast("double").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").cast("double").alias("blocked")
    )
    with Scratch(ruled.sparkSession) as scratch:
        hosts, edges = scratch.written(hosts, "hosts"), scratch.written(edges, "edges")
        against = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        trust = personalised_pagerank(edges, _seeds(hosts, "allowed")).withColumnRenamed("rank", "trust")
        distrust = personalised_pagerank(against, _seeds(hosts, "blocked")).withColumnRenamed("rank", "distrust")
    return trust.join(distrust, "host", "full").select("host", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def judged_pages(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page."""
    ruled = written(ruled_pages(pages, rules), "pages")
    scores = host_scores(ruled, host_edges(pages))
    trust, distrust = (F.coalesce(x, F.lit(0.0)) for x in ("trust", "distrust"))
    # Sums differ in their last digits with the order of their rows.
    blocked = distrust - trust > threshold + 1e-9 * F.greatest(trust, distrust)
    by_host = F.when(blocked, "block").otherwise("allow")
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_host).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_pages(table(spark, sf_dir, "pages"))
