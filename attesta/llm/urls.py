"""URL filters: host and path rules, and trust propagated over the link graph for the rest.

Rules are (verdict, host, path prefix); one fits its host and all subdomains if the url's path
starts with the rule's, and the longest wins. Pages that no rule judges get the verdict of their
host: personalised PageRank spreads trust from the hosts of allowed pages along links, and distrust
from the hosts of blocked pages against the links (who links to a blocked host is suspect). Both
are divided by a PageRank that starts from all pages on the same edges, so they are shares between
0 and 1 whatever the host's size; a host is blocked if distrust exceeds trust by the threshold.

Links of a host to itself, and its mass where it links nowhere, stay with the host. Hosts without
pages take part as link targets. Null urls, or urls without ://, have empty host and path, match no
rule and are allowed. Null html has no links. Repeated pages count each time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.session import shared_dir

#: Fixed values of the production query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

#: A tag (a > in a quoted value doesn't end it), and the value of a link attribute inside one.
TAG = r"""<[A-Za-z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
LINK = r"""(?i)(?<=[\s"'/])(?:href|src|action)\s*=\s*["']?([^"'\s>]+)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, null if none does. A rule's name is host and path."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    cases = []
    for verdict, rule_host, rule_path in ordered:
        on_path = path.startswith(rule_path) if rule_path else F.lit(True)
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & on_path
        cases.append((fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None))


def judged_pages(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule and rule_verdict of each page."""
    host, path = split_url(F.col("url"))
    return pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "url", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and n: the links between hosts that pages hold in href, src and action attributes of tags; relative links stay on the host.

    Links of a scheme without // (mailto:, javascript:, data:) lead to no host and are left out.
    """
    host, _ = split_url(F.col("url"))
    tags = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(TAG), F.lit(0))).alias("tag"))
    links = tags.select("src", F.explode(F.regexp_extract_all("tag", F.lit(LINK), F.lit(1))).alias("link"))
    link = F.col("link")
    target, _ = split_url(F.when(link.startswith("//"), F.concat(F.lit("http:"), link)).otherwise(link))
    dst = F.when(link.rlike(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"), target).when(~link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("src")).otherwise("")
    return links.select("src", dst.alias("dst")).where("src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = 12, damping: float = 0.85, checkpoint_every: int = 4) -> DataFrame:
    """host, trust and distrust in 0 to 1. hosts: host, pages, allowed, blocked (counts of pages).

    One row for each host and direction; trust runs along the links, distrust against them, and each
    direction has its own PageRank of all pages for comparison. A round is one join of edges and one
    sum by host, which combines before the shuffle; heavy hosts are left to AQE's skew join.
    """
    shared_dir(hosts.sparkSession)
    ahead = edges.select(F.lit("trust").alias("way"), "src", "dst", "n")
    back = edges.select(F.lit("distrust").alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    both = ahead.unionByName(back)
    total = both.groupBy("way", "src").agg(F.sum("n").alias("total"))
    steps = both.join(total, ["way", "src"]).select("way", "src", "dst", (F.col("n") / F.col("total")).alias("share")).checkpoint()
    known = hosts.select("host", "pages", "allowed", "blocked").unionByName(
        edges.select(F.col("dst").alias("host")).union(edges.select("src")).distinct().select("host", F.lit(0).cast("bigint").alias("pages"), F.lit(0).cast("bigint").alias("allowed"), F.lit(0).cast("bigint").alias("blocked"))
    ).groupBy("host").agg(F.sum("pages").alias("pages"), F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    ways = known.select("host", "pages", F.explode(F.array(F.struct(F.lit("trust").alias("way"), F.col("allowed").alias("seed")), F.struct(F.lit("distrust").alias("way"), F.col("blocked").alias("seed")))).alias("w"))
    seeds = ways.select(F.col("w.way").alias("way"), "host", F.col("w.seed").cast("double").alias("seed"), F.col("pages").cast("double").alias("base"))
    dangling = seeds.join(steps.select("way", F.col("src").alias("host")).distinct(), ["way", "host"], "left_anti").select("way", F.col("host").alias("src"), F.col("host").alias("dst"), F.lit(1.0).alias("share"))
    steps = steps.unionByName(dangling).checkpoint()
    seeds = seeds.checkpoint()
    state = seeds
    for i in range(rounds):
        sent = state.withColumnRenamed("host", "src").join(steps, ["way", "src"]).select("way", F.col("dst").alias("host"), (damping * F.col("seed") * F.col("share")).alias("seed"), (damping * F.col("base") * F.col("share")).alias("base"))
        start = seeds.select("way", "host", ((1 - damping) * F.col("seed")).alias("seed"), ((1 - damping) * F.col("base")).alias("base"))
        state = start.unionByName(sent).groupBy("way", "host").agg(F.sum("seed").alias("seed"), F.sum("base").alias("base"))
        if (i + 1) % checkpoint_every == 0 and i + 1 < rounds:
            state = state.checkpoint()
    share = F.when(F.col("base") > 0, F.col("seed") / F.col("base")).otherwise(0.0)
    return state.groupBy("host").agg(F.max(F.when(F.col("way") == "trust", share).otherwise(0.0)).alias("trust"), F.max(F.when(F.col("way") == "distrust", share).otherwise(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), and the host's trust and distrust rounded to 6 places."""
    judged = judged_pages(pages, rules)
    hosts = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages"), F.count(F.when(F.col("rule_verdict") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked"))
    scores = propagate(hosts, host_edges(pages)).withColumnRenamed("host", "_host")
    by_method = F.when(F.coalesce(F.round(F.col("distrust") - F.col("trust"), 9), F.lit(0.0)) > threshold, "block").otherwise("allow")
    return judged.join(scores, judged["host"] == scores["_host"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", by_method).alias("verdict"), F.round(F.coalesce("trust", F.lit(0.0)), 6).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 6).alias("distrust"),
    )
