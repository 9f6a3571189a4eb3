"""URL rules and trust over the host graph; DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """What stands after the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; null or none: empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(pages: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """``pages`` (key, host, path) with the longest fitting rule: adds ``rule`` and ``rule_verdict``, both null if none fits.

    ``rules`` has (host, path, verdict). A rule fits its host and all
    subdomains, if the path starts with its path. Each different (host, path) meets the rules by
    equality of one of the host's suffixes and of a start of the path that is as long as
    some rule's path for that suffix, so rules may be many, on one host, too, and none are gathered. Of rules
    of one length with both verdicts, block wins.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rated = F.struct(F.length(F.concat("host", "path")).alias("size"), F.col("verdict").alias("rule_verdict"), F.concat("host", "path").alias("rule"))
    known = rules.where("host is not null and path is not null").groupBy(F.col("host").alias("suffix"), F.col("path").alias("start")).agg(F.max(rated).alias("best"))
    lengths = known.groupBy("suffix").agg(F.collect_set(F.length("start")).alias("lengths"))
    places = pages.select("host", "path").distinct()
    hosts = places.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(lengths, "suffix")
    near = scratch.keep(hosts.groupBy("host").agg(F.collect_set(F.struct("suffix", "lengths")).alias("near")), "near")
    tried = places.join(near, "host").select("host", "path", F.inline("near")).select("host", "path", "suffix", F.explode("lengths").alias("n")).where(F.length("path") >= F.col("n"))
    met = tried.select("host", "path", "suffix", F.expr("substring(path, 1, n)").alias("start")).join(known, ["suffix", "start"])
    best = scratch.keep(met.groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", "best.rule", "best.rule_verdict"), "best")
    return pages.join(best, ["host", "path"], "left").select(*(pages[c] for c in pages.columns), "rule", "rule_verdict")


def host_edges(pages: DataFrame, host: Column, html: Column) -> DataFrame:
    """(src, dst, weight) over hosts: links with a host of their own from a page to another host.

    A host pair's links are counted before they meet, and each host's weights add up to 1.
    """
    target = r"(?i)\bhref\s*=\s*[\"']?\s*((?:https?:)?//[^\"'\s>]+)"
    found = pages.select(host.alias("src"), F.explode(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(target), F.lit(1))).alias("link"))
    to = host_of(F.when(F.startswith("link", F.lit("//")), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link")))
    edges = found.select("src", to.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def _spread(edges: DataFrame, seeds: DataFrame, out: str, into: str, damping: float, rounds: int, scratch: Scratch, name: str) -> DataFrame:
    """Personalised PageRank: (host, score) after ``rounds`` rounds along ``out`` -> ``into``; ``seeds`` is (host, start)."""
    score = seeds.select("host", F.col("start").alias("score"))
    base = seeds.select("host", ((1 - damping) * F.col("start")).alias("part"))
    for k in range(rounds):
        moved = edges.join(score, edges[out] == score.host).groupBy(F.col(into).alias("host")).agg(F.sum(damping * F.col("weight") * F.col("score")).alias("part"))
        score = base.unionByName(moved).groupBy("host").agg(F.sum("part").alias("score"))
        if k % 5 == 4 or k == rounds - 1:
            score = scratch.keep(score, f"{name}-{k}")
    return score


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, rounds: int = 10, margin: float | None = None) -> DataFrame:
    """One row per page: (page_id, host, path, rule, verdict, trust, distrust).

    The verdict is the longest fitting rule's. For pages that no rule fits it is the
    host's: trust spreads from hosts with pages that a rule allows along links,
    distrust from hosts with blocked pages against them (who links to the blocked is
    suspect); each seed host starts with the share of its pages that rules allow or
    block. A host is blocked if its distrust exceeds its trust by more than
    ``margin``, by default what a host has on its own if half of its pages are blocked; hosts that neither reaches are allowed.

    Null urls and urls without ``://`` have an empty host and path. Null html has no links. Repeated rows each have a row.
    Other columns are ignored. Empty tables of pages or rules are fine: without rules all hosts are allowed.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    margin = (1 - damping) / 2 if margin is None else margin
    url = F.col(url_col)
    parted = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    met = scratch.keep(match_rules(parted, rules, scratch), "met")
    share = met.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rule_verdict") == ALLOW).alias("good"), F.count_if(F.col("rule_verdict") == BLOCK).alias("bad"))
    share = scratch.keep(share.where("host <> '' and good + bad > 0").select("host", (F.col("good") / F.col("n")).alias("good"), (F.col("bad") / F.col("n")).alias("bad")), "seeds")
    edges = scratch.keep(host_edges(pages, host_of(url), F.col(html_col)), "edges")
    back = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    reversed_ = scratch.keep(edges.join(back, "dst").select("src", "dst", (F.col("weight") / F.col("total")).alias("weight")), "reversed")

    trust = _spread(edges, share.where("good > 0").select("host", F.col("good").alias("start")), "src", "dst", damping, rounds, scratch, "trust")
    distrust = _spread(reversed_, share.where("bad > 0").select("host", F.col("bad").alias("start")), "dst", "src", damping, rounds, scratch, "distrust")
    hosts = trust.select("host", F.col("score").alias("trust"), F.lit(0.0).alias("distrust")).unionByName(distrust.select("host", F.lit(0.0).alias("trust"), F.col("score").alias("distrust")))
    hosts = hosts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
    judged = met.join(hosts, "host", "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust")})
    own = F.when(F.col("distrust") > F.col("trust") + margin, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "trust", "distrust")
