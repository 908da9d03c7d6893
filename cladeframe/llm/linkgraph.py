"""URL filters: host rules and propagation of trust over the link graph.

Only DataFrame functions.  Hosts are linked by the absolute links of their pages
and, both ways, with the domain above them.  Trust is a personalised PageRank
from hosts with allowed pages, distrust one over the reversed edges from hosts
with blocked pages; a host whose distrust exceeds its trust is blocked where no
rule decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.common import Scratch

#: (host, path, verdict); a rule fits its host and all subdomains if the path begins with its path.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""
DAMPING, TOLERANCE = 0.85, 0.005
#: After so many steps less than ``TOLERANCE`` of all trust (and of all distrust) is still on its way, whatever the graph.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: A host is blocked only if its distrust exceeds its trust by more than this share (rounding of sums).
MARGIN = 1e-9
#: Hosts that may be broadcast to the pages; beyond that pages and hosts are joined by a shuffle.
MAX_BROADCAST_HOSTS = 200_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(x: Column) -> Column:
    return F.translate(x, _UPPER, _LOWER)


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, _lower(F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*", 0))), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def _fitting(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    # from short to long, so that the longest is asked first
    for r in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1])
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def host_edges(pages: DataFrame, keep=lambda df: df) -> DataFrame:
    """``src, dst, n`` between different hosts: links of pages, and hosts with the domain above (``keep`` may store what is read twice)."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(
        F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), _lower))).alias("dst"))
    linked = keep(links.groupBy(F.col("host").alias("src"), "dst").agg(F.count(F.lit(1)).alias("n")))
    hosts = pages.select("host").union(linked.select("dst")).distinct()
    # example.com is above a.b.example.com twice over; top-level domains link nothing
    above = hosts.select(F.col("host").alias("src"), F.expr("substring(host, instr(host, '.') + 1)").alias("dst")) \
        .where("instr(dst, '.') > 0 and src <> dst")
    both = above.select("src", "dst", F.lit(1).cast("long").alias("n")).union(
        above.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).cast("long").alias("n")))
    return linked.union(both).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust`` after ``rounds`` steps.

    ``seeds(host, good, bad)`` are weights; each kind is scaled to a sum of one.
    Trust follows edges in shares of a host's links, distrust follows them
    backwards in shares of a host's linkers.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all")).withColumnRenamed("src", "host")
    back = edges.groupBy("dst").agg(F.sum("n").alias("all")).withColumnRenamed("dst", "host")
    steps = scratch.save(
        edges.join(out.withColumnRenamed("host", "src"), "src").select(
            F.lit(0).alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("p"))
        .union(edges.join(back.withColumnRenamed("host", "dst"), "dst").select(
            F.lit(1).alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("p"))))
    long = seeds.select("host", F.posexplode(F.array("good", "bad")).alias("kind", "w")).where("w > 0")
    total = long.groupBy("kind").agg(F.sum("w").alias("total"))
    start = scratch.save(long.join(F.broadcast(total), "kind").select("kind", "host", (F.col("w") / F.col("total")).alias("r")))
    rank = start
    for k in range(1, rounds + 1):
        moved = steps.join(rank, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.lit(damping) * F.col("p") * F.col("r")).alias("r"))
        rank = moved.union(start.select("kind", "host", (F.lit(1 - damping) * F.col("r")).alias("r"))) \
            .groupBy("kind", "host").agg(F.sum("r").alias("r"))
        if k % 5 == 0:
            rank = scratch.save(rank)
    return rank.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0.0)).alias("trust"),
                                    F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0.0)).alias("distrust"))


def judge_urls(pages: DataFrame, scratch: Scratch, rules=RULES, margin: float = MARGIN,
               rounds: int = ROUNDS) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust``, one row per page.

    ``verdict`` is the fitting rule's; without one it is ``block`` if the host's
    distrust exceeds its trust by more than the share ``margin``, and ``allow`` else (so
    hosts that neither reaches are allowed); only the ratio of the two counts, so the
    size of the web doesn't matter.  Rows that repeat a page count as often as they occur,
    other columns are ignored, an empty table gives an empty result.  A null url, or one
    without ``://``, has an empty host and path, fits no rule and is allowed; null
    html has no links.
    """
    named = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule = _fitting(F.col("host"), F.col("path"), rules, lambda r: r[0] + r[1])
    ruled = _fitting(F.col("host"), F.col("path"), rules, lambda r: r[2])
    seeds = named.where("host <> ''").select("host", ruled.alias("v")).groupBy("host").agg(
        F.count_if(F.col("v") == "allow").alias("good"), F.count_if(F.col("v") == "block").alias("bad"))
    edges = scratch.save(host_edges(named, scratch.save))
    scores = scratch.save(propagate(edges, seeds, scratch, rounds=rounds).select(
        F.col("host").alias("scored"), "trust", "distrust"))
    small = scores.count() <= MAX_BROADCAST_HOSTS
    return named.select("page_id", "host", "path", rule.alias("rule"), ruled.alias("ruled")).join(
        F.broadcast(scores) if small else scores, F.col("host") == F.col("scored"), "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("distrust") > F.col("trust") * F.lit(1 + margin), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
