"""URL filters: rules first, then trust and distrust that spread over the links between hosts.

Rules name a host and a path prefix and hold for the host's subdomains too; the longest that fits decides. A host with
more allowed than blocked pages under rules is a trusted seed, one with more blocked than allowed pages a distrusted
seed, each with a mass of its own: the difference as a share of its ruled pages, 1 at most. Trust is personalised PageRank
from the trusted seeds along links; distrust is the same from the distrusted seeds against the links, for who links to bad
hosts is suspect. A page without a rule is blocked if distrust is more than half of its host's trust and distrust together.
As no mass is shared among seeds, a verdict depends on the seeds that links lead from and on no others. Spark expressions
only; the host graph is aggregated before anything is joined, so a host of a third of all pages is one row of it.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_stored, is_hot, join_spread, stored, table

DAMPING, TOLERANCE = 0.85, 1e-10
#: Rounds after which what is left to move is below the tolerance; :func:`spread` goes on for as many as a graph needs.
ITERATIONS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
#: Share of distrust in a host's trust and distrust above which its pages are blocked.
MIN_SHARE = 0.5
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``host/path`` and what it says of the urls it fits."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


RULES = (
    Rule("org/", "allow"),
    Rule("example.org/es/", "block"),
    Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"),
    Rule("com/de/", "block"),
)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def apply_rules(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """``rule`` and its verdict for columns host and path; null where none fits. Equal lengths: block goes first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.verdict == "block", r.pattern)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule = F.when(fits, F.lit(r.pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``src, dst, weight``: links between different hosts, counted over all pages."""
    found = pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), 1)).alias("dst"))
    found = found.select("src", lower_ascii(F.col("dst")).alias("dst")).filter("src <> '' AND dst <> '' AND src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING) -> DataFrame:
    """``host, trust, distrust`` after personalised PageRank in both directions at once.

    ``seeds`` has ``host, kind`` (trust or distrust) and ``weight``, the seed's own mass.
    Hosts without links out lose their mass, as usual where only relative amounts count. A round is one join and one
    sum; every fourth is written to the shared folder, so that plans stay short. The links of hubs, hosts with more than a
    thousandth of all, stay where they are and get the hubs' masses, some thousands at most, by broadcast. Rounds go on until none of them changes
    a host's mass by more than ``tolerance`` of itself; a host that is reached for the first time has changed.
    """
    edges = stored(edges, "edges")
    ways = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "weight")
    )
    n_ways = 2 * edges.count()
    totals = ways.groupBy("kind", "a").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n")).withColumn("hub", is_hot(F.col("n"), n_ways))
    shares = join_spread(ways, totals, ["kind", "a"], "n", n_ways)
    ways = stored(shares.select("kind", F.col("a").alias("host"), "b", (F.col("weight") / F.col("total")).alias("share"), "hub"), "links")
    drop_stored(edges)
    hubs, common = ways.filter("hub"), ways.filter("NOT hub")
    has_hubs = not hubs.isEmpty()
    start = stored(seeds.select("kind", "host", F.col("weight").alias("mass"), F.lit(0.0).alias("was")), "seeds")
    again = start.select("kind", "host", (F.lit(1 - damping) * F.col("mass")).alias("mass"), "was")
    now, settled = start, ways.isEmpty()
    while not settled:
        before = now
        for turn in range(4):
            met = now.join(common, ["kind", "host"])
            if has_hubs:
                at_hubs = now.join(F.broadcast(hubs.select("kind", "host").distinct()), ["kind", "host"], "left_semi")
                met = met.unionByName(hubs.join(F.broadcast(at_hubs), ["kind", "host"]))
            moved = met.select("kind", F.col("b").alias("host"), (F.lit(damping) * F.col("mass") * F.col("share")).alias("mass"), F.lit(0.0).alias("was"))
            parts = moved.unionByName(again)
            if turn == 3:
                parts = parts.unionByName(now.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("was")))
            now = parts.groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("was").alias("was"))
        now = stored(now, "ranks")
        if before is not start:
            drop_stored(before)
        settled = now.filter(F.abs(F.col("mass") - F.col("was")) > tolerance * F.col("mass")).isEmpty()
    one = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("mass")).otherwise(0.0)).alias(kind)
    return now.groupBy("host").agg(one("trust"), one("distrust"))


def judge(
    pages: DataFrame, rules: Sequence[Rule] = RULES, key: str = "page_id", url: str = "url", html: str = "html", min_share: float = MIN_SHARE
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the host's ``trust`` and ``distrust`` for every row of ``pages``.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed. Null html has no links.
    Rows that repeat an id are judged each on its own. Other columns are ignored. A page is read as a whole by one task,
    however long its html; a task keeps a row for each of its links.
    """
    urls = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = apply_rules(rules)
    ruled = urls.withColumn("rule", rule).withColumn("by_rule", verdict)
    tally = ruled.filter("host <> '' AND by_rule IS NOT NULL").groupBy("host").agg(
        F.count_if(F.col("by_rule") == "allow").alias("allowed"), F.count_if(F.col("by_rule") == "block").alias("blocked")
    )
    more = F.col("allowed") - F.col("blocked")
    share = F.abs(more) / (F.col("allowed") + F.col("blocked"))
    seeds = tally.filter(more != 0).select("host", F.when(more < 0, "distrust").otherwise("trust").alias("kind"), share.alias("weight"))
    ranks = spread(host_edges(pages, url, html), seeds)
    joined = ruled.join(ranks, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = F.col("distrust") > F.lit(min_share) * (F.col("trust") + F.col("distrust"))
    spoken = F.coalesce(F.col("by_rule"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", spoken.alias("verdict"), "trust", "distrust")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
