"""Operator 9: url filter by rules and by trust that flows along links. DataFrame functions only.

A url is judged by the longest rule that fits, of equally long ones by the one stated first. A url without a rule gets the verdict of its host, which
comes from the link graph between hosts: hosts of which most pages are allowed by rules are trusted
seeds, those of which most are blocked are distrusted seeds. Personalised PageRank carries trust from
the trusted seeds along links, and distrust from the distrusted seeds against them (who links to a bad
host is suspect). Both are computed together, round by round, until the ranks change by less than
``TOLERANCE`` in sum; a host whose distrust exceeds ``threshold`` times its trust is suspect.

How much distrust reaches a host also depends on how many others link to the same hosts, so its height
says nothing by itself. What counts is the host's own exposure: the chance that a walk along its links,
which goes on with probability ``DAMPING`` and ends at hosts that are not suspect, comes to a distrusted
seed. A suspect host is blocked if its exposure is over ``least`` (so that a host is not blocked for what
lies far behind its links).

Links are counted per pair of hosts before they are joined, so a host with a third of all pages is few
rows. Ranks are written to the shared folder every few rounds, which cuts the lineage.

Null urls and urls without ``://`` have an empty host and path, fit no rule and are allowed. Links within
a host carry nothing. Null or very long pages, repeated rows and empty tables need no special care;
further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.llm.frames import written

DAMPING, TOLERANCE, ROUNDS = 0.85, 1e-6, 4
#: Target of a link, without the quotes around it.
LINK = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*[\"']?\s*([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the rules (action, host and path) that fits; null if none does."""
    fits = []
    for _, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits.append(F.when(((host == name) | host.endswith("." + name)) & path.startswith(slash + rest), rule))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def host_links(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Links between different hosts: ``src, dst, weight``."""
    found = pages.select(
        host_of(F.col(url_column)).alias("src"),
        F.explode(F.regexp_extract_all(F.coalesce(html_column, F.lit("")), F.lit(LINK), 1)).alias("_link"))
    full = F.when(F.col("_link").startswith("//"), F.concat(F.lit("http:"), "_link")).otherwise(F.col("_link"))
    return (found.select("src", host_of(full).alias("dst"))
            .where("src <> '' AND dst <> '' AND src <> dst")
            .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))


def propagate(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """Trust along ``links`` and distrust against them: ``kind, host, rank``.

    ``seeds`` holds ``kind`` ('trust' or 'distrust') and ``host``; the seeds of a kind share 1 evenly.
    """
    ahead = links.select(F.lit("trust").alias("kind"), "src", "dst", "weight")
    back = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    both = ahead.unionByName(back)
    sums = both.groupBy("kind", "src").agg(F.sum("weight").alias("_all"))
    edges = written(both.join(sums, ["kind", "src"])
                    .select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("_all")).alias("share")),
                    "host-links")
    counts = seeds.groupBy("kind").agg(F.count("*").alias("_n"))
    base = written(seeds.join(counts, "kind").select("kind", "host", (1 / F.col("_n")).alias("rank")), "seeds")
    ranks = base
    while True:
        for _ in range(ROUNDS):
            last = ranks
            given = last.join(edges, ["kind", "host"]).select(
                "kind", F.col("dst").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
            kept = base.select("kind", "host", ((1 - DAMPING) * F.col("rank")).alias("rank"))
            ranks = given.unionByName(kept).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        both_ranks = written(
            ranks.withColumn("_now", F.lit(1)).unionByName(last.withColumn("_now", F.lit(-1)))
            .groupBy("kind", "host").agg(F.sum(F.when(F.col("_now") == 1, F.col("rank"))).alias("rank"),
                                         F.sum(F.col("rank") * F.col("_now")).alias("_change")), "ranks")
        ranks = both_ranks.where("rank IS NOT NULL").select("kind", "host", "rank")
        change = both_ranks.agg(F.sum(F.abs("_change"))).first()[0] or 0.0
        if change < TOLERANCE:
            return ranks


def exposure(links: DataFrame, suspects: DataFrame, seeds: DataFrame) -> DataFrame:
    """The chance of coming along ``links`` from suspect hosts to distrusted seeds: ``host, rank``.

    Seeds have 1. ``suspects`` and ``seeds`` hold ``host``, each once.
    """
    sums = links.groupBy("src").agg(F.sum("weight").alias("_all"))
    edges = written(links.join(sums, "src").select(
        F.col("src").alias("_from"), F.col("dst").alias("host"), (F.col("weight") / F.col("_all")).alias("share"))
        .join(suspects.join(seeds, "host", "left_anti").select(F.col("host").alias("_from")), "_from"), "suspect-links")
    base = written(seeds.select("host", F.lit(1.0).alias("rank")), "distrusted")
    ranks = base
    while True:
        for _ in range(ROUNDS):
            last = ranks
            ranks = base.unionByName(
                last.join(edges, "host").select(F.col("_from").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
                .groupBy("host").agg(F.sum("rank").alias("rank")))
        # Exposures only grow from round to round.
        both = written(ranks.withColumn("_change", F.col("rank")).unionByName(last.withColumn("_change", -F.col("rank")))
                       .groupBy("host").agg(F.max("rank").alias("rank"), F.sum("_change").alias("_change")), "exposure")
        ranks = both.select("host", "rank")
        if (both.agg(F.max(F.abs("_change"))).first()[0] or 0.0) < TOLERANCE:
            return ranks


def judge(pages: DataFrame, rules: list[tuple[str, str]], threshold: float = 1.0, least: float = 0.25,
          id_column: str = "page_id",
          url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One row per page: its id, ``host, path, rule, verdict``.

    ``rules`` are pairs of an action (block or allow) and a rule such as ``net/`` or ``org/fr/``.
    """
    url = F.col(url_column)
    rule = longest_rule(F.col("host"), F.col("path"), rules)
    action = F.coalesce(*[F.when(F.col("rule") == r, F.lit(a)) for a, r in rules], F.lit(None).cast("string"))
    judged = (pages.select(F.col(id_column).alias(id_column), host_of(url).alias("host"), path_of(url).alias("path"))
              .withColumn("rule", rule).withColumn("_action", action))
    most = (judged.where("host <> ''").groupBy("host")
            .agg(F.avg((F.coalesce("_action", F.lit("")) == "allow").cast("int")).alias("_allowed"),
                 F.avg((F.coalesce("_action", F.lit("")) == "block").cast("int")).alias("_blocked")))
    seeds = most.select(F.when(F.col("_allowed") > 0.5, "trust").when(F.col("_blocked") > 0.5, "distrust").alias("kind"),
                        "host").where("kind IS NOT NULL")
    links = written(host_links(pages, url_column, html_column), "links")
    ranks = propagate(links, seeds)
    zero = F.lit(0.0)
    suspects = written(
        ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("_trust"),
                                  F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("_distrust"))
        .where(F.coalesce("_distrust", zero) > threshold * F.coalesce("_trust", zero)).select("host"), "suspects")
    exposed = exposure(links, suspects, seeds.where("kind = 'distrust'").select("host"))
    hosts = written(suspects.join(exposed.where(F.col("rank") > least), "host")
                    .select("host", F.lit("block").alias("_host_verdict")), "blocked-hosts")
    return (judged.join(hosts, "host", "left")
            .select(id_column, "host", "path", "rule",
                    F.coalesce("_action", "_host_verdict", F.lit("allow")).alias("verdict")))
