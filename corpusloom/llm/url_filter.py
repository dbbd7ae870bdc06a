"""URL verdicts: host and path rules first, then trust and distrust spread over the links between hosts. SQL functions only.

Links of all pages are added up to weighted edges between hosts (a relative link stays on its host). Trust is personalised PageRank
from what the allow rules cover, along the links; distrust is the same from what the block rules cover, against them: a host
that links to a blocked one is suspect. A host's seed is the share of its pages that rules allow or block.

PageRank is divided among all who link to a host, so the mass alone says how large a part of the whole a host holds, not how bad it
is. Each walk is therefore run a second time with every host as a seed, and what decides is the relative mass: of the PageRank a
host receives, the part that comes from the ruled seeds. That part doesn't shrink with the number of hosts that link to the same
blocked one; over further hops it falls, as the hosts between send mass of their own. A host's suspicion is the larger of its
relative distrust and its own blocked share, its favour the same of trust and allow rules. Pages that no rule fits get the verdict
of their host: block if suspicion exceeds favour by more than ``THRESHOLD``, so that one undivided hop between a blocked host
and the one before a suspect still blocks (0.46), two don't (0.28).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.skew import lookup
from corpusloom.session import materialize

#: (verdict, host, path); the longest that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
THRESHOLD = 0.3
#: The walks end when no host's mass moves by more than this part of what it would have with every host as a seed.
TOLERANCE = 1e-6

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# No attribute before the link may hold a "<": so a run of unclosed tags is read once, not again from each of them.
_LINK = r"(?is)<a\s[^<>]*?\bhref\s*=\s*[\"']?([^\"'>\s]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """``(page_id, host, path, rule, ruled)``: the longest rule that fits and its verdict, both null without one."""
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit(f".{host}"))) & F.startswith(F.col("path"), F.lit(path))
        rule, ruled = F.when(fits, host + path).otherwise(rule), F.when(fits, verdict).otherwise(ruled)
    return parsed.select("*", rule.alias("rule"), ruled.alias("ruled"))


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links of all pages between hosts; pages and links without a host give none."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), 1)
    rows = pages.select(host_of(F.col("url")).alias("src"), F.explode(links).alias("link")).where("src <> ''")
    absolute = F.col("link").rlike("(?i)^[a-z][a-z0-9+.-]*://")
    target = F.when(absolute, host_of(F.col("link"))).when(
        F.startswith("link", F.lit("//")), host_of(F.concat(F.lit("x:"), "link"))
    ).when(F.col("link").rlike("(?i)^(mailto|javascript|tel|data):"), "").otherwise(F.col("src"))
    return rows.select("src", target.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _shares(links: DataFrame) -> DataFrame:
    """``(kind, host, to, share)``: along the links for trust, against them for distrust; ``share`` is of all links of ``host``."""
    along = links.select(F.lit("trust").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n")
    against = links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n")
    edges = along.unionByName(against)
    totals = edges.groupBy("kind", "host").agg(F.sum("n").alias("total"), F.count("*").alias("degree"))
    return lookup(edges, totals, ["kind", "host"], "degree").select("kind", "host", "to", (F.col("n") / F.col("total")).alias("share"))


def host_scores(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """``(host, trust, distrust, favour, suspicion)`` from ``links(src, dst, n)`` and ``seeds(host, allowed, blocked)``.

    ``seeds`` has a row for every host. A round is one lookup of the edges' ends, one sum by host and one join with the state, written
    at its end, so neither the plan nor what a lost executor repeats grows with the rounds. Hosts with very many links are
    broadcast by :func:`lookup`, never gathered. A host without links passes nothing on. What a host sends to itself is solved for
    (a division) rather than sent round after round, which leads to the same masses in far fewer rounds.
    """
    edges = materialize(_shares(links), "edges")
    own = F.sum(F.when(F.col("host") == F.col("to"), F.col("share")).otherwise(0.0))
    degrees = edges.groupBy("kind", "host").agg(F.count("*").alias("degree"), own.alias("own"))
    edges = edges.where("host <> to")
    kinds = F.array(*(
        F.struct(F.lit(kind).alias("kind"), F.col(seed).cast("double").alias("seed")) for kind, seed in (("trust", "allowed"), ("distrust", "blocked"))
    ))
    start = seeds.select("host", F.explode(kinds).alias("k")).select("k.kind", "host", "k.seed")
    now = materialize(start.join(degrees, ["kind", "host"], "left").select(
        "kind", "host", "seed", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("own", F.lit(0.0)).alias("own"),
        F.col("seed").alias("mass"), F.lit(1.0).alias("whole"),
    ), "ranks")
    moved = 1.0
    while moved > tolerance:
        sent = lookup(edges, now.select("kind", "host", "degree", "mass", "whole"), ["kind", "host"], "degree")
        got = sent.groupBy("kind", F.col("to").alias("host")).agg(
            F.sum(F.col("mass") * F.col("share")).alias("got"), F.sum(F.col("whole") * F.col("share")).alias("got_whole")
        )
        step = lambda seed, new: ((1 - damping) * seed + damping * F.coalesce(new, F.lit(0.0))) / (1 - damping * F.col("own"))
        after = now.join(got, ["kind", "host"], "left").select(
            "kind", "host", "seed", "degree", "own", step(F.col("seed"), F.col("got")).alias("mass"), step(F.lit(1.0), F.col("got_whole")).alias("whole"),
            F.col("mass").alias("mass_before"), F.col("whole").alias("whole_before"),
        )
        now = materialize(after.select("*", (
            F.greatest(F.abs(F.col("mass") - F.col("mass_before")), F.abs(F.col("whole") - F.col("whole_before"))) / F.col("whole")
        ).alias("moved")), "ranks")
        moved = now.agg(F.coalesce(F.max("moved"), F.lit(0.0)).alias("moved")).first()["moved"]
    received = F.col("whole") - (1 - damping)
    relative = F.when(received > 1e-9, (F.col("mass") - (1 - damping) * F.col("seed")) / received).otherwise(0.0)
    of = lambda kind, value: F.max(F.when(F.col("kind") == kind, value))
    return now.withColumn("score", F.greatest("seed", relative)).groupBy("host").agg(
        of("trust", F.col("mass")).alias("trust"), of("distrust", F.col("mass")).alias("distrust"),
        of("trust", F.col("score")).alias("favour"), of("distrust", F.col("score")).alias("suspicion"),
    )


def verdicts(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``(page_id, host, path, rule, verdict, favour, suspicion)``, one row for each row of ``pages``.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed, as nothing speaks against it; so is
    a page of a host without evidence. Null html has no links; an unclosed tag ends where the next begins. Hosts that are only linked
    to carry scores on. Repeated rows weigh as often as they occur; other columns are not read.
    """
    ruled = with_rule(pages, rules)
    links = materialize(host_links(pages), "links")
    share = lambda verdict: F.sum((F.coalesce("ruled", F.lit("")) == verdict).cast("long"))
    own = ruled.groupBy("host").agg(F.count("*").alias("n_pages"), share("allow").alias("allow"), share("block").alias("block"))
    linked = links.select(F.col("dst").alias("host"), *(F.lit(0).cast("long").alias(c) for c in ("n_pages", "allow", "block"))).distinct()
    hosts = materialize(own.unionByName(linked).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n_pages", "allow", "block"))), "hosts")
    part = lambda c: F.col(c) / F.greatest("n_pages", F.lit(1))
    scores = host_scores(links, hosts.select("host", part("allow").alias("allowed"), part("block").alias("blocked")))
    scores = materialize(hosts.select("host", "n_pages").join(scores, "host"), "scores")
    suspect = F.col("suspicion") - F.col("favour") > threshold
    return lookup(ruled, scores, ["host"], "n_pages").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(suspect, "block").otherwise("allow")).alias("verdict"),
        F.round("favour", 4).alias("favour"), F.round("suspicion", 4).alias("suspicion"),
    )
