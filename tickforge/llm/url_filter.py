"""URL filter: explicit rules first, then trust and distrust over the host graph.

Edges join the host of a page with the hosts it links to (absolute and
scheme-relative links), and every host with its parent domain in both
directions. Trust is personalised PageRank from trusted seeds along the edges.
Distrust of a blocked seed is 1, of another host the damped mean over its own
out-links, so a host that links to blocked hosts inherits distrust however many
others link there too. Both run in Spark on the aggregated host graph.

A host is blocked if its distrust is at least ``LEAST_DISTRUST`` and above its
trust in units of what a seed emits, or if it is a blocked seed and no trusted one.

Seeds: hosts with a term of ``BLOCKED_TERMS`` as a whole word of the name and
hosts that a rule blocks as a whole are blocked, whether they have a page, are
linked to or are a parent domain; hosts with a page that a rule allows are trusted.

Defined results
* null url or no ``://``: empty host and path, no rule, allowed.
* null html: no links. Null page ids pass through; repeated rows are judged row by row.
* very long pages: links are read from the whole page and counted per host pair.
* ties: of rules of equal length the one that sorts first; equal trust and distrust: allowed.
* empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.store import stored

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: (verdict, host, path) of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BLOCKED_TERMS = ("casino", "pills", "bets", "porn", "viagra", "poker", "payday")
DAMPING, ROUNDS, LEAST_DISTRUST = 0.85, 12, 0.5
#: Part of a host's distrust that comes from its domain edges if it has links too.
DOMAIN_SHARE = 0.2
_LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\"'\s>]+)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and all its parent domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def host_rules(hosts: DataFrame, rules) -> DataFrame:
    """(host, rules): the rules that fit a host, longest first."""
    spark = hosts.sparkSession
    known = spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules],
                                  "verdict string, rule_host string, rule_path string, rule string")
    fit = hosts.select("host", F.explode(suffixes(F.col("host"))).alias("rule_host")).join(known, "rule_host")
    listed = F.struct((-F.length("rule")).alias("order"), "rule", "rule_path", "verdict")
    return fit.groupBy("host").agg(F.array_sort(F.collect_set(listed)).alias("rules"))


def link_edges(pages: DataFrame, url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(src, dst, weight): links between different hosts, counted."""
    links = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(
        F.regexp_extract_all(F.col(body_col), F.lit(_LINK), F.lit(1))).alias("dst"))
    links = links.withColumn("dst", F.translate("dst", _UPPER, _UPPER.lower()))
    return (links.where("src != dst and src != ''").groupBy("src", "dst")
            .agg(F.count("*").cast("double").alias("weight")))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """Every host and its parent domains, linked step by step in both directions."""
    steps = hosts.select(F.explode(F.transform(F.arrays_zip(
        F.slice(suffixes(F.col("host")), 1, F.size(suffixes(F.col("host"))) - 1).alias("a"),
        F.slice(suffixes(F.col("host")), 2, F.size(suffixes(F.col("host")))).alias("b")),
        lambda x: x)).alias("s")).select(F.col("s.a").alias("src"), F.col("s.b").alias("dst"))
    steps = steps.where("dst like '%.%'").distinct()  # a top-level domain vouches for nobody
    return steps.union(steps.select("dst", "src")).withColumn("weight", F.lit(1.0))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): personalised PageRank; each seed emits ``1 - damping`` per round.

    A round is one join on the source and one partially aggregated sum per
    target; lineage is cut in the shared folder every four rounds.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    share = stored(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")), "share")
    start = seeds.select("host").distinct().withColumn("rank", F.lit(1.0 - damping))
    rank = start
    for i in range(rounds):
        moved = (share.join(rank, share["src"] == rank["host"])
                 .select(F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")))
        rank = moved.unionByName(start).groupBy("host").agg(F.sum("rank").alias("rank"))
        if i % 4 == 3:
            rank = stored(rank, f"rank{i}")
    return rank


def inherit(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, rank): 1 for seeds, else ``damping`` times the mean rank of what the host points to.

    ``edges`` are (src, dst, links, domains). A host's shares sum to 1, so its
    rank depends neither on the in-links of its targets nor on the graph's size.
    A round is one join on the target and one partially aggregated sum per source.
    """
    seeds = stored(seeds.select("host").distinct(), "seeds")
    out = edges.groupBy("src").agg(F.sum("links").alias("n_links"), F.sum("domains").alias("n_domains"))
    links, domains = F.col("links") / F.col("n_links"), F.col("domains") / F.col("n_domains")
    part = (F.when(F.col("n_links") == 0, domains).when(F.col("n_domains") == 0, links)
            .otherwise((1 - DOMAIN_SHARE) * links + DOMAIN_SHARE * domains))
    share = stored(edges.join(seeds, edges["src"] == seeds["host"], "left_anti").join(out, "src")
                   .select("src", "dst", part.alias("share")), "inherit")
    start = seeds.withColumn("rank", F.lit(1.0))
    rank = start
    for i in range(rounds):
        moved = (share.join(rank, share["dst"] == rank["host"])
                 .select(F.col("src").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")))
        rank = moved.groupBy("host").agg(F.sum("rank").alias("rank")).unionByName(start)
        if i % 4 == 3:
            rank = stored(rank, f"inherited{i}")
    return rank


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", rules=RULES,
          blocked_terms=BLOCKED_TERMS, rounds: int = ROUNDS, least_distrust: float = LEAST_DISTRUST,
          blocked_hosts: DataFrame | None = None, trusted_hosts: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) per page.

    Seeds: hosts blocked whole by a rule, hosts with a word of ``blocked_terms`` and
    the ``host`` column of ``blocked_hosts``; trusted are hosts with a page that a
    rule allows and those of ``trusted_hosts``. Seed tables may be of any size.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"),
                        path_of(F.col(url_col)).alias("path"))
    paths = urls.groupBy("host").agg(F.count("*").alias("n_pages"))
    hosts = stored(paths, "hosts")
    links = stored(link_edges(pages, url_col, body_col), "links")
    ends = hosts.select("host").union(links.select("dst"))
    graph = stored(ends.select(F.explode(suffixes(F.col("host"))).alias("host"))
                   .where("host like '%.%'").union(ends).distinct(), "graph")
    fitted = stored(host_rules(graph, rules), "rules")
    first = lambda: F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    # which rule paths a page is under, once per host: a host with many pages is few rows
    under = F.filter(F.array(*[F.lit(p) for p in sorted({p for _, _, p in rules})]), lambda p: F.startswith(F.col("path"), p))
    kinds = urls.select("host", under.alias("under")).distinct()
    best = F.get(F.filter("rules", lambda r: F.array_contains("under", r["rule_path"])), F.lit(0))
    allowed = (kinds.join(fitted, "host").select("host", best.alias("r"))
               .where("r.verdict = 'allow'").select("host"))
    if trusted_hosts is not None:
        allowed = allowed.union(trusted_hosts.select("host").where("host is not null"))
    allowed = stored(allowed.distinct(), "allowed")
    whole = fitted.where(F.exists("rules", lambda r: (r["verdict"] == "block") & (r["rule_path"] == "/"))).select("host")
    word = r"(?<!\p{L})(?:" + "|".join(blocked_terms) + r")(?!\p{L})"
    named = graph.where(F.col("host").rlike(word)) if blocked_terms else whole
    domains = domain_edges(graph)
    edges = stored(links.select("src", "dst", F.col("weight").alias("links"), F.lit(0.0).alias("domains"))
                   .unionByName(domains.select("src", "dst", F.lit(0.0).alias("links"), F.col("weight").alias("domains")))
                   .groupBy("src", "dst").agg(F.sum("links").alias("links"), F.sum("domains").alias("domains")), "edges")
    ahead = edges.select("src", "dst", (F.col("links") + F.col("domains")).alias("weight"))
    trust = propagate(ahead, allowed, rounds=rounds).withColumnRenamed("rank", "trust")
    seeds = whole.union(named)
    if blocked_hosts is not None:
        seeds = seeds.union(blocked_hosts.select("host").where("host is not null"))
    seeds = stored(seeds.distinct(), "blocked")
    distrust = inherit(edges, seeds, rounds=rounds).withColumnRenamed("rank", "distrust")
    alone = seeds.join(allowed, "host", "left_anti").select("host", F.lit(True).alias("seed"))
    known = (hosts.select("host").join(trust, "host", "left").join(distrust, "host", "left")
             .join(fitted, "host", "left").join(alone, "host", "left")
             .na.fill(0.0, ["trust", "distrust"]).na.fill(False, ["seed"]))
    blocked = F.col("seed") | ((F.col("distrust") >= least_distrust)
                               & (F.col("distrust") > F.col("trust") / (1.0 - DAMPING)))
    judged = urls.join(known, "host").withColumn("r", F.when(F.col("rules").isNotNull(), first()))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
                         F.coalesce("r.verdict", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
                         "trust", "distrust")
