"""URL filter by link-graph propagation.

Hosts are judged by two personalised PageRanks over the host graph: trust flows
along links from the hosts of allowed pages, distrust flows against the links
from the hosts of blocked pages (who links to a blocked host is suspect).  Both
walks restart at their seeds.  A rank is measured against the host's own share
of pages; a host is blocked if its distrust passes both ``threshold`` and its trust.

A page's rule, where one fits, decides the page itself; the propagated verdict
decides the others.

DataFrame operations only.  Edges are counted per pair of hosts before they are
shuffled; every round is written to the shared folder.  Rounds go on until no rank can change by more
than ``TOLERANCE`` pages.  Hosts with a thousandth of all links, or of all pages, are a
thousand at most: their ranks are broadcast, their pages get the verdict as a literal, and pages
with a rule are not shuffled at all.

Cases: a null url or one without ``://`` has an empty host and path, no rule
and no rank, and is allowed; null pages have no links; links to the page's own
host are not edges; a host without links keeps its seed's rank; repeated pages
count each; an empty table gives an empty result.  Work columns carry a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm._common import discard, materialize, salted_join

DAMPING = 0.85
#: Share of a host's pages that must count as distrusted.
THRESHOLD = 0.5
#: Pages by which a host's trust or distrust may be off, whatever the number of pages.
TOLERANCE = 1e-4
#: A host is a hub from this many rows and this share of them on, so hubs are at most 1 / ``HUB_SHARE``.
HUB_ROWS, HUB_SHARE = 1000, 1e-3


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, paths from ``path`` on; ``verdict`` is allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct of name and verdict; null without one."""
    out = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src``, ``dst`` and the number of links between different hosts."""
    links = F.regexp_extract_all(F.col(html_col), F.lit(r"(?is)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(links).alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("x:"), "href")).otherwise(F.col("href")))
    return found.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def hub_limit(rows: int | None) -> float:
    """The number of rows of one host beyond which it is a hub."""
    return max(HUB_ROWS, HUB_SHARE * (rows or 0))


def propagate(seeds: DataFrame, edges: DataFrame, scale: dict[str, int], damping: float = DAMPING, tolerance: float = TOLERANCE, max_rounds: int = 1000) -> DataFrame:
    """Personalised PageRank of several kinds at once: ``kind``, ``host``, ``rank``.

    ``seeds`` (kind, host, seed) sums to 1 per kind, with a row for every node;
    ``edges`` (kind, src, dst, share) sums to 1 per kind and src.  What
    reaches a node without edges returns to the seeds.

    ``scale`` has the pages that a rank of 1 stands for, by kind.  A round
    shrinks what moves by ``damping`` at least, so all later rounds together
    move no rank by more than the last round's sum times damping / (1 - damping);
    the rounds end once that is within ``tolerance`` pages for each kind.
    Where that is not reached (doubles may not, beyond some 10^10 pages of a kind) it raises.
    """
    ends = edges.select("kind", F.col("src").alias("host")).distinct().withColumn("linked", F.lit(True))
    fixed = materialize(seeds.join(ends, ["kind", "host"], "left").select("kind", "host", "seed", F.coalesce("linked", F.lit(False)).alias("linked")), "nodes")
    state = materialize(fixed.withColumn("rank", F.col("seed")).withColumn("moved", F.lit(1.0)), "rank")
    flow = materialize(edges, "flow")
    # A hub's edges meet its rank by a broadcast of the hubs' ranks; no task holds them all.
    out = flow.groupBy("kind", "src").agg(F.count("*").alias("n"))
    hubs = materialize(out.where(F.col("n") > hub_limit(flow.count())).select("kind", "src"), "hubs")
    has_hubs = not hubs.isEmpty()
    cool, hot = (flow.join(F.broadcast(hubs), ["kind", "src"], how) for how in ("left_anti", "left_semi")) if has_hubs else (flow, None)
    # Two numbers per kind: the rank held by nodes without edges, and what the last round moved.
    tally = lambda t: t.groupBy("kind").agg(F.sum(F.when(F.col("linked"), 0.0).otherwise(F.col("rank"))).alias("held"), F.sum("moved").alias("moved")).collect()
    now = tally(state)
    for _ in range(max_rounds):
        ranks = state.select("kind", F.col("host").alias("src"), "rank")
        met = cool.join(ranks, ["kind", "src"])
        if has_hubs:
            met = met.unionByName(hot.join(F.broadcast(ranks.join(F.broadcast(hubs), ["kind", "src"])), ["kind", "src"]))
        sent = met.groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        back = F.lit(0.0)
        for r in now:
            back = F.when(F.col("kind") == r["kind"], F.lit(float(r["held"] or 0.0))).otherwise(back)
        new = (1 - damping) * F.col("seed") + damping * (F.coalesce("got", F.lit(0.0)) + back * F.col("seed"))
        after = materialize(state.join(sent, ["kind", "host"], "left").select("kind", "host", "seed", "linked", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")), "rank")
        discard(state)
        state, now = after, tally(after)
        if all((r["moved"] or 0.0) * scale[r["kind"]] * damping <= tolerance * (1 - damping) for r in now):
            break
    else:
        raise RuntimeError(f"ranks did not settle in {max_rounds} rounds")
    for done in (flow, hubs, fixed):
        discard(done)
    out = state.select("kind", "host", "rank")
    out._folio_path = state._folio_path  # for ``discard``
    return out


def judge_hosts(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, damping: float = DAMPING) -> DataFrame:
    """One row per host of a page, as a written table: ``host``, ``pages``, ``trust``, ``distrust``, ``blocked``.

    Ranks are scaled so that a host whose own seeds only came back to it has
    its share of allowed, or blocked, pages.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    judged = pages.select(host.alias("host"), matching_rule(host, path, rules)["verdict"].alias("v")).where("host <> ''")
    per_host = materialize(judged.groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("v") == "allow").alias("allow"), F.count_if(F.col("v") == "block").alias("block")), "hosts")
    links = materialize(host_edges(pages, url_col, html_col), "links")
    totals = per_host.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    far = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct()
    nodes = far.join(per_host, "host", "full").select("host", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("allow", "block")))
    seed = lambda kind, count: nodes.select(F.lit(kind).alias("kind"), "host", (F.col(count) / F.lit(max(1, totals[count] or 0))).alias("seed"))
    seeds = seed("trust", "allow").union(seed("distrust", "block"))

    def shares(kind: str, src: str, dst: str) -> DataFrame:
        out = links.groupBy(src).agg(F.sum("links").alias("all"), F.count("*").alias("n"))
        return salted_join(links, out, src, F.col(dst), "n").select(F.lit(kind).alias("kind"), F.col(src).alias("src"), F.col(dst).alias("dst"), (F.col("links") / F.col("all")).alias("share"))

    ranks = propagate(seeds, shares("trust", "src", "dst").union(shares("distrust", "dst", "src")), {"trust": totals["allow"] or 0, "distrust": totals["block"] or 0}, damping)
    wide = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank"))).alias("t"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank"))).alias("d"))
    scaled = per_host.join(wide, "host").select("host", "pages", (F.col("t") * (totals["allow"] or 0) / F.col("pages")).alias("trust"), (F.col("d") * (totals["block"] or 0) / F.col("pages")).alias("distrust"))
    out = materialize(scaled.withColumn("blocked", (F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust"))), "judged")
    for done in (ranks, links, per_host):
        discard(done)
    return out


def filter_urls(pages: DataFrame, rules: list[Rule], keep: list[str] | None = None, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` (all, by default) of every page with ``folio_host``, ``folio_path``, ``folio_rule`` and ``folio_verdict``."""
    hosts = judge_hosts(pages, rules, url_col, html_col, threshold)
    limit = hub_limit(hosts.agg(F.sum("pages")).first()[0])
    hubs = {r["host"]: r["blocked"] for r in hosts.where(F.col("pages") > limit).select("host", "blocked").collect()}
    bad_hubs = [h for h, blocked in hubs.items() if blocked]
    kept = list(keep if keep is not None else pages.columns)
    host = F.col("folio_host")
    named = pages.select(*kept, host_of(F.col(url_col)).alias("folio_host"), path_of(F.col(url_col)).alias("folio_path"))
    ruled = named.withColumn("folio_r", matching_rule(host, F.col("folio_path"), rules))
    # Pages with a rule, without a host or of a hub need no row of ``hosts``: they pass the join by.
    settled = F.col("folio_r").isNotNull() | (host == "") | host.isin(list(hubs))
    by_host = ruled.where(settled).withColumn("folio_blocked", host.isin(bad_hubs))
    bad = hosts.where("blocked").select(F.col("host").alias("folio_host"), F.lit(True).alias("folio_blocked"))
    judged = by_host.unionByName(ruled.where(~settled).join(bad, "folio_host", "left"))
    verdict = F.coalesce(F.col("folio_r.verdict"), F.when(F.col("folio_blocked"), "block").otherwise("allow"))
    return judged.select(*kept, "folio_host", "folio_path", F.col("folio_r.name").alias("folio_rule"), verdict.alias("folio_verdict"))
