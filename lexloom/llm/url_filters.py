"""URL filters: prefix rules, and link-graph propagation where no rule fits.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest fitting
rule decides. Hosts whose pages are nearly all allowed or blocked by rules are the seeds. Trust is
personalised PageRank from trusted seeds along the links between hosts, distrust the same from
blocked seeds against them, so who links to a blocked host is distrusted too. A host is blocked if its
distrust exceeds its trust by more than a threshold; its pages without a rule follow it.

Links are counted per pair of hosts before anything else moves, so iterations work on the host graph,
whose tables are written to the shared folder each round, until the ranks move by less than ``TOLERANCE`` in all. Mass of hosts
without links returns to the seeds; without any link between hosts, the ranks are the seeds, and no iteration runs.
Hosts that hold many links or pages are dealt over salts. Links are those of ``a``, ``area`` and ``link`` tags that name a host, and
those relative to the ``base`` of a page that names one; others stay on their page's host.

Defined results: null url, or one without ``://``, has an empty host and path, no rule and the verdict allow;
null html has no links; rows are judged one by one whatever their page_id, also repeated ones; of fitting rules of one length
(the same host and path, or a longer host with a shorter path) the one later in the list wins; an empty table gives an empty
result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: (verdict, host, path prefix), as the contract states them.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DAMPING, TOLERANCE, PURITY, THRESHOLD = 0.85, 1e-4, 0.9, 0.0
#: Rows (host, two ranks) that may be broadcast, and parts that a hot host is dealt into beyond that.
BROADCAST_HOSTS, SALTS = 50_000, 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HREF = r"""(?i)<(?:a|area|link)\s(?:[^>]*?\s)?href\s*=\s*["']?\s*([^"'\s>]+)"""
_BASE = r"""(?i)<base\s(?:[^>]*?\s)?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null. One condition a rule: for hundreds of rules, not millions."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(source, target, n) of links between different hosts."""
    base = F.when(F.col("html").contains("<base") | F.col("html").contains("<BASE"), F.regexp_extract("html", _BASE, 1))
    links = pages.select(host_of(F.col("url")).alias("source"), F.nullif(base, F.lit("")).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("href"))
    named = F.regexp_extract("href", "(?i)^(?:https?:)?//([^/?#]+)", 1)
    scheme = F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:")
    links = links.select("source", F.translate(F.when(named != "", named).when(~scheme, F.col("base")), _UPPER, _LOWER).alias("target"))
    links = links.filter("source <> '' and target <> '' and source <> target")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def _every_salt():
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind's graph (kind, source, target, n) from its seeds (kind, host, seed); ranks of a kind sum to 1.

    Rounds go on until all ranks together move by less than ``tolerance``; each shrinks the movement by ``damping``.
    """
    salted = links.withColumn("salt", F.pmod(F.xxhash64("target"), F.lit(SALTS)).cast("int"))
    total = links.groupBy("kind", "source").agg(F.sum("n").alias("out")).withColumn("salt", _every_salt())
    edges = C.stored(salted.join(total, ["kind", "source", "salt"]).select("kind", "source", "target", "salt", (F.col("n") / F.col("out")).alias("share")), "links")
    if not edges.limit(1).count():
        C.release(edges)
        return seeds.select("kind", "host", F.col("seed").alias("rank"))
    ends = edges.select("kind", F.col("source").alias("host"), F.lit(True).alias("out")).union(edges.select("kind", F.col("target").alias("host"), F.lit(False)))
    nodes = ends.union(seeds.select("kind", "host", F.lit(False))).groupBy("kind", "host").agg(F.bool_or("out").alias("out")).join(seeds, ["kind", "host"], "left")
    seed = F.coalesce("seed", F.lit(0.0))
    ranks = C.stored(nodes.select("kind", "host", "out", seed.alias("seed"), seed.alias("rank"), F.lit(1.0).alias("moved")), "ranks")
    while True:
        # one row a kind: what the last round moved, and the mass that links carry on
        state = ranks.groupBy("kind").agg(F.sum("moved").alias("moved"), F.sum(F.when(F.col("out"), F.col("rank")).otherwise(0.0)).alias("held")).collect()
        if sum(r["moved"] for r in state) < tolerance:
            C.release(edges)
            return C.renewed(ranks.select("kind", "host", "rank"), ranks)
        back = F.lit(1.0)
        for r in state:
            back = F.when(F.col("kind") == r["kind"], F.lit(1.0 - r["held"])).otherwise(back)
        given = ranks.select("kind", F.col("host").alias("source"), "rank", _every_salt().alias("salt"))
        taken = edges.join(given, ["kind", "source", "salt"]).groupBy("kind", F.col("target").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("taken"))
        new = damping * (F.coalesce("taken", F.lit(0.0)) + back * F.col("seed")) + (1 - damping) * F.col("seed")
        nxt = ranks.join(taken, ["kind", "host"], "left").select("kind", "host", "out", "seed", new.alias("new"), F.col("rank").alias("old"))
        nxt = C.stored(nxt.select("kind", "host", "out", "seed", F.col("new").alias("rank"), F.abs(F.col("new") - F.col("old")).alias("moved")), "ranks")
        C.release(ranks)
        ranks = nxt


def host_scores(pages: DataFrame, judged: DataFrame, purity: float = PURITY, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust). ``judged`` (host, ruled) has the rules' verdict, or null, of every page."""
    per = judged.filter("host <> ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    kinds = per.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), "host", "n", F.col("good").alias("hits")), F.struct(F.lit("distrust").alias("kind"), "host", "n", F.col("bad").alias("hits")))).alias("k")).select("k.*")
    seeds = kinds.filter((F.col("hits") > 0) & (F.col("hits") >= purity * F.col("n")))
    mass = seeds.groupBy("kind").agg(F.sum("hits").alias("all"))
    seeds = C.stored(seeds.join(mass, "kind").select("kind", "host", (F.col("hits") / F.col("all")).alias("seed")), "seeds")
    links = host_links(pages)
    both = links.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("source"), F.col("target"), "n"), F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("source"), F.col("source").alias("target"), "n"))).alias("k")).select("k.*")
    ranks = propagate(both, seeds, damping, tolerance)
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == "trust", F.col("rank")).otherwise(0.0)).alias("trust"), F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, purity: float = PURITY) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    judged = judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    with C.scratch() as keep:
        scores = C.stored(host_scores(pages, judged, purity), "scores")
        keep.append(scores)
    if scores.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        out = judged.join(F.broadcast(scores), "host", "left")
    else:  # a host may hold a third of all pages
        out = judged.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(scores.withColumn("salt", _every_salt()), ["host", "salt"], "left")
    out = out.withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    method = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "trust", "distrust")


def op7_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(C.table(spark, sf_dir, "pages")).drop("trust", "distrust")
