"""URL filter: rules by host and path, and verdicts from trust and distrust that spread over host links (no Python)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

#: Host and path of each rule, and whether it blocks.
RULES = (("net", "/", True), ("example.net", "/en/", False), ("example.com", "/de/", True), ("org", "/fr/", False))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
HREF = r"""(?is)<a\s[^>]*?href\s*=\s*["']?\s*([^"'\s>]*)"""
BASE = r"""(?is)<base\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/"'?#\s>]+)"""
#: A link: its scheme and its host. A scheme without // (mail, script) leads to no host, and neither does a mere fragment.
SCHEME, LINK_HOST, NO_HOST = r"(?i)^([a-z][a-z0-9+.-]*):", r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]+)", r"(?i)^(?:#.*|[a-z][a-z0-9+.-]*:(?!//).*)?$"
WRITE_EVERY, DAMPING = 4, 0.85
#: A host is blocked at this many times the even share of distrust (1 over the number of hosts), if its trust is less.
LEAST_DISTRUST = 1.0
#: Ranks are spread until, of this limit, the summed change in WRITE_EVERY rounds is less than so much.
TOLERANCE = 0.001
SALTS = 32


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def parsed(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        lower_ascii(F.regexp_extract(url, URL, 1)).alias("host"),
        F.regexp_extract(url, URL, 2).alias("path"),
        *[c for c in ("html",) if c in pages.columns],
    )


def best_rule(rules) -> tuple[Column, Column]:
    """The longest rule that fits, and whether it blocks; null where none fits."""
    host, path = F.col("host"), F.col("path")
    name, blocks = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for at, below, block in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(below)
        name, blocks = F.when(fits, F.lit(at + below)).otherwise(name), F.when(fits, F.lit(block)).otherwise(blocks)
    return name, blocks


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between hosts, relative ones to the page's own host or that of its <base>, summed before the shuffle.

    A host's links to itself count: it votes for itself with them, as it does in its readers' walks.
    """
    html = F.coalesce("html", F.lit(""))
    home = F.regexp_extract(html, BASE, 1)
    links = pages.where("host != ''").select(
        F.col("host").alias("src"), F.when(home != "", home).otherwise(F.col("host")).alias("home"), F.explode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("href")
    )
    host = F.regexp_extract("href", LINK_HOST, 1)
    links = links.where(~F.col("href").rlike(NO_HOST)).select("src", lower_ascii(F.when(host != "", host).otherwise(F.col("home"))).alias("dst"))
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def shares(edges: DataFrame) -> DataFrame:
    """Each link twice: trust follows it, distrust goes against it; shares of a host's links sum to 1."""
    both = edges.select("src", "dst", "n", F.lit("trust").alias("kind")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit("distrust").alias("kind"))
    )
    total = both.groupBy("src", "kind").agg(F.sum("n").alias("total"))
    return both.join(total, ["src", "kind"]).select("src", "dst", "kind", (F.col("n") / F.col("total")).alias("share"))


def changed(before: DataFrame, after: DataFrame) -> float:
    """The larger of the two kinds' summed changes of scores."""
    both = after.unionByName(before.withColumn("score", -F.col("score"))).groupBy("host", "kind").agg(F.abs(F.sum("score")).alias("change"))
    return both.groupBy("kind").agg(F.sum("change").alias("change")).agg(F.max("change")).first()[0] or 0.0


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """host, kind, score: personalised PageRank of both kinds, seeds (host, kind, seed) summing to 1 for each kind.

    A host without links sends its score back to the seeds: the ranks of the walk that loses it are the same but for a
    factor, so they are scaled to sum to 1 at the end. Rounds go on until WRITE_EVERY of them change less than `tolerance`
    in sum, or for the given number of rounds. A round shrinks a change to DAMPING of it at least, so the scores are then
    off by about the tolerance in sum at most, before they are scaled (up to 1 / (1 - DAMPING) of it).
    """
    rank = before = seeds.select("host", "kind", F.col("seed").alias("score"))
    start = seeds.select("host", "kind", ((1 - DAMPING) * F.col("seed")).alias("score"))
    most = rounds or math.ceil(math.log(tolerance / 2) / math.log(DAMPING)) + 2 * WRITE_EVERY  # a change is 2 at first
    for k in range(1, most + 1):
        moved = rank.withColumnRenamed("host", "src").join(edges, ["src", "kind"]).select(F.col("dst").alias("host"), "kind", (DAMPING * F.col("score") * F.col("share")).alias("score"))
        rank = moved.unionByName(start).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        if k % WRITE_EVERY == 0 and k < most:
            rank = written(rank, "host-rank")
            settled = rounds is None and changed(before, rank) < tolerance
            if k > WRITE_EVERY:
                discard(before)
            before = rank
            if settled:
                break
    rank = written(rank, "host-rank")
    whole = {r.kind: r.whole for r in rank.groupBy("kind").agg(F.sum("score").alias("whole")).collect()}
    scale = F.when(F.col("kind") == "trust", whole.get("trust") or 1.0).otherwise(whole.get("distrust") or 1.0)
    return rank.select("host", "kind", (F.col("score") / scale).alias("score"))


def judge(pages: DataFrame, rules=RULES, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages (page_id, url, html).

    The longest rule that fits an url decides. Else the host decides: trust spreads along links from hosts with allowed
    pages, distrust against links from hosts with blocked pages, both by personalised PageRank, spread until it
    settles, with the seeds' shares of allowed and blocked pages; a host with at least LEAST_DISTRUST even shares of
    distrust and more distrust than trust is blocked. Relative links lead to the page's own host, or to that of its <base>;
    a host without links sends its score back to the seeds. A null url or one without :// has an empty host and path, no
    rule and the verdict allow; null html has no links. Repeated rows are judged row by row. Links are summed by host pair before any shuffle, and only hosts, not
    pages, take part in the rounds.
    """
    name, blocks = best_rule(rules)
    base = parsed(pages)
    ruled = base.drop("html").withColumn("rule", name).withColumn("_blocks", blocks)
    hosts = written(
        ruled.where("host != ''").groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("_blocks")).alias("blocked"), F.count_if(~F.col("_blocks")).alias("allowed")),
        "hosts",
    )
    n_hosts, blocked, allowed = hosts.agg(F.count("*"), F.sum(F.col("blocked") / F.col("n")), F.sum(F.col("allowed") / F.col("n"))).first()
    seeds = hosts.select("host", F.lit("trust").alias("kind"), (F.col("allowed") / F.col("n") / F.lit(allowed or 1.0)).alias("seed")).unionByName(
        hosts.select("host", F.lit("distrust").alias("kind"), (F.col("blocked") / F.col("n") / F.lit(blocked or 1.0)).alias("seed"))
    ).where("seed > 0")
    edges = written(shares(host_edges(base)), "host-links") if "html" in base.columns else None
    ranks = spread(edges, seeds, rounds, TOLERANCE * LEAST_DISTRUST / max(n_hosts, 1)) if edges is not None else seeds.withColumnRenamed("seed", "score")
    scores = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "distrust", F.col("score")).otherwise(0.0)).alias("distrust"),
        F.sum(F.when(F.col("kind") == "trust", F.col("score")).otherwise(0.0)).alias("trust"),
    )
    bad = scores.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") * F.lit(float(n_hosts)) >= LEAST_DISTRUST)).select("host", F.lit(True).alias("_bad"))
    # a host may have a large share of all pages: its pages are dealt to SALTS keys, and bad hosts are repeated for each
    salted = ruled.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
    out = salted.join(bad.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["host", "_salt"], "left")
    blocks_it = F.coalesce(F.col("_blocks"), F.col("_bad"), F.lit(False))
    return out.select("page_id", "host", "path", "rule", F.when(blocks_it, "block").otherwise("allow").alias("verdict"))
