"""URL filters: rules by host and path, and trust spread over the link graph for the rest.

Rules decide the urls that they fit.  A host with a page that a rule allows
(blocks) is a trusted (blocked) seed.  Personalised PageRank runs from the
trusted seeds along host links, and distrust runs from the blocked seeds
against them (a host that links to a blocked one is suspect).  A page that no
rule fits is blocked if its host's distrust exceeds ``threshold`` times its
trust, else allowed.

Hosts link by absolute ``href`` and ``src`` targets in their pages, and, with
``site_links``, a host and the host named by dropping its first label link
each other, if both have pages.  Scores are whole numbers of ``UNIT`` parts,
so the order of sums doesn't matter, and decimals, as a host that many seeds
link to has more than a long holds.

Null urls, and those without ``://``, have an empty host and path, fit no
rule and are allowed; a null html has no links.  Repeated rows are judged
alike and count once as links.  An empty table gives no rows.  Other columns
are left out unless ``keep`` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import materialize

#: Of scores while they spread.
WIDE = "decimal(38,0)"
#: Parts of a seed's own score.
UNIT = 10**12
#: Share of a score that links pass on in a round, in hundredths.
DAMPING = 85
ROUNDS = 8
#: Distrust over trust from which a host without a rule is blocked.
THRESHOLD = 1.0

LINK = r"""(?i)(?:href|src)\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (name, verdict) of the longest rule that fits, null if none does."""
    out = F.when(F.lit(False), F.struct(F.lit("").alias("name"), F.lit("").alias("verdict")))
    for r in sorted(rules, key=lambda r: (-len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = out.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
    return out


def host_links(pages: DataFrame, site_links: bool) -> DataFrame:
    """Distinct (src, dst) of different hosts; pages: host, html."""
    targets = F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)), lower_ascii))
    links = pages.filter(F.col("html").contains("://")).select(F.col("host").alias("src"), F.explode(targets).alias("dst"))
    if site_links:
        hosts = pages.select("host").distinct()
        up = hosts.select("host", F.regexp_replace("host", r"^[^.]*\.", "").alias("site")).filter("host != site")
        both = up.join(hosts.select(F.col("host").alias("site")), "site")
        links = links.unionByName(both.select(F.col("host").alias("src"), F.col("site").alias("dst"))) \
            .unionByName(both.select(F.col("site").alias("src"), F.col("host").alias("dst")))
    return links.filter("src != '' and dst != '' and src != dst").distinct()


def spread(seeds: DataFrame, links: DataFrame, rounds: int, damping: int) -> DataFrame:
    """Personalised PageRank of (host, own) over (src, dst): (host, score); hosts that nothing reaches are left out.

    Only distinct host pairs are joined, and what a host receives is summed
    before it is shuffled, so a host that everything links to is no hot key.
    Scores are ``WIDE``; a quotient's remainder is taken off first, so that it
    is whole and no division rounds.
    """
    quotient = lambda a, b: F.expr(f"(({a}) - ({a}) % ({b})) / ({b})").cast(WIDE)
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    links = materialize(links.join(degrees, "src"), "links")
    score = seeds.select("host", (F.col("own").cast(WIDE) * UNIT).cast(WIDE).alias("score"))
    for k in range(rounds):
        sent = links.join(score.withColumnRenamed("host", "src"), "src") \
            .select(F.col("dst").alias("host"), quotient(f"score * {damping}", "100 * n").alias("score")).filter("score > 0")
        own = seeds.select("host", quotient(f"cast(own as {WIDE}) * {UNIT} * {100 - damping}", "100").alias("score"))
        score = sent.unionByName(own).groupBy("host").agg(F.sum("score").cast(WIDE).alias("score"))
        if k % 4 == 3:
            score = materialize(score, f"score-{k}")
    return score


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url", html: str = "html",
          keep: tuple[str, ...] = ("page_id",), rounds: int = ROUNDS, damping: int = DAMPING,
          threshold: float = THRESHOLD, site_links: bool = True) -> DataFrame:
    """The kept columns, ``host``, ``path``, ``rule``, ``verdict``, ``trust`` and ``distrust`` (``WIDE``, of ``UNIT``) of each row."""
    own = [c for c in dict.fromkeys(keep) if c not in ["host", "path", "rule", "verdict", "trust", "distrust"]]
    parts = lambda *more: pages.select(url_host(pages[url]).alias("host"), url_path(pages[url]).alias("path"), *more)
    found = matched_rule(F.col("host"), F.col("path"), rules)
    judged = parts(*[pages[c] for c in own]).withColumn("r", found)
    seeds = parts().withColumn("r", found).filter("r is not null and host != ''").groupBy("host").agg(
        F.max((F.col("r.verdict") == "allow").cast("long")).alias("allow"),
        F.max((F.col("r.verdict") == "block").cast("long")).alias("block"))
    seeds = materialize(seeds, "seeds")
    links = materialize(host_links(parts(pages[html].cast("string").alias("html")), site_links), "host-links")
    trust = spread(seeds.filter("allow = 1").select("host", F.lit(1).alias("own")), links, rounds, damping)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    distrust = spread(seeds.filter("block = 1").select("host", F.lit(1).alias("own")), back, rounds, damping)
    both = trust.select("host", F.col("score").alias("trust"), F.lit(0).cast(WIDE).alias("distrust")).unionByName(
        distrust.select("host", F.lit(0).cast(WIDE).alias("trust"), F.col("score").alias("distrust")))
    scores = materialize(both.groupBy("host").agg(F.sum("trust").cast(WIDE).alias("trust"), F.sum("distrust").cast(WIDE).alias("distrust")), "host-scores")
    return judged.join(scores, "host", "left").select(
        *own, "host", "path", F.col("r.name").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("distrust") > F.col("trust") * F.lit(threshold), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0)).cast(WIDE).alias("trust"), F.coalesce("distrust", F.lit(0)).cast(WIDE).alias("distrust"))
