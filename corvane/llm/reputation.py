"""Empirical-Bayes host reputation, in DataFrame functions only.

Labelled pages of a host are good or bad.  Shares shrink through beta-binomial priors: all pages to suffix (last
label), suffix to registered domain (last two labels), domain to host.  Each level's prior weight comes from its own
between-group variance (ANOVA estimate of the intra-class correlation).  A page is blocked if the upper posterior
bound of its host's good share lies below ``threshold``; fixed rules by host and path come first, the longest wins.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ReputationConfig:
    #: (host, path, verdict); a rule fits its host and all subdomains where the path starts with the rule's.
    rules: tuple[tuple[str, str, str], ...] = ()
    #: Standard deviations of the posterior bound.
    deviations: float = 1.0
    threshold: float = 0.5
    #: Copies of each reputation, so that pages of one host meet it in as many tasks.
    salts: int = 16


#: The rules of the query.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.translate(host, UPPER, LOWER), F.regexp_extract(tail, "^[^?#]*", 0)


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _weight(groups: DataFrame, n: str, k: str) -> DataFrame:
    """One row: the prior weight of a level whose groups have k good pages of n."""
    total = groups.agg(F.count("*").alias("g"), F.sum(n).alias("N"), F.sum(k).alias("K"), F.sum(F.col(k) * F.col(k) / F.col(n)).alias("kk"), F.sum(F.col(n) * F.col(n)).alias("nn"))
    p = F.col("K") / F.col("N")
    within = p * (1 - p)
    spread = F.col("kk") - F.col("N") * p * p
    room = F.col("N") - F.col("nn") / F.col("N") - (F.col("g") - 1)
    rho = F.when((within > 0) & (room > 0), (spread - within * (F.col("g") - 1)) / (within * room)).otherwise(0.5)
    rho = F.round(F.least(F.greatest(rho, F.lit(0.01)), F.lit(0.99)), 9)
    return total.select(((1 - rho) / rho).alias("m"))


def reputations(labelled: DataFrame, config: ReputationConfig = ReputationConfig()) -> dict[str, DataFrame]:
    """Posterior upper bounds by level: host, domain, suffix, and one row for all; ``labelled`` has host and good (0/1)."""
    part = labelled.where("host <> '' and good is not null").select("host", F.regexp_extract("host", "[^.]*\\.[^.]*$", 0).alias("d"), F.regexp_extract("host", "[^.]*$", 0).alias("suffix"), F.col("good").cast("long").alias("good"))
    part = part.select("host", F.when(F.col("d") == "", F.col("host")).otherwise(F.col("d")).alias("domain"), "suffix", "good")
    hosts = part.groupBy("host", "domain", "suffix").agg(F.count("*").alias("n"), F.sum("good").alias("k"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    every = suffixes.agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    every = every.select(((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("mean"), F.lit(2.0).alias("m0"))

    def level(groups: DataFrame, above: DataFrame, on: list[str]) -> DataFrame:
        # one row of the level's weight joins each group; the level above has one row for each group's parent
        up = groups.join(above.select(*on, F.col("mean").alias("prior")), on) if on else groups.crossJoin(F.broadcast(above.select(F.col("mean").alias("prior"))))
        up = up.crossJoin(F.broadcast(_weight(groups, "n", "k")))
        mean = (F.col("k") + F.col("m") * F.col("prior")) / (F.col("n") + F.col("m"))
        return up.withColumn("mean", mean).withColumn("bound", F.least(F.lit(1.0), F.col("mean") + config.deviations * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("m") + 1))))

    s = level(suffixes, every, [])
    d = level(domains, s, ["suffix"])
    return {"host": level(hosts, d, ["domain", "suffix"]), "domain": d, "suffix": s}


def judge(pages: DataFrame, labels: DataFrame, config: ReputationConfig = ReputationConfig(RULES)) -> DataFrame:
    """(page_id, host, path, rule, verdict, bound) for each row of ``pages`` (page_id, url).

    ``labels`` (doc_id, quality) are the outcomes of the pages of the same number; repeated labels all count.  A host
    without labels has its domain's bound, else its suffix's, else none and is allowed, as are pages without a host.
    Nulls: a null url has empty host and path; a null quality counts as no label.
    """
    host, path = host_and_path(F.col("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), config.rules)
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    found = reputations(parts.join(labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good")), "page_id"), config)
    domain = F.regexp_extract("host", "[^.]*\\.[^.]*$", 0)
    out = parts.withColumn("domain", F.when(domain == "", F.col("host")).otherwise(domain)).withColumn("suffix", F.regexp_extract("host", "[^.]*$", 0))
    out = out.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(config.salts)))
    for name, table in found.items():
        copies = table.select(name, F.col("bound").alias(f"{name}_bound"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.salts - 1).cast("long"))).alias("salt"))
        out = out.join(copies, [name, "salt"], "left")
    bound = F.coalesce("host_bound", "domain_bound", "suffix_bound")
    own = F.when(bound < config.threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round(bound, 6).alias("bound"))
