"""URL filter: path rules first, then empirical-Bayes reputation of hosts.

The labelled outcomes of pages (good or not) are counted by host. A beta-binomial prior flows down: all pages to a suffix, a suffix to
its registered domains, a domain to its hosts. At each level the prior's mean is the parent's posterior mean, and its strength (in
pages) is estimated from how much the children's rates spread. A host is allowed if the lower bound of its posterior reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, without

#: Fixed values: (verdict, host and path prefix) of the production rules.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Public suffixes of two labels; any other suffix is the last label.
LONG_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "gov.uk", "org.uk")

#: Suffixes of which a table may be broadcast: about 50 bytes each.
BROADCAST_SUFFIXES = 1 << 17

Z, THRESHOLD, LEAST_STRENGTH, MOST_STRENGTH = 1.28, 0.5, 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if there is none or the url is null."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host or a subdomain of it, path by prefix) and its verdict; null if none. Among rules of one length the first wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, rule in sorted(reversed(rules), key=lambda r: len(r[1])):  # a later one overrides
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def suffix_of(host: Column) -> Column:
    labels = F.split(host, r"\.")
    two = F.array_join(F.slice(labels, -2, 2), ".")
    return F.when((F.size(labels) > 1) & two.isin(*LONG_SUFFIXES), two).otherwise(F.element_at(labels, -1))


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and the label before it, or the host itself if it has no more."""
    labels = F.split(host, r"\.")
    n = F.size(F.split(suffix_of(host), r"\.")) + 1
    return F.when(F.size(labels) <= n, host).otherwise(F.array_join(F.slice(labels, -n, n), "."))


def reputation(outcomes: DataFrame, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """(host, domain, suffix, k, n, mean, bound, good) of every host in outcomes(host, good): good is null for pages without a label.

    n pages of the host have a label, k of them good. mean is the posterior mean, bound = mean - z standard deviations of the posterior,
    good = bound >= threshold. Hosts without labels get their domain's prior. Without any labels the prior is one good and one bad page.
    """
    hosts = outcomes.groupBy("host").agg(F.sum(F.when(F.col("good"), 1).otherwise(0)).alias("k"), F.count("good").alias("n"))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(*_sums()), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(*_sums()), "suffixes")
    total = suffixes.agg(*_sums())
    top = total.select(((F.coalesce("k", F.lit(0)) + 1) / (F.coalesce("n", F.lit(0)) + 2)).alias("mean"), *total.columns).withColumn("strength", _strength(F.col("mean"))).first()
    known = suffixes.withColumn("mean", _mean(F.lit(top["mean"]), F.lit(top["strength"])))
    known = known.select("suffix", F.col("mean").alias("prior"), _strength(F.col("mean")).alias("weight"))
    known = F.broadcast(known) if suffixes.count() <= BROADCAST_SUFFIXES else known
    known = domains.join(known, "suffix").withColumn("mean", _mean(F.col("prior"), F.col("weight")))
    known = known.select("domain", F.col("mean").alias("prior"), _strength(F.col("mean")).alias("weight"))
    level = hosts.join(known, "domain").withColumn("mean", _mean(F.col("prior"), F.col("weight")))
    bound = F.col("mean") - z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("weight") + 1))
    level = stored(level.withColumn("bound", bound).select("host", "domain", "suffix", "k", "n", "mean", "bound", (F.col("bound") >= threshold).alias("good")), "reputation")
    discard(hosts, domains, suffixes)
    return level


def _sums() -> list[Column]:
    """Of children(k, n): good and labelled pages, squares of the latter, children with labelled pages, and k * k / n."""
    k, n = F.col("k").cast("double"), F.col("n").cast("double")
    labelled = F.col("n") > 0
    return [F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum(n * n).alias("squares"), F.count(F.when(labelled, 1)).alias("c"), F.sum(F.when(labelled, k * k / n).otherwise(0.0)).alias("kk")]


def _mean(prior: Column, strength: Column) -> Column:
    """Posterior mean of k good of n pages."""
    return (F.col("k") + strength * prior) / (F.col("n") + strength)


def _strength(prior: Column) -> Column:
    """Pages that the prior counts for, by the spread of the children's rates around it: sum of n * (k / n - prior)^2 = kk - 2 * prior * k + prior^2 * n."""
    spread, noise = F.col("kk") - 2 * prior * F.col("k") + prior * prior * F.col("n"), prior * (1 - prior)
    room = F.when(F.col("n") > 0, F.col("n") - F.col("squares") / F.col("n"))
    between = F.when(room > 0, (spread - (F.col("c") - 1) * noise) / room)
    return F.least(F.greatest(F.when(between > 0, noise / between - 1).otherwise(F.lit(MOST_STRENGTH)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, good: Column | None = None, url: str = "url", z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """pages with host, path, rule, verdict (allow or block), mean and bound of the host's reputation.

    good: a boolean column over pages, null where a page has no label; by default a page that a rule fits is labelled by its verdict.
    A rule's verdict stands; any other page gets its host's. Null urls and urls without :// have empty host and path, and are judged as
    one host of that name. Repeated rows count as often as they occur. Input columns with the added names give way.
    """
    pages = without(pages, ["host", "path", "rule", "verdict", "mean", "bound"])
    parsed = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumn("rule", name).withColumn("__verdict", verdict)
    labelled = ruled.select("host", (F.col("__verdict") == "allow" if good is None else good).alias("good"))
    hosts = reputation(labelled, z, threshold).select("host", "mean", "bound", "good")
    judged = ruled.join(hosts.withColumnRenamed("good", "__good"), "host")
    return judged.withColumn("verdict", F.coalesce("__verdict", F.when(F.col("__good"), "allow").otherwise("block"))).select(*pages.columns, "host", "path", "rule", "verdict", "mean", "bound")
