"""URL filters: host rules, and host reputation by empirical Bayes.

Labelled pages give each host a number of outcomes and of good ones. A host's rate of good pages is
shrunk towards its registered domain's, the domain's towards its suffix's, the suffix's towards the
rate of all: at every level a beta prior is centred on the level above, and its strength is
estimated from how much the rates of that level differ (method of moments of the beta-binomial).
The verdict takes an upper bound of the posterior: a host is blocked when even that is below the
wanted rate, so hosts that little is known of are judged by their domain and suffix, and allowed
unless these are bad.

Outcomes are counted per host before anything is shuffled, so a host with a third of all pages
sends one row a task; the tables above have one row per domain and suffix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlens.llm.text import ascii_lower
from rosterlens.session import stage

# fixed values: suffixes of more than one label that count as one
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "co.nz", "com.br", "co.in", "com.cn")
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
WANTED = 0.8
DEVIATIONS = 1.645
STRENGTH = (1.0, 10_000.0)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null and urls without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits the host or a parent of it and the beginning of the path; null where none fits."""
    pick = F.lit(None).cast("struct<rule: string, verdict: string>")
    for domain, start, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r[0] + r[1])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        pick = F.when(fits, F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(pick)
    return pick


def suffix_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The last label of a host, or the last two where they are a known suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label more, as far as the host has one."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*long_suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the strength of the beta prior from (n, good, center) of the groups, by moments.

    The squared differences of the groups' rates from their centers are what binomial noise and the
    prior's spread add up to: E[n^2 (p - m)^2] = m (1 - m) n (1 + (n - 1) rho), rho = 1 / (strength + 1).
    """
    noise = F.col("center") * (1 - F.col("center")) * F.col("n")
    seen = F.pow(F.col("good") - F.col("n") * F.col("center"), 2)
    sums = groups.agg(F.sum(seen).alias("seen"), F.sum(noise).alias("noise"), F.sum(noise * (F.col("n") - 1)).alias("pairs"))
    rho = (F.col("seen") - F.col("noise")) / F.col("pairs")
    strength = F.when(F.col("pairs") > 0, F.when(rho > 0, 1 / rho - 1).otherwise(STRENGTH[1])).otherwise(STRENGTH[0])  # no pairs: nothing is known
    return sums.select(F.least(F.lit(STRENGTH[1]), F.greatest(F.lit(STRENGTH[0]), F.coalesce(strength, F.lit(STRENGTH[0])))).alias("strength"))


def _shrunk(groups: DataFrame, parents: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, mean, weight): posterior means of groups (key, parent, n, good) whose prior is their parent's mean."""
    centered = groups.join(parents.select(F.col(parent), F.col("mean").alias("center")), parent)
    with_strength = centered.crossJoin(F.broadcast(_strength(centered)))  # one row
    weight = F.col("n") + F.col("strength")
    return with_strength.select(key, parent, ((F.col("good") + F.col("strength") * F.col("center")) / weight).alias("mean"), weight.alias("weight"))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, mean, bound): the posterior of every host of (host, n, good) rows, with n = 0 for hosts without outcomes.

    Without any outcome the mean is 1 / 2 with the bound 1.
    """
    hosts = stage(outcomes.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("root", F.lit(0))
    root = suffixes.groupBy("root").agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("mean"))
    by_suffix = stage(_shrunk(suffixes, root, "suffix", "root"), "suffixes")
    by_domain = stage(_shrunk(domains, by_suffix, "domain", "suffix"), "domains")
    by_host = _shrunk(hosts, by_domain, "host", "domain")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("weight") + 1))
    return by_host.select("host", "mean", F.least(F.lit(1.0), F.col("mean") + DEVIATIONS * spread).alias("bound"))


def judged(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, wanted: float = WANTED) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url).

    A labelled page is good when its quality is 1 and it is not toxic; labels belong to pages by
    ``doc_id`` = ``page_id``, and several labels of one id count as good when all are. Null urls
    and urls without ``://`` have an empty host and path, fit no rule, and share the reputation of
    the empty host. Repeated rows repeat, and count as outcomes each. No pages give no rows; no
    labels allow every host. Further columns are ignored.
    """
    good = (F.coalesce(F.col("quality"), F.lit(0)) == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(good.cast("long")).alias("good"))
    rows = stage(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), "page-hosts")
    marked = rows.select("page_id", "host").join(known.withColumnRenamed("doc_id", "page_id"), "page_id", "left")
    outcomes = marked.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    method = stage(reputations(outcomes), "reputations").select("host", F.when(F.col("bound") < wanted, "block").otherwise("allow").alias("by_method"))
    picked = rows.withColumn("picked", matching_rule(F.col("host"), F.col("path"), rules)).join(method, "host")
    return picked.select("page_id", "host", "path", F.col("picked.rule").alias("rule"), F.coalesce("picked.verdict", "by_method").alias("verdict"))
