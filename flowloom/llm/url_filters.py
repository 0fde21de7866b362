"""URL filters: path rules first, then the reputation of the host by empirical Bayes.

Method: labelled outcomes of pages (bad or not) are added up per host, registered domain
and suffix.  A suffix gets the corpus rate as the mean of its beta prior, a domain the
posterior mean of its suffix, a host that of its domain; the weight of each prior comes
from how far the groups of that level are spread (method of moments, bounded).  A host is
blocked if the lower bound of its bad rate lies above the limit: few outcomes stay near
their prior and are not blocked.

DataFrame functions only.  Defined results: a null url or one without `://` has empty host
and path, no rule, and is judged like an empty host without outcomes; hosts, domains and
suffixes without outcomes inherit; without any outcome the rate is 0; repeated rows count
as so many pages; repeated outcomes of one page count once, bad if any is bad.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.stage import materialize

# Fixed values: (verdict, host, path); a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Suffixes of two labels.
TWO_LABELS = ("co.uk", "org.uk", "ac.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz")


@dataclass(frozen=True)
class Reputation:
    #: Share of bad pages above which a host is blocked, with this many standard deviations of the posterior to spare.
    bad_rate: float = 0.5
    deviations: float = 1.645
    least_weight: float = 2.0
    most_weight: float = 200.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABELS), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null without one."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _posterior(groups: DataFrame, key: str, how: Reputation) -> DataFrame:
    """Adds mean and variance of the beta posterior to groups of one level with pages, bad and prior.

    The weight of the prior is the same for the whole level, 1 / r - 1, where r is the part
    of the spread of the group rates that binomial noise does not explain.
    """
    rate, prior = F.col("bad") / F.col("pages"), F.col("prior")
    noise = prior * (1 - prior) / F.col("pages")
    sums = groups.filter("pages > 0").agg(
        F.sum(F.col("pages") * ((rate - prior) * (rate - prior) - noise)).alias("extra"),
        F.sum(F.col("pages") * prior * (1 - prior)).alias("whole"),
    )
    extra, whole = sums.first()  # two numbers
    weight = min(max(whole / extra - 1, how.least_weight), how.most_weight) if extra and extra > 0 else how.most_weight
    a, n = prior * weight + F.col("bad"), F.col("pages") + weight
    return groups.select(F.col(key), (a / n).alias("mean"), (a * (n - a) / (n * n * (n + 1))).alias("variance"))


def reputations(pages: DataFrame, outcomes: DataFrame, how: Reputation = Reputation()) -> DataFrame:
    """(host, mean, variance, blocked), written; pages: (page_id, host), outcomes: (page_id, bad 0/1)."""
    known = outcomes.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = pages.join(known, "page_id", "left").groupBy("host").agg(F.count("bad").alias("pages"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "url-hosts")
    counts = [F.sum("pages").alias("pages"), F.sum("bad").alias("bad")]
    seen, bad = hosts.agg(*counts).first()
    rate = float(bad) / seen if seen else 0.0
    suffixes = materialize(_posterior(hosts.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(rate)), "suffix", how), "url-suffixes")
    domains = hosts.groupBy("domain", "suffix").agg(*counts).join(suffixes.select("suffix", F.col("mean").alias("prior")), "suffix")
    domains = materialize(_posterior(materialize(domains, "url-domain-counts"), "domain", how), "url-domains")
    own = materialize(hosts.join(domains.select("domain", F.col("mean").alias("prior")), "domain"), "url-host-counts")
    bound = F.col("mean") - how.deviations * F.sqrt("variance")
    return materialize(_posterior(own, "host", how).withColumn("blocked", bound > how.bad_rate), "url-reputations")


def url_filters(pages: DataFrame, outcomes: DataFrame, rules=RULES, how: Reputation = Reputation()) -> DataFrame:
    """page_id, host, path, rule, verdict, and the expected bad rate of the host, for every row of `pages`."""
    url = F.col("url")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = reputations(split.select("page_id", "host"), outcomes, how)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return (
        split.join(hosts, "host", "left")
        .withColumn("fit", rule)
        .select(
            "page_id", "host", "path", F.col("fit.rule").alias("rule"),
            F.coalesce("fit.verdict", F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"),
            F.col("mean").alias("host_bad_rate"),
        )
    )
