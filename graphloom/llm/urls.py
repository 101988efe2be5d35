"""URL filters: explicit rules first, then empirical-Bayes host reputation.

Labelled pages give each host its good and bad outcomes.  Rates are shrunk level by level: the suffix towards the
overall rate, the registered domain towards its suffix, the host towards its domain, each as the mean of a beta prior
whose strength comes from the spread between the groups of that level (method of moments for the beta-binomial).
A host is blocked when the lower posterior bound of its bad rate exceeds ``max_bad``: few or no labels do not block.
All statistics are counts per host, pre-aggregated before any shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialise

# Labels under which countries register names; with a country's two letters they are a suffix.
SECOND_LEVEL = "ac asn co com edu go gob gouv gov gv id info ltd me mil ne net nhs nom or org plc police press pro res sch tm web".split()
TWO_LABELS = rf"^({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*\])$"
MAX_BAD, Z = 0.5, 1.645
MIN_STRENGTH, MAX_STRENGTH = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ?, # or the end, A-Z lowered; empty for null or no ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """The host without user and port: what is registered."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def suffix_of(host: Column) -> Column:
    """The registry's part of a host: a country's two labels, else the last label; of an address, all of it."""
    name, two = name_of(host), F.substring_index(name_of(host), ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.rlike(TWO_LABELS), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column) -> Column:
    """The suffix and the label before it."""
    name, two = name_of(host), F.substring_index(name_of(host), ".", -2)
    return F.when(name.rlike(ADDRESS), name).when(two.rlike(TWO_LABELS), F.substring_index(name, ".", -3)).otherwise(two)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null.  A rule is host/path; it fits its host and all
    subdomains if the path starts with the rule's."""

    def fits(rule: str) -> Column:
        h, _, p = rule.partition("/")
        return ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))

    order = sorted(rules, key=lambda r: len(r[1]))
    return reduce(lambda rest, r: F.when(fits(r[1]), F.struct(F.lit(r[0]).alias("verdict"), F.lit(r[1]).alias("rule"))).otherwise(rest), order, F.lit(None).cast("struct<verdict:string,rule:string>"))


def _strength(groups: DataFrame) -> float:
    """Beta-binomial prior strength by moments from groups with n, k and the prior mean ``prior``."""
    p = F.col("prior")
    seen = F.col("k") / F.col("n") - p
    r = groups.where("n > 0").agg(F.sum(F.col("n") * seen * seen), F.sum(p * (1 - p)), F.sum(F.col("n") * p * (1 - p)), F.count("*")).first()
    spread, binomial, weighted, m = r
    if not m or not binomial or not weighted:
        return MAX_STRENGTH
    # E[sum n (k/n - p)^2] = sum p(1-p) * (1 + (n - 1) rho), rho = 1 / (strength + 1)
    over = spread - binomial
    scale = weighted - binomial
    if over <= 0 or scale <= 0:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, scale / over - 1))


def reputation(outcomes: DataFrame, z: float = Z) -> DataFrame:
    """From rows (host, bad: boolean or null for unlabelled) to a row per host: n, k, mean, low.

    A host without labels has its domain's mean as prior.  No labels at all: the mean is 0.5 and low is below it."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.count_if("bad").alias("k"))
    hosts = materialise(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"), "hosts")
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    overall = ((k or 0) + 0.5) / ((n or 0) + 1.0)
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("prior", F.lit(overall))
    s = _strength(level)
    means = level.select("suffix", ((F.col("k") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    level = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(means, "suffix")
    s = _strength(level)
    means = level.select("suffix", "domain", ((F.col("k") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    level = materialise(hosts.join(means, ["suffix", "domain"]), "priors")
    s = _strength(level)
    a, b = F.col("k") + s * F.col("prior"), F.col("n") - F.col("k") + s * (1 - F.col("prior"))
    mean = a / (a + b)
    low = mean - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return level.select("host", "n", "k", mean.alias("mean"), low.alias("low"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", max_bad: float = MAX_BAD) -> DataFrame:
    """Per page: id, host, path, rule, verdict, bad_rate, bad_rate_low.  ``outcomes``: rows (id, bad), one per id.

    Null or odd urls have an empty host, which is judged like any host.  Repeated pages are judged each."""
    rows = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = outcomes.select(F.col("id").alias("o_id"), "bad")
    scores = reputation(rows.join(known, F.col("id") == F.col("o_id"), "left").select("host", "bad"))
    j = rows.join(scores, "host").withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    by_method = F.when(F.col("low") > max_bad, "block").otherwise("allow")
    return j.select(F.col("id").alias(id_col), "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", by_method).alias("verdict"), F.col("mean").alias("bad_rate"), F.col("low").alias("bad_rate_low"))
