"""URL filter: explicit rules first, else an empirical-Bayes reputation of the host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_side, stash

#: Fixed values: (rule host, rule path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LEVELS = ("suffix", "domain", "host")
AZ, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Bound:
    """Block a host if its bad rate exceeds max_bad even at z standard deviations under the posterior mean."""

    max_bad: float = 0.25
    z: float = 1.0


def url_host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, AZ, LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


#: Labels that, before a two-letter country code, belong to the public suffix (co.uk, com.au).
SECOND_LEVEL = "ac co com edu go gob gouv gov gv ltd me mil ne net nom or org plc sch".split()
ADDRESS = r"^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$"


def bare_host(host: Column) -> Column:
    """A host without its port and the dot at its end."""
    return F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.$", "")


def suffix(host: Column) -> Column:
    """The public suffix: the last label, or two where the last is a country code after one of SECOND_LEVEL; of an address, the address."""
    bare = bare_host(host)
    last, two = F.substring_index(bare, ".", -1), F.substring_index(bare, ".", -2)
    deep = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(SECOND_LEVEL) & two.contains(".")
    return F.when(bare.rlike(ADDRESS), bare).when(deep, two).otherwise(last)


def registered_domain(host: Column) -> Column:
    """The public suffix with one label before it; the host where it has none."""
    bare = bare_host(host)
    labels = F.size(F.split(suffix(host), r"\."))
    return F.when(bare.rlike(ADDRESS), bare).when(labels == 2, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the host or a parent of it and whose path starts the path."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame) -> tuple[float, float, float]:
    """Moment estimates over (n, bad) groups: overall bad rate, prior strength, number of outcomes. One row reaches the driver."""
    s = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("k"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count("*").alias("g")).first()
    if not s["n"]:
        return 0.5, 2.0, 0.0
    n, k, g = float(s["n"]), float(s["k"]), float(s["g"])
    p = (k + 0.5) / (n + 1)
    within, room = p * (1 - p), n - s["nn"] / n - (g - 1)
    rho = (s["kk"] - k * k / n - within * (g - 1)) / (within * room) if room > 0 else 0.001
    rho = min(0.5, max(0.001, rho))
    return p, (1 - rho) / rho, n


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """Posterior (a, b) of the bad rate of every host in outcomes(host, bad 0/1 or null where unlabelled).

    Each level's prior mean is its parent's posterior mean, its strength a moment estimate at that
    level; hosts without labels inherit their domain. Hosts are counted before the shuffle, once, so a hot
    host costs no more than another. Null hosts count as the empty host; an empty table gives no rows.
    """
    host = F.coalesce(F.col("host"), F.lit(""))
    hosts = outcomes.groupBy(host.alias("host")).agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stash(hosts.withColumn("domain", registered_domain(F.col("host"))).withColumn("suffix", suffix(F.col("host"))))  # read by every level
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    p, strength, _ = _strength(suffixes.filter("n > 0"))
    suffixes = suffixes.select("suffix", ((F.lit(p * strength) + F.col("bad")) / (F.lit(strength) + F.col("n"))).alias("suffix_mean"))
    _, strength, _ = _strength(domains.filter("n > 0"))
    domains = domains.join(suffixes, "suffix").select("domain", ((F.col("suffix_mean") * strength + F.col("bad")) / (F.lit(strength) + F.col("n"))).alias("domain_mean"))
    _, strength, _ = _strength(hosts.filter("n > 0"))
    good = F.col("n") - F.col("bad")
    return hosts.join(domains, "domain").select("host", (F.col("domain_mean") * strength + F.col("bad")).alias("a"), ((1 - F.col("domain_mean")) * strength + good).alias("b"))


def posterior_bound(a: Column, b: Column, z: float) -> Column:
    mean = a / (a + b)
    return mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))


def judge_urls(pages: DataFrame, labels: DataFrame, bound: Bound = Bound(), rules=RULES, page_id="page_id", url="url") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages(page_id, url).

    labels(page_id, bad) are the labelled outcomes; repeated labels of a page count once (the worst), a
    page without one is a page of its host all the same. Very long urls are read whole. Urls that are null or have no ``://`` get the empty host and path, and the reputation of the empty
    host. Repeated rows are judged alike, extra columns are ignored, an empty table gives no rows.
    """
    parsed = pages.select(F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    known = labels.groupBy("page_id").agg(F.max("bad").alias("bad"))
    reputation = host_reputation(parsed.join(known, "page_id", "left"))
    blocked = reputation.select("host", (posterior_bound(F.col("a"), F.col("b"), bound.z) > bound.max_bad).alias("blocked"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.join(blocked, "host", "left").withColumn("rule", rule)
    return judged.select("page_id", "host", "path", "rule", F.coalesce(verdict, F.when(F.col("blocked"), "block").otherwise("allow")).alias("verdict"))


def squeezed(text: Column) -> Column:
    """A hash of a text's characters that are no white space; null counts as empty."""
    return F.md5(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f\p{Z}]", ""))


def page_outcomes(texts: DataFrame, docs: DataFrame, labels: DataFrame, page_id="page_id", page_text="text", doc_id="doc_id", text="text") -> DataFrame:
    """(page_id, bad): a page's outcome is the worst label of the documents whose text it carries, whole or under a heading of its own.

    texts are the pages' main texts, blocks between empty lines; labels(doc_id, bad). Pages without words,
    and those that carry no labelled document, have no row.
    """
    whole = F.coalesce(F.col(page_text), F.lit(""))
    below = F.regexp_replace(whole, r"(?s)^.*?(\n\n|$)", "")
    carried = texts.select(F.col(page_id).alias("page_id"), F.explode(F.array_distinct(F.array(squeezed(whole), squeezed(below)))).alias("mark")).filter(F.col("mark") != F.md5(F.lit("")))
    known = labels.filter("doc_id IS NOT NULL AND bad IS NOT NULL").groupBy("doc_id").agg(F.max("bad").alias("bad"))
    marks = docs.select(F.col(doc_id).alias("doc_id"), squeezed(F.col(text)).alias("mark")).join(known, "doc_id")
    marks = stash(marks.groupBy("mark").agg(F.max("bad").alias("bad")))
    return carried.join(small_side(marks), "mark").groupBy("page_id").agg(F.max("bad").alias("bad"))
