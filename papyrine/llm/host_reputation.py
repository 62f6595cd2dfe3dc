"""URL filters: explicit host and path rules, then an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted by host.  Beta-binomial priors shrink each level towards
the one above: suffix towards the whole, registered domain towards its suffix, host towards its domain.
Each prior's strength is fitted by the method of moments from the spread of the level's own rates.
A host is blocked where the lower bound of its posterior bad rate passes a threshold, so that few
labels alone block nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrine.llm.scratch import Scratch

#: (verdict, host, path).  A rule's name is host + path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Public suffixes of two labels under which names are registered.
#: This is no whole list of public suffixes; ``judge`` takes another.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "co.in", "co.kr", "com.mx", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEVELS = ("suffix", "domain", "host")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and ``/``, ``?``, ``#`` or end; path from there up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    ``rules`` is a configured list that goes into the plan; of two rules of one length the first wins.
    """
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(ordered):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_levels(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; ports and a last dot are left out, an address is its own domain.

    ``suffixes`` are those public suffixes that have two labels.
    """
    name = F.regexp_replace(F.regexp_replace(host, r":\d*$", ""), r"\.$", "")
    two = F.substring_index(name, ".", -2)
    suffix = F.when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))
    labels = F.size(F.split(suffix, r"\.")) + 1
    domain = F.when(labels == 3, F.substring_index(name, ".", -3)).otherwise(two)
    address = name.rlike(r"^(\d{1,3}\.){3}\d{1,3}$|^\[")
    return F.when(address, name).otherwise(domain), F.when(address, F.lit("")).otherwise(suffix)


def prior_strength(level: DataFrame, mean: str, most: float = 200.0, least: float = 1.0) -> DataFrame:
    """One row: strength s of Beta(s*m, s*(1-m)) over the level's units, by the method of moments.

    With rates p_i from n_i labels around means m_i: the weighted spread S of p_i - m_i has expectation
    V * ((1 - r) * units + r * labels) for V = m(1-m) and intraclass correlation r, and s = (1 - r) / r.
    Without two labelled units the strength is ``most``.
    """
    m = F.col(mean)
    d = F.col("bad") / F.col("n") - m
    row = level.where(F.col("n") > 0).agg(
        F.sum(F.col("n") * d * d).alias("spread"),
        F.sum(m * (1 - m)).alias("unit_var"),
        F.sum(F.col("n") * m * (1 - m)).alias("label_var"),
        F.count(F.lit(1)).alias("units"),
    )
    r = (F.col("spread") - F.col("unit_var")) / (F.col("label_var") - F.col("unit_var"))
    fit = F.when((F.col("units") > 1) & (F.col("label_var") > F.col("unit_var")) & (F.col("spread") > F.col("unit_var")), (1 - r) / r)
    return row.select(F.least(F.greatest(F.coalesce(fit, F.lit(most)), F.lit(least)), F.lit(most)).alias("strength"))


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """From host counts (host, domain, suffix, n, bad): posterior rate and its lower and upper bound.

    The bounds are a normal approximation: the posterior mean -/+ z standard deviations of a Beta distribution of
    that mean, whose prior is taken to be worth no more labels than there are in all.  That makes them wider than
    those of the posterior itself where labels are few, so that few labels block nothing.  Hosts without
    labels get their domain's posterior; without any labels the overall rate is 1/2.
    """
    overall = hosts.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("overall"), F.coalesce(F.sum("n"), F.lit(0)).alias("labels"))
    suffixes = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    # overall rates and prior strengths are single rows
    one = F.broadcast
    s = suffixes.join(one(overall.select(F.coalesce("overall", F.lit(0.5)).alias("overall"))))
    s = s.join(one(prior_strength(s, "overall")))
    s = s.select("suffix", ((F.col("bad") + F.col("strength") * F.col("overall")) / (F.col("n") + F.col("strength"))).alias("suffix_rate"))
    d = domains.join(s, "suffix")
    d = d.join(one(prior_strength(d, "suffix_rate")))
    d = d.select("domain", "suffix", ((F.col("bad") + F.col("strength") * F.col("suffix_rate")) / (F.col("n") + F.col("strength"))).alias("domain_rate"))
    h = hosts.join(d, ["domain", "suffix"])
    h = h.join(one(prior_strength(h, "domain_rate"))).join(one(overall.select("labels")))
    rate = (F.col("bad") + F.col("strength") * F.col("domain_rate")) / (F.col("n") + F.col("strength"))
    sd = F.sqrt(rate * (1 - rate) / (F.col("n") + F.least("strength", F.col("labels").cast("double")) + 1))
    return h.select("host", "domain", "suffix", "n", "bad", rate.alias("rate"), (rate - z * sd).alias("lower"), (rate + z * sd).alias("upper"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    rules: Sequence[tuple[str, str, str]] = RULES,
    max_bad: float = 0.25,
    z: float = 1.645,
    suffixes: Sequence[str] = TWO_LABEL_SUFFIXES,
) -> DataFrame:
    """Verdict for every row of ``pages`` (page_id, url).

    ``outcomes`` (page_id, bad 0/1) may cover some pages; null outcomes count nothing, and repeated ones
    each count.  The verdict is the longest fitting rule's, else ``block`` where the lower bound of the
    host's posterior bad rate is over ``max_bad``, else ``allow``.  Rows without a host (null url, no ``://``)
    form one host of their own, the empty one.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    domain, suffix = host_levels(F.col("host"), suffixes)
    seen = outcomes.where(F.col("bad").isNotNull()).select("page_id", F.col("bad").cast("bigint").alias("bad"))
    labelled = parts.select("page_id", "host").join(seen, "page_id").groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    hosts = (
        parts.select("host").distinct().join(labelled, "host", "left").fillna(0, ["n", "bad"]).withColumn("domain", domain).withColumn("suffix", suffix)
    )
    # one row per host, written once: all levels are fitted from it
    hosts = Scratch(pages.sparkSession, "hosts").table(hosts, "hosts")
    scored = reputation(hosts, z).select("host", "rate", "lower", "upper", "n")
    rule = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("lower") > F.lit(max_bad), F.lit("block")).otherwise(F.lit("allow"))
    return (
        parts.join(scored, "host", "left")
        .withColumn("__rule", rule)
        .select(
            "page_id",
            "host",
            "path",
            F.col("__rule.rule").alias("rule"),
            F.coalesce(F.col("__rule.verdict"), learned).alias("verdict"),
            F.col("rate").alias("host_rate"),
            F.col("lower").alias("host_lower"),
        )
    )


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Outcomes of pages: the first number in a url's path names the document it shows; bad is toxic or low quality."""
    _, path = url_parts(F.col("url"))
    doc = F.regexp_extract(path, r"/(\d{1,18})(?!\d)", 1)
    shown = pages.select("page_id", F.when(doc != "", doc.cast("bigint")).alias("doc_id"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNull() & F.col("quality").isNull(), None).otherwise(0)
    return shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
