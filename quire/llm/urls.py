"""URL filter: host reputation by empirical Bayes.

Labelled page outcomes (1 = bad) are pooled at three levels: host, registered domain, suffix. Each
level has a beta-binomial prior centred on the shrunken mean of the level above; its strength is
fitted to the data by moments (the intra-class correlation of children within a parent). A host is
blocked where the lower bound of its posterior bad rate, mean less ``z`` standard deviations, exceeds
``limit``. Explicit rules win over the reputation, the longest first.

Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed. Repeated
rows are judged alike; repeated labels of one page count once (bad if any says so); a page without
a label counts for nothing. Without any label every host is allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import heavy_keys, lower_ascii, materialise, salted_join

# Suffixes of two labels; every other suffix is the last label.
TWO_LABEL_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]

#: Reputations are broadcast up to this many hosts; beyond it a salted shuffle join takes over.
BROADCAST_HOSTS = 100_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    host = lower_ascii(F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*", 0))
    return F.coalesce(F.when(at > 0, host), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substring(url, at + 3, F.length(url)), "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.when(at > 0, path), F.lit(""))


def domain_of(host: Column) -> Column:
    """Registered domain: suffix and one label more; the host itself where it is no longer."""
    labels = F.split(host, "\\.")
    two = F.array_join(F.slice(labels, -2, 2), ".").isin(TWO_LABEL_SUFFIXES) & (F.size(labels) > 2)
    take = F.when(two, 3).otherwise(2)
    return F.when(F.size(labels) <= take, host).otherwise(F.array_join(F.slice(labels, -take, take), "."))


def suffix_of(host: Column) -> Column:
    labels = F.split(host, "\\.")
    two = F.array_join(F.slice(labels, -2, 2), ".").isin(TWO_LABEL_SUFFIXES)
    return F.when((F.size(labels) >= 2) & two, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.element_at(labels, -1))


def rule_of(host: Column, path: Column, rules: list[UrlRule], what: str) -> Column:
    """``text`` or ``verdict`` of the longest rule that fits, null where none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, getattr(r, what)) if out is None else out.when(fits, getattr(r, what))
    return F.lit(None).cast("string") if out is None else out


def _strength(level: DataFrame) -> float:
    """Prior strength 1 / rho - 1 of children (n, b) within parents (pn, pb), fitted by moments."""
    p, q = F.try_divide("b", "n"), F.try_divide("pb", "pn")
    by = level.where("n > 0").groupBy("parent").agg(
        F.first("pn").alias("pn"), F.first("pb").alias("pb"),
        F.sum(F.col("n") * (p - q) * (p - q)).alias("s"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count("*").alias("k"),
    )
    v = q * (1 - q)
    r = by.agg(
        F.sum(F.col("s") - (F.col("k") - 1) * v).alias("over"),
        F.sum(v * (F.col("pn") - F.try_divide("n2", "pn") - (F.col("k") - 1))).alias("room"),
    ).first()
    if not r or not r["room"] or r["room"] <= 0:
        return 10.0
    rho = min(0.99, max(0.001, r["over"] / r["room"]))
    return 1 / rho - 1


def reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Host table (host, pages, n, bad, mean, bound) from pages (host, page_id) and labels (page_id, bad)."""
    one = labels.where("page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    seen = pages.join(one, "page_id", "left")
    hosts = materialise(
        seen.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("b"))
        .withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))),
        "hosts",
    )
    domains = materialise(hosts.groupBy("domain").agg(F.first("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("hosts")), "domains")
    suffixes = materialise(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.count("*").alias("domains")), "suffixes")
    # a blog platform may hold most hosts and com most domains: such keys are salted
    wide, broad = heavy_keys(domains, "domain", "hosts"), heavy_keys(suffixes, "suffix", "domains")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("b").alias("b")).first()
    n, b = whole["n"] or 0, whole["b"] or 0
    mu = (b + 1.0) / (n + 2.0)
    up = lambda d, k: d.select(F.col(k), F.col("n").alias("pn"), F.col("b").alias("pb"))
    k_host = _strength(salted_join(hosts, up(domains, "domain"), "domain", wide).withColumn("parent", F.col("domain")))
    k_domain = _strength(salted_join(domains, up(suffixes, "suffix"), "suffix", broad).withColumn("parent", F.col("suffix")))
    top = suffixes.select(F.lit(0).alias("parent"), "n", "b", F.lit(n).cast("long").alias("pn"), F.lit(b).cast("long").alias("pb"))
    k_suffix = _strength(top)
    post = lambda k, prior: (F.col("b") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    s = suffixes.select("suffix", post(k_suffix, F.lit(mu)).alias("m_s"))
    d = salted_join(domains, s, "suffix", broad).select("domain", post(k_domain, F.col("m_s")).alias("m_d"))
    mean, size = post(k_host, F.col("m_d")), F.col("n") + F.lit(k_host)
    return (
        salted_join(hosts, d, "domain", wide)
        .select("host", "pages", "n", F.col("b").alias("bad"), mean.alias("mean"), (mean * (1 - mean) / (size + 1)).alias("_var"))
        .withColumn("sd", F.sqrt("_var")).drop("_var")
    )


def judge(pages: DataFrame, labels: DataFrame, rules: list[UrlRule], z: float = 1.64, limit: float = 0.5, url: str = "url", page_id: str = "page_id") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, bound) for each row of ``pages``.

    ``labels`` has page_id and bad (0 or 1). Beyond BROADCAST_HOSTS hosts the reputations come by
    a join in which hosts with over 1/500 of the pages are salted, so one host may hold any share.
    """
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    own = own.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    table = materialise(reputation(own.select("page_id", "host"), labels), "reputation")
    known = table.select("host", (F.col("mean") - F.lit(z) * F.col("sd")).alias("bound"))
    if table.count() <= BROADCAST_HOSTS:
        out = own.join(F.broadcast(known), "host", "left")
    else:
        out = salted_join(own, known, "host", heavy_keys(table, "host", "pages"))
    host, path = F.col("host"), F.col("path")
    given = rule_of(host, path, rules, "verdict")
    method = F.when((host != "") & (F.col("bound") > F.lit(limit)), "block").otherwise("allow")
    return out.select(
        "page_id", "url", "host", "path", rule_of(host, path, rules, "text").alias("rule"),
        F.coalesce(given, method).alias("verdict"), "bound",
    )
