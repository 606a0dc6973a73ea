"""URL verdicts: explicit rules first, else empirical-Bayes host reputation.

Page outcomes (1: bad) are counted by host, registered domain and public suffix. At each level the children's
spread about their parent's rate gives a method-of-moments estimate of the beta-binomial correlation rho, hence the
strength (1 - rho) / rho of the prior that the parent lends. Rates shrink from the whole to suffix, domain and host. A
host's posterior is Beta(bad + s * p, good + s * (1 - p)); its pages are blocked when the lower bound mean - z * sd of the
bad rate is over max_bad, so that a few bad pages don't block a host and unlabelled hosts take after their domain.

Outcomes come as a table by page id, or as a column of the pages' own; names_a_vice is such a rule, for pages without labels.

Scale: one combined aggregate makes the table of hosts, which is stored; domains, suffixes and strengths come from it, three
numbers a level reach the driver. Pages are joined with their host's verdict by a join that salts hot hosts; nothing that
grows with the data is broadcast.

Cases: a null url or one without '://' has an empty host and path and the reputation of the empty host. Outcomes that
repeat an id count once, by the worst; null outcomes and ids are unlabelled. Null page ids stay. Without any label the
rate is 0 and all pages pass. Repeated rows give repeated rows. Columns beside id and url are not read, but for the outcome's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, joined

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Public suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class UrlRule:
    """verdict for host and its subdomains where the path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (UrlRule("block", "net", "/"), UrlRule("allow", "example.net", "/en/"), UrlRule("block", "example.com", "/de/"), UrlRule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


#: Words of trades that a page names.
VICES = ("adult", "ads", "bets", "casino", "jackpot", "pills", "porn", "spam", "viagra")


def names_a_vice(html: Column) -> Column:
    """1 for a page that has one of VICES as a word anywhere in its html, else 0; null for no page."""
    return F.when(html.isNotNull(), F.translate(html, UPPER, LOWER).rlike(f"(^|[^a-z0-9])({'|'.join(VICES)})($|[^a-z0-9])").cast("int"))


def suffix_and_domain(host: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> tuple[Column, Column]:
    """Public suffix, and the label before it with it; a host that is all suffix is its own domain, and an address both.

    suffixes: those of several labels, four at most; the longest that ends a host is its suffix, else its last label.
    """
    labels = F.split(host, r"\.")
    address = host.rlike(r"^[0-9.]+(:[0-9]+)?$") | host.startswith("[")
    end = lambda k: F.concat_ws(".", F.slice(labels, -k, k))
    tail = lambda k: F.when(address | (F.size(labels) <= k), host).otherwise(end(k))
    suffix, domain = tail(1), tail(2)
    for k in (2, 3, 4):
        if known := [x for x in suffixes if x.count(".") == k - 1]:
            fits = (F.size(labels) >= k) & end(k).isin(*known)
            suffix, domain = F.when(fits, tail(k)).otherwise(suffix), F.when(fits, tail(k + 1)).otherwise(domain)
    return suffix, domain


def ruled(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is tested first
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def strength(children: DataFrame, rate: str) -> float:
    """Prior strength from the spread of children (n, bad) about their parents' rate."""
    p = f"least(greatest({rate}, 1e-6), 1 - 1e-6)"
    r = children.where("n > 0").agg(F.expr(f"sum(n * pow(bad / n - {p}, 2) / ({p} * (1 - {p})))").alias("q"), F.count("*").alias("k"), F.sum("n").alias("t")).first()
    rho = min(max((r.q - r.k) / (r.t - r.k) if r.q is not None and r.t != r.k else 0.0, 0.001), 0.999)
    return (1 - rho) / rho


def reputations(hosts: DataFrame, z: float) -> DataFrame:
    """host, bad_rate, lower_bound for every host of a stored table (host, domain, suffix, n, bad)."""
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = cut(hosts.groupBy("domain", "suffix").agg(*total))
    suffixes = cut(domains.groupBy("suffix").agg(*total))
    whole = suffixes.agg(F.expr("coalesce(sum(bad) / nullif(sum(n), 0), 0D)")).first()[0]

    def shrunk(level: DataFrame, rate: str, into: str) -> DataFrame:
        s = strength(level, rate)
        return level.withColumn("s", F.lit(s)).withColumn(into, F.expr(f"(bad + s * {rate}) / (n + s)"))

    level1 = shrunk(suffixes.withColumn("p0", F.lit(whole)), "p0", "p1").select("suffix", "p1")
    level2 = shrunk(cut(joined(domains, level1, "suffix", ["domain"])), "p1", "p2").select("domain", "p2")
    level3 = shrunk(cut(joined(hosts, level2, "domain", ["host"])), "p2", "bad_rate")
    return level3.select("host", "bad_rate", F.expr(f"bad_rate - {z!r}D * sqrt(bad_rate * (1 - bad_rate) / (n + s + 1))").alias("lower_bound"))


def judge(pages: DataFrame, outcomes: DataFrame | None = None, rules: tuple[UrlRule, ...] = RULES, max_bad: float = 0.5, z: float = 1.645, page_id: str = "page_id", url: str = "url", bad: Column | None = None, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bad_rate for each row of pages; outcomes has page_id and bad (0 or 1), or `bad` is a column of pages."""
    at = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), (F.lit(None) if bad is None else bad).cast("long").alias("bad"))
    host, path = host_and_path(F.col("url"))
    at = at.select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"), "bad")
    counted = at
    if outcomes is not None:
        seen = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("long")).alias("bad"))
        counted = at.drop("bad").join(seen, "page_id", "left")
    suffix, domain = suffix_and_domain(F.col("host"), suffixes)
    hosts = counted.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("*").alias("pages"))
    hosts = cut(hosts.withColumns({"suffix": suffix, "domain": domain}))
    known = cut(reputations(hosts, z))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("lower_bound") > max_bad, "block").otherwise("allow")
    judged = joined(at.drop("bad"), known, "host", ["page_id", "path"], counts=hosts.select("host", F.col("pages").alias("n")))
    return judged.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))
