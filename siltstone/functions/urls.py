"""Hosts, domains and URL policies."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
# fixed values: hosts on which many organisations publish
PLATFORMS = (
    "medium.com", "substack.com", "ghost.io", "wordpress.com", "blogspot.com", "notion.site", "dev.to", "github.io", "hashnode.com", "mirror.xyz",
    "beehiiv.com", "buttondown.email", "linkedin.com", "twitter.com", "x.com", "posthaven.com", "bearblog.dev", "write.as", "wikipedia.org",
)
# fixed values: names of instance metadata services
METADATA_HOSTS = ("metadata.google.internal", "metadata", "instance-data", "metadata.azure.com")
#: Shared address space of carriers, which counts as private.
CARRIER = ipaddress.ip_network("100.64.0.0/10")


def host(url: Column) -> Column:
    """Lower-case host without port, user and final dot, an IPv6 address without its brackets; empty where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))
    return F.coalesce(F.regexp_replace(found, r"^\[|\]$|\.$", ""), F.lit(""))


def registrable_domain(url: Column, suffixes: tuple[str, ...] = TWO_LABEL_SUFFIXES) -> Column:
    """The registered name: two labels, three under a suffix of two; an address or a single label is itself."""
    h = host(url)
    last2 = F.substring_index(h, ".", -2)
    plain = F.when(last2.isin(*suffixes), F.substring_index(h, ".", -3)).otherwise(last2)
    return F.when(F.regexp_like(h, F.lit(r"^[0-9.]+$|:")), h).otherwise(plain)


# fixed values: some rules of the public suffix list's three kinds, as that list writes them; a whole list is an argument
SUFFIX_RULES = ("com", "org", "net", "co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp")


def suffix_rules(rules: DataFrame) -> DataFrame:
    """(key, exception, n): what each rule of (rule) matches, and how many labels the public suffix then has."""
    key = F.regexp_replace(F.lower("rule"), r"^(\*\.|!)", "")
    labels = F.size(F.split(key, r"\."))
    exception, any_label = F.startswith("rule", F.lit("!")), F.startswith("rule", F.lit("*."))
    return rules.select(key.alias("key"), exception.alias("exception"), F.when(exception, labels - 1).when(any_label, labels + 1).otherwise(labels).alias("n"))


def registrable_domains(rows: DataFrame, url: str, rules: DataFrame, to: str = "domain") -> DataFrame:
    """``rows`` with the registered name of each URL by suffix rules: one label more than the public suffix.

    A host's suffixes meet the rules in a join; an exception goes before all others, then the longest suffix; without a
    rule the last label is the suffix.  A host that is a public suffix, an address or a single label is itself; without a host it is empty.
    """
    hosts = rows.select(host(F.col(url)).alias("_host")).distinct()
    labels = F.split("_host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    met = hosts.select("_host", F.size(labels).alias("_n"), F.explode(ends).alias("key")).join(suffix_rules(rules), "key").where("n <= _n")
    best = met.groupBy("_host").agg(F.max(F.struct("exception", "n")).alias("_best"))
    n = F.coalesce("_best.n", F.lit(1)) + 1
    name = F.when(F.regexp_like("_host", F.lit(r"^[0-9.]+$|:")) | (F.size(labels) <= n), F.col("_host")).otherwise(F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    named = hosts.join(best, "_host", "left").select("_host", name.alias(to))
    return rows.withColumn("_host", host(F.col(url))).join(named, "_host").drop("_host")


def is_platform(domain: Column, platforms: tuple[str, ...] = PLATFORMS) -> Column:
    return domain.isin(*platforms)


def address_is_public(address: str) -> bool:
    """Whether this is the text of a public IP address; anything that is no plain address is not."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    inside = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
    return not inside and not (ip.version == 4 and ip in CARRIER)


@F.pandas_udf(T.BooleanType())
def _literal_is_public(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda h: h is not None and address_is_public(h))


def url_allowed(url: Column) -> Column:
    """http or https, with a host that is no metadata service; an address must be public and plainly written.

    A host counts as an address if it has a colon or its last label is a number (decimal, octal or hexadecimal).
    A URL with a backslash, white space or a control character is refused: parsers differ on what its host is.
    Names still have to be resolved, and their addresses checked with ``address_is_public``, by whoever fetches.
    """
    h = host(url)
    literal = F.regexp_like(h, F.lit(r":|(?:^|\.)(?:0x[0-9a-f]*|[0-9]+)$"))
    good = F.coalesce(F.regexp_like(url, F.lit("^(?i:https?)://")) & ~F.regexp_like(url, F.lit(r"[\\\x00-\x20\x7f]")), F.lit(False)) & (h != "")
    return good & ~h.isin("localhost", *METADATA_HOSTS) & ~F.regexp_like(h, F.lit(r"\.localhost$")) & (~literal | _literal_is_public(h))


def hosts_allowed(urls: Column, allowed: Column) -> Column:
    """Whether every URL's host is allowed: true without URLs, false where one has no host."""
    return F.forall(urls, lambda u: (host(u) != "") & F.array_contains(allowed, host(u)))


def robots_allowed(robots: str | None, url: str, agent: str) -> bool:
    """Whether a site's robots.txt lets ``agent`` read the URL; without a file (or with an unreadable one) it may."""
    from urllib.robotparser import RobotFileParser

    if not robots:
        return True
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, url)
