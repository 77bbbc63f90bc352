"""URLs as columns: canonical form, host, listed hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tracking parameters, hosts that are never used, hosts of low value.
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref", "source", "mc_cid", "mc_eid"]
BLOCKED = ["scconline.com", "manupatra.com", "westlawindia.com", "lexisnexis.com"]
JUNK = [
    "toprankers.com", "byjus.com", "vedantu.com", "unacademy.com", "geeksforgeeks.org", "javatpoint.com", "tutorialspoint.com", "legalbites.in", "lawctopus.com",
    "cleartax.in", "taxguru.in",
]

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and one leading ``www.``; empty for what is no URL."""
    host = F.lower(F.regexp_extract(url, _AUTHORITY, 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    return F.regexp_replace(host, r"^www\.", "")


def _encoded(part: Column) -> Column:
    """Percent-decoded and encoded again, so that one value has one spelling; ``+`` for a blank."""
    plain = F.coalesce(F.try_url_decode(part), F.replace(part, F.lit("+"), F.lit(" ")))
    return F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no port, user or fragment, no slashes at the end of the path, no
    tracking or empty parameters; parameters keep the order of first appearance, repeats together.
    Values are re-encoded with ``+`` for a blank. http and https stay distinct."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    raw = F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&")
    pairs = F.filter(
        raw,
        lambda p: F.contains(p, F.lit("=")) & (F.substring_index(p, "=", 1) != p) & ~p.endswith("=") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING),
    )
    names = F.array_distinct(F.transform(pairs, lambda p: F.substring_index(p, "=", 1)))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(pairs, lambda p: F.substring_index(p, "=", 1) == n)))
    encoded = F.transform(grouped, lambda p: F.concat(_encoded(F.substring_index(p, "=", 1)), F.lit("="), _encoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1))))
    query = F.array_join(encoded, "&")
    return F.concat(scheme, F.lit("://"), host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_blocked(url: Column) -> Column:
    return host_of(url).isin(BLOCKED)


def is_junk(url: Column) -> Column:
    return host_of(url).isin(JUNK)


def host_suffixes(host: Column) -> Column:
    """a.b.c gives a.b.c, b.c and c, so that a suffix rule becomes an equi-join."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
