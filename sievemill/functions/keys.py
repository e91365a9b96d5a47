"""URLs and identities as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemill.functions.text import lower_squash, squash

_URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
# Query parameters that only track.
TRACKING = ("gclid", "fbclid", "mc_cid", "mc_eid", "ref", "source")


def _part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, _URL, i)


def canonical_url(c: Column, mode: str = "key") -> Column:
    """The canonical form of a URL; null is empty.

    ``key``: scheme and host in lower case, path without end slashes, no query. ``view``: the same
    without changing case. ``tracked``: single slashes in the path, tracking parameters dropped,
    the others kept in order. ``exact``: only the fragment is dropped.
    """
    c = squash(c)
    if mode == "exact":
        return F.regexp_replace(c, "#.*$", "")
    scheme, host, path, query = (_part(c, i) for i in (1, 2, 3, 4))
    if mode != "view":
        scheme, host = F.lower(scheme), F.lower(host)
    head = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""))
    if mode in ("key", "view"):
        return F.concat(head, F.regexp_replace(path, "/+$", ""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING) & ~F.lower(p).startswith("utm_"))
    return F.concat(head, F.regexp_replace(path, "/{2,}", "/"), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_param(c: Column, name: str) -> Column:
    """First value of a query parameter whose name matches without regard to case, or null."""
    hits = F.filter(F.split(_part(c, 4), "&"), lambda p: F.lower(F.substring_index(p, "=", 1)) == name.lower())
    return F.when(F.size(hits) > 0, F.regexp_replace(hits[0], "^[^=]*=?", ""))


def window_seconds(c: Column, name: str) -> Column:
    """A parameter of the form ``r<digits>`` (either case) above zero, as seconds."""
    n = F.regexp_extract(F.coalesce(url_param(c, name), F.lit("")), r"^[rR](\d{1,9})$", 1)
    n = F.nullif(n, F.lit("")).cast("long")
    return F.when(n > 0, n)


def set_url_param(c: Column, name: str, value: int) -> Column:
    """Set a parameter in place, or append it; ``value`` must be positive."""
    if value <= 0:
        raise ValueError("a time window must be positive")
    there = rf"([?&]){name}=[^&#]*"
    glue = F.when(c.contains("?"), "&").otherwise("?")
    return F.when(c.rlike(there), F.regexp_replace(c, there, f"$1{name}=r{value}")).otherwise(F.concat(c, glue, F.lit(f"{name}=r{value}")))


def job_key(source: Column, job_id: Column, url: Column) -> Column:
    """Ledger key: 24 hex digits over source, id and canonical URL."""
    return F.substring(F.sha2(F.concat_ws("\x1f", F.coalesce(source, F.lit("")), F.coalesce(job_id, F.lit("")), canonical_url(url)), 256), 1, 24)


def stable_id(source: Column, url: Column, title: Column, company: Column, location: Column) -> Column:
    """``source_`` and 20 hex digits over the canonical URL or else title, company and location."""
    link = canonical_url(url, "tracked")
    return F.concat(source, F.lit("_"), F.substring(F.sha2(F.when(link != "", link).otherwise(F.concat_ws("|", squash(title), squash(company), squash(location))), 256), 1, 20))


def content_fingerprint(version: str, *fields: Column) -> Column:
    """SHA-256 over a policy version and the fields in lower case with single spaces."""
    return F.sha2(F.concat_ws("\x1f", F.lit(version), *[lower_squash(f) for f in fields]), 256)


def numeric_id(job_id: Column, url: Column) -> Column:
    """The first run of six digits or more of the id, else of the URL, else null."""
    digits = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(\d{6,})", 1), F.lit(""))
    return F.coalesce(digits(job_id), digits(url))


def canonical_identity(job_id: Column, url: Column) -> Column:
    """``id:`` and digits where found, else ``url:`` and the canonical URL."""
    return F.coalesce(F.concat(F.lit("id:"), numeric_id(job_id, url)), F.concat(F.lit("url:"), canonical_url(url, "view")))


def posting_id(job_id: Column, url: Column) -> Column:
    """The posting's number of six digits or more that an id (``jobPosting:…``) or a view's URL tells, else null."""
    number = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?:jobPosting:|/jobs/view/(?:[^/?#]*-)?)(\d{6,})", 1), F.lit(""))
    return F.coalesce(number(job_id), number(url))


def url_id(url: Column) -> Column:
    """24 hex digits over the canonical URL (as in a view); null for none."""
    link = canonical_url(url, "view")
    return F.when(link != "", F.substring(F.sha2(link, 256), 1, 24))


def listing_fingerprint(title: Column, company: Column, location: Column) -> Column:
    """Title, company and place in lower case with single spaces, joined by bars."""
    return F.concat_ws("|", lower_squash(title), lower_squash(company), lower_squash(location))
