"""URL expressions. Hosts are cut out by pattern, as parse_url gives up on characters that browsers accept."""

from __future__ import annotations

from urllib.parse import quote, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ty


def host(url: Column) -> Column:
    """Lower-cased host without user and port; null if there is none."""
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.when(h != "", h)


def domain(url: Column) -> Column:
    """Host, or the empty string."""
    return F.coalesce(host(url), F.lit(""))


def raw_domain(url: Column) -> Column:
    """What stands between :// and the next slash, lower-cased: port and query stay."""
    return F.lower(F.regexp_extract(url, "://([^/]*)", 1))


def normalize_url(url: Column) -> Column:
    """Fragment dropped; scheme, host and path lower-cased; slashes at the path's end stripped unless it is /; query kept. Null if not a URL."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    path = F.lower(part(3))
    path = F.when(path.rlike("^/*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.when(part(2) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), path, part(4)))


def content_type(url: Column, title: Column) -> Column:
    slashes = F.length(url) - F.length(F.replace(url, F.lit("/"), F.lit("")))
    t = F.lower(title)
    return (
        F.when(url.endswith("/") | (slashes <= 3), "homepage")
        .when(F.contains(url, F.lit("/about")) | F.contains(t, F.lit("about")), "about")
        .when(F.contains(url, F.lit("/contact")) | F.contains(t, F.lit("contact")), "contact")
        .otherwise("article")
    )


def absolute(base: str, href: str) -> str | None:
    """An http or https link resolved against its page, non-ASCII percent-encoded; None for others."""
    try:
        u = urlsplit(urljoin(base, href.strip()))
    except ValueError:
        return None
    if u.scheme not in ("http", "https") or not u.netloc:
        return None
    safe = "/:@!$&'()*+,;=~-._%"
    return urlunsplit((u.scheme, u.netloc, quote(u.path, safe=safe) or "/", quote(u.query, safe=safe + "?/"), quote(u.fragment, safe=safe + "?/")))


@F.udf(ty.ArrayType(ty.StringType()), useArrow=False)
def absolute_links(base: str, hrefs: list[str] | None) -> list[str]:
    return [a for h in hrefs or [] if (a := absolute(base, h))]
