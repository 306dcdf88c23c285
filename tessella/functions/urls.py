"""Address scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Public suffixes of two labels that occur often; any other suffix counts as one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "co.jp", "co.nz", "com.br", "co.in", "co.za", "com.mx", "com.tr", "co.kr")
# Host labels that don't name anybody.
GENERIC_LABELS = ("www", "com", "net", "org", "info", "app", "apps", "web", "site", "help", "support", "legal", "privacy", "policies", "shop", "store", "blog", "docs", "example", "co", "uk", "io")


def host(url: Column) -> Column:
    """Lower-case host, '' where there is none."""
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def path(url: Column) -> Column:
    """Path, '' where there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))


def origin(url: Column) -> Column:
    """Scheme and host of a web address, null for anything else."""
    u = F.trim(url)
    return F.when(u.rlike(r"(?i)^https?://[^/?#\s]+"), F.lower(F.regexp_extract(u, r"(?i)^(https?://[^/?#\s]+)", 1)))


def registrable(h: Column) -> Column:
    """Domain that can be registered: the last two labels, or three before a two-label suffix."""
    parts = F.split(h, r"\.")
    two, three = F.array_join(F.slice(parts, -2, 2), "."), F.array_join(F.slice(parts, -3, 3), ".")
    return F.when(F.size(parts) < 3, h).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def same_site(url: Column, base: Column) -> Column:
    """Whether two addresses belong to one registrable domain; an address without a host belongs anywhere."""
    h = host(url)
    return (h == "") | (registrable(h) == registrable(host(base)))


def slug(raw: Column) -> Column:
    """Identifier of a name: runs of other characters than letters and digits as hyphens, 60 characters; a hash if nothing is left."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return F.coalesce(F.nullif(s, F.lit("")), F.substring(F.sha1(raw), 1, 10))


def absolute(href: Column, base: Column) -> Column:
    """Address of a link on the page ``base``."""
    org = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*:)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(href.rlike(r"(?i)^[a-z][a-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(org, href))
        .otherwise(F.concat(folder, F.lit("/"), href))
    )


def looks_like_pdf(content_type: Column, url: Column, head: Column) -> Column:
    """By its first bytes, its content type or the ending of its path."""
    tail = F.lower(F.regexp_replace(url, r"[?#].*$", ""))
    starts = F.substring(head, 1, 5) == F.lit(b"%PDF-")
    return (
        F.coalesce(starts, F.lit(False)) | F.coalesce(F.contains(F.lower(content_type), F.lit("pdf")), F.lit(False)) | F.coalesce(tail.endswith(".pdf"), F.lit(False))
    )
