"""Normal forms of URLs. Each use compares differently, and the forms are kept apart: what one drops another needs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import is_pdf_url  # noqa: F401  the predicate on URLs that the text module has

PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, n: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty if absent or if the text is no URL."""
    return F.coalesce(F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), PARTS, n), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def authority(url: Column) -> Column:
    return part(url, 2)


def host(url: Column) -> Column:
    """Without user and port, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", ""))


def port(url: Column) -> Column:
    return F.regexp_extract(authority(url), r":(\d+)$", 1)


def is_web(url: Column) -> Column:
    return scheme(url).isin("http", "https") & (authority(url) != "")


def _query(url: Column) -> Column:
    return F.when(part(url, 4) != "", F.concat(F.lit("?"), part(url, 4))).otherwise(F.lit(""))


def _path(url: Column, keep_slash: bool) -> Column:
    path = part(url, 3)
    return F.when((F.rtrim(path, F.lit("/")) if not keep_slash else path) == "", F.lit("/")).otherwise(path if keep_slash else F.rtrim(path, F.lit("/")))


def is_public(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i:https?)://[^/?#]"), F.lit(False))


def join_form(url: Column) -> Column:
    """For joins: scheme and authority in lower case, no trailing slash, no fragment; empty if it is no web URL."""
    form = F.concat(scheme(url), F.lit("://"), F.lower(authority(url)), _path(url, False), _query(url))
    return F.when(is_web(url), form).otherwise(F.lit(""))


def rule_form(url: Column) -> Column:
    """For extraction rules: trimmed; empty if it is no web URL."""
    return F.when(is_web(url), F.concat(scheme(url), F.substr(F.trim(url), F.length(scheme(url)) + 1))).otherwise(F.lit(""))


def source_form(url: Column) -> Column:
    """For validation against the source: host in lower case, default port dropped, trailing slash kept, no fragment."""
    given = port(url)
    plain = (given == "") | ((scheme(url) == "http") & (given == "80")) | ((scheme(url) == "https") & (given == "443")) | (given == "0")
    form = F.concat(scheme(url), F.lit("://"), host(url), F.when(plain, F.lit("")).otherwise(F.concat(F.lit(":"), given)), _path(url, True), _query(url))
    return F.when(is_web(url), form).otherwise(F.lit(""))


def duplicate_form(url: Column) -> Column:
    """For anchors of duplicates: user, port, fragment and trailing slash dropped."""
    form = F.concat(scheme(url), F.lit("://"), host(url), _path(url, False), _query(url))
    return F.when(is_web(url) & (host(url) != ""), form).otherwise(F.lit(""))


def safe_form(url: Column) -> Column:
    """For fetching: scheme and ASCII host in lower case, the port kept, an empty path as a slash, no fragment."""
    given = F.when(port(url) != "", F.concat(F.lit(":"), port(url))).otherwise(F.lit(""))
    return F.concat(scheme(url), F.lit("://"), ascii_host(host(url)), given, _path(url, True), _query(url))


@F.pandas_udf(StringType())
def ascii_host(hosts: pd.Series) -> pd.Series:
    """IDNA form of host names; null for one that has none."""

    def one(name: str | None) -> str | None:
        try:
            return name.encode("idna").decode("ascii").lower() if name else name
        except UnicodeError:
            return None

    return hosts.map(one)


def expanded_hosts(hosts: Column) -> Column:
    """Hosts with their twins with and without ``www.``."""
    twins = F.transform(hosts, lambda h: F.when(F.startswith(h, F.lit("www.")), F.substr(h, F.lit(5))).otherwise(F.concat(F.lit("www."), h)))
    return F.array_sort(F.array_distinct(F.filter(F.array_union(hosts, twins), lambda h: (h != "") & (h != "www."))))


def refusal(url: Column, allowed: Column, prefixes: Column) -> Column:
    """Why a URL may not be fetched, or null: scheme, host, credentials, then the source's hosts and path prefixes. Addresses are checked where names are resolved."""
    path = F.when(part(url, 3) == "", F.lit("/")).otherwise(part(url, 3))
    return (
        F.when(~scheme(url).isin("http", "https"), F.lit("SCHEME"))
        .when(host(url) == "", F.lit("HOST_MISSING"))
        .when(F.contains(authority(url), F.lit("@")), F.lit("CREDENTIALS"))
        .when(~F.array_contains(allowed, host(url)), F.lit("HOST_NOT_ALLOWED"))
        .when(~F.exists(prefixes, lambda p: F.startswith(path, p)), F.lit("PATH_NOT_ALLOWED"))
    )


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def with_host(url: Column, official: str) -> Column:
    """The URL on the official host, https if it names no scheme."""
    same = F.concat(F.when(scheme(url) == "", F.lit("https")).otherwise(scheme(url)), F.lit("://"), F.lit(official), part(url, 3), _query(url))
    return F.when(host(url) == official, url).otherwise(same)
